"""Byte-pair encoding by speculation: longest matches are proposed, every adjacent pair is tested, failures are merged exactly."""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_SPECIAL_KEY = "added_tokens"
_STOP = "\x00"  # stands for a word's end while matches are proposed; no byte has this letter
_SHORT = 48
_ROWS = 1024  # rows whose arrays stay in the processor's cache
_NEVER = np.iinfo(np.int64).max
_PLAIN_ENDS = ",.;:!?"
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of the given sizes from the given starts on, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def borders_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings that lie one after the other in ``data``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of ``binaries``."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    body = strings.buffers()[2]
    return np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces without white space of texts that lie one after the other in ``data``: the pieces, where each starts in it, and how many come before each text's start."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[offsets < len(data)]
    first[cuts] = inside[cuts]
    cuts = offsets[offsets > 0] - 1
    last[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    return binaries(data[inside], borders_of(np.flatnonzero(last) + 1 - starts)), starts, np.searchsorted(starts, offsets)


class Bpe:
    """A vocabulary with word ends, read from a tokenizer file with NFC, lower case and a splitting pattern that drops white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._check(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec[_SPECIAL_KEY]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.names = [""] * size
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): x for b, x in enumerate(letters)})
        self.letter_codes = np.array([*map(ord, letters)], np.uint16)
        self.bytes_of_letters = np.zeros(1 << 16, np.uint8)
        self.bytes_of_letters[self.letter_codes] = np.arange(256)
        #: Tokens of single bytes, within a word and at its end; -1 if the vocabulary lacks them.
        self.inner_bytes, self.last_bytes = (np.array([self.vocab.get(x + end, -1) for x in letters], np.int32) for end in ("", self.end))

        #: Of a token made by a merge: its parts, and the merge's rank; of a single letter: -1.
        self.left, self.right, self.rank = (np.full(size, -1, np.int64) for _ in range(3))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = np.zeros(len(model["merges"]), np.int64)
        for r, (a, b) in enumerate(model["merges"]):
            a, b, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            pairs[r] = a * size + b
            if (a, b) not in self.merges:
                self.merges[a, b] = (r, made)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, r
        self.pair_order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.pair_order]
        self.size = size
        self.sound = self._sound_tokens()
        self.made = np.zeros(len(pairs), np.int32)
        for r, made in self.merges.values():
            self.made[r] = made
        self.matcher = ahocorasick.Automaton()
        self.lengths = np.zeros(size, np.int64)
        for name, i in self.vocab.items():
            ending = name.endswith(self.end)
            key = name.removesuffix(self.end) + _STOP if ending else name
            self.matcher.add_word(key, i)
            self.lengths[i] = len(key)
        self.matcher.make_automaton()
        #: Whether the splitting pattern leaves runs of small letters whole, and which marks it parts from them.
        letters = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        runs = ["".join(letters) * 3, *letters, *(x + y for x in letters for y in letters)]
        self.whole_letters = all(self.pattern.findall(r) == [r] for r in runs)
        self.plain_letters = frozenset(letters)
        self.parted = frozenset(m for m in _PLAIN_ENDS if all(self.pattern.findall(x + m) == [x, m] for x in letters))
        #: The same for bytes: small letters of ASCII, and second bytes of small Latin-1 letters after 0xC3, each by the byte of either case.
        self.mark_bytes = np.isin(np.arange(256), [*map(ord, self.parted)])
        self.small, self.small_second = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
        for c in map(ord, letters):
            for form in {chr(c), chr(c).upper()}:
                if len(form) == 1 and form.lower() == chr(c) and ord(form) < 0x100:
                    (self.small if c < 0x80 else self.small_second)[form.encode()[-1]] = chr(c).encode()[-1]
        self.name_column = pa.array(self.names, pa.large_string())

    @staticmethod
    def _check(spec: dict) -> None:
        model = spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        forms = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if not plain or not model["end_of_word_suffix"] or forms != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("this tokenizer file needs a form of encoding that is not built here")

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs of tokens, ``_NEVER`` where there is none."""
        key = a * self.size + b
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[place] == key, self.pair_order[place], _NEVER)

    def _crossed(self, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For pairs of neighbouring tokens: whether some merge of rank less than ``before`` would join a part of one with a part of the other.

        Parts at the border are undone from the last merge to the first. Two parts that stand side by side at some time
        are merged if their merge ranks before the merge that either takes part in within its own token; of equal ranks the left one is first.
        """
        out = np.zeros(len(a), bool)
        a, b, at = a.copy(), b.copy(), np.arange(len(a))
        limit_a, limit_b = before.copy(), before.copy()
        while len(at):
            rank = self._ranks(a, b)
            crossed = (rank < limit_a) & (rank <= limit_b)
            out[at[crossed]] = True
            rank_a, rank_b = self.rank[a], self.rank[b]
            going = ~crossed & ((rank_a >= 0) | (rank_b >= 0))
            undo_a = rank_a > rank_b
            limit_a, limit_b = np.where(undo_a, rank_a, limit_a), np.where(undo_a, limit_b, rank_b)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            a, b, limit_a, limit_b, at = (x[going] for x in (a, b, limit_a, limit_b, at))
        return out

    def _sound_tokens(self) -> np.ndarray:
        """Tokens that encode their own text; others must not be proposed as they stand."""
        made = np.flatnonzero(self.rank >= 0)
        crossed = np.zeros(self.size, bool)
        crossed[made] = self._crossed(self.left[made], self.right[made], self.rank[made])
        sound = ~crossed
        for t in made[np.argsort(self.rank[made])].tolist():
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        return sound

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbouring tokens stay as they are: tested once per distinct pair, all pairs at a time."""
        pairs, which = np.unique(a * self.size + b, return_inverse=True)
        left, right = pairs // self.size, pairs % self.size
        return ~self._crossed(left, right, np.full(len(pairs), np.iinfo(np.int64).max))[which]

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches over words in byte letters: tokens, the word of each, and the words that they do not cover."""
        return self._propose(*self._bytes(words))

    def _bytes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words in byte letters as bytes, one after the other, and their borders."""
        codes = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
        return self.bytes_of_letters[codes], borders_of(np.fromiter(map(len, words), np.int64, len(words)))

    def _propose(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words are matched in one string. A token that ends a word holds its stop; a word whose last match leaves the stop over is not covered."""
        text = np.insert(self.letter_codes[data], offsets[1:], ord(_STOP)).tobytes().decode("utf-16-le")
        found = np.fromiter(chain.from_iterable(self.matcher.iter_long(text)), np.int64).reshape(-1, 2)
        ends, tokens = found[:, 0] + 1, found[:, 1]
        last = offsets[1:] + np.arange(1, len(offsets))
        owner = np.searchsorted(last, ends, side="left")
        starts = ends - self.lengths[tokens]
        expected = np.concatenate(([0], ends[:-1]))
        broken = np.ones(len(last), bool)
        broken[owner[ends == last[owner]]] = False
        broken[owner[starts != expected]] = True
        return tokens, owner, broken

    def merge(self, words: list[str]) -> list[list[int]]:
        """Exact merging in order of rank, leftmost first: all short words at a time, one merge of each per step; long ones on their own."""
        return self._lists(*self._merge(*self._bytes(words), np.arange(len(words))))

    @staticmethod
    def _lists(flat: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        tokens, borders = flat.tolist(), borders_of(sizes).tolist()
        return [tokens[a:b] for a, b in zip(borders, borders[1:])]

    def _merge(self, data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the given words, one after the other, and how many each has."""
        starts, lengths = offsets[:-1][words], np.diff(offsets)[words]
        singles = self.inner_bytes[data]
        singles[offsets[1:] - 1] = self.last_bytes[data[offsets[1:] - 1]]
        if (lacking := singles[spread(starts, lengths)] < 0).any():
            raise KeyError(f"{int(lacking.sum())} bytes of the words have no token")
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        room = -(-lengths // 4) * 4
        for length in np.unique(room[lengths <= _SHORT]).tolist():
            every = np.flatnonzero(room == length)
            for low in range(0, len(every), _ROWS):
                rows = every[low : low + _ROWS]
                parts.append((rows, *self._merge_short(singles, starts[rows], lengths[rows].copy(), length)))
        for i in np.flatnonzero(lengths > _SHORT).tolist():
            own = self._merge_long(singles[starts[i] : starts[i] + lengths[i]].tolist())
            parts.append((np.array([i]), np.array(own, np.int32), np.array([len(own)])))
        sizes = np.zeros(len(words), np.int64)
        for rows, _, n in parts:
            sizes[rows] = n
        places = borders_of(sizes)
        flat = np.zeros(places[-1], np.int32)
        for rows, own, n in parts:
            flat[spread(places[rows], n)] = own
        return flat, sizes

    def _merge_short(self, singles: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """One row per word, as its tokens and the ranks of neighbouring pairs; the least rank of each row is merged until none has one."""
        words = len(starts)
        held = np.zeros((words, length + 1), np.int32)
        held[np.arange(length + 1) < sizes[:, None]] = singles[spread(starts, sizes)]
        never = np.int32(len(self.pairs))
        rank_of = lambda a, b: np.minimum(self._ranks(a.astype(np.int64), b), never).astype(np.int32)
        ranks = np.full((words, length), never, np.int32)
        some = np.arange(1, length + 1) < sizes[:, None]
        ranks[some] = rank_of(held[:, :-1][some], held[:, 1:][some])
        every, at = held.copy(), np.arange(words)
        cells = np.arange(length)
        while len(at):
            i = np.argmin(ranks, axis=1)
            row = np.arange(len(at))
            least = ranks[row, i]
            if not (open_ := least < never).all():
                every[at[~open_]] = held[~open_]
                at, held, ranks, i, least = at[open_], held[open_], ranks[open_], i[open_], least[open_]
                row = row[: len(at)]
            later = cells > i[:, None]
            np.copyto(held[:, :-1], held[:, 1:].copy(), where=later)
            held[row, i] = self.made[least]
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=later[:, :-1])
            ranks[:, -1] = never
            sizes[at] -= 1
            left, right = np.flatnonzero(i > 0), np.flatnonzero(i + 1 < sizes[at])
            ranks[row, i] = never
            a, b = np.concatenate((row[left], row[right])), np.concatenate((i[left] - 1, i[right]))
            ranks[a, b] = rank_of(held[a, b], held[a, b + 1])
        return every[np.arange(length + 1) < sizes[:, None]], sizes

    def _merge_long(self, tokens: list[int]) -> list[int]:
        before, after = list(range(-1, len(tokens) - 1)), list(range(1, len(tokens) + 1))
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(tokens, tokens[1:])) if p in self.merges]
        heapq.heapify(heap)
        alive = [True] * len(tokens)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(tokens) or (tokens[i], tokens[j]) != pair:
                continue
            tokens[i], alive[j] = self.merges[pair][1], False
            after[i] = after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(tokens) and (tokens[x], tokens[y]) in self.merges:
                    heapq.heappush(heap, (self.merges[tokens[x], tokens[y]][0], x, (tokens[x], tokens[y])))
        return [t for t, own in zip(tokens, alive) if own]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Words in byte letters to tokens."""
        return self._lists(*self.encode_bytes(*self._bytes(words))) if words else []

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words to tokens, and how many each has: proposals whose tokens and neighbours all pass stand, all others are merged exactly."""
        words = len(offsets) - 1
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat, owner, failed = self._propose(data, offsets)
        failed[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero((owner[1:] == owner[:-1]) & ~failed[owner[1:]])
        if len(inner):
            failed[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        again = np.flatnonzero(failed)
        merged, merged_sizes = self._merge(data, offsets, again)
        stands = ~failed[owner]
        sizes = np.bincount(owner[stands], minlength=words)
        sizes[again] = merged_sizes
        places = borders_of(sizes)
        out = np.zeros(places[-1], np.int32)
        stood = np.flatnonzero(~failed)
        out[spread(places[stood], sizes[stood])] = flat[stands]
        out[spread(places[again], merged_sizes)] = merged
        return out, sizes

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces without white space, as bytes, to tokens, and how many each has. Each distinct word is encoded once.

        Runs of plain letters, with or without a mark at the end, are split all at once; :meth:`split_plainly` does all others.
        """
        data, offsets = bytes_of(pieces)
        ends = offsets[1:] - 1
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        lowered = np.where(after, self.small_second[data], self.small[data])
        lead = data == 0xC3
        lowered[lead] = 0xC3
        lowered[ends[lead[ends]]] = 0  # cut off
        marked = self.mark_bytes[data[ends]]
        lowered[ends[marked]] = data[ends[marked]]
        wrong = borders_of(lowered == 0)
        plain = (wrong[offsets[1:]] == wrong[offsets[:-1]]) & self.whole_letters
        lengths = np.diff(offsets)
        two = marked[plain] & (lengths[plain] > 1)
        places = borders_of(lengths[plain])
        words = [binaries(lowered[np.repeat(plain, lengths)], np.sort(np.concatenate((places, places[1:][two] - 1))))]
        counts = np.zeros(len(pieces), np.int64)
        counts[plain] = 1 + two
        rest = np.flatnonzero(~plain)
        parts = [self.split_plainly(p.decode()) for p in pieces.take(pa.array(rest)).to_pylist()]
        counts[rest] = [*map(len, parts)]
        every = [*chain.from_iterable(parts)]
        words.append(pa.array([w.encode() if isinstance(w, str) else b"" for w in every], pa.large_binary()))
        coded = pa.concat_arrays(words).dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        distinct, borders = bytes_of(coded.dictionary)
        special = sorted({w for w in every if not isinstance(w, str)})
        if special:  # they stand as empty words, which no text has, and get rows of their own
            which[len(words[0]) + np.array([k for k, w in enumerate(every) if not isinstance(w, str)])] = [len(borders) - 1 + special.index(w) for w in every if not isinstance(w, str)]
        real = np.diff(borders) > 0
        flat, some = self.encode_bytes(distinct, np.concatenate(([0], borders[1:][real])))
        sizes = np.zeros(len(real) + len(special), np.int64)
        sizes[: len(real)][real] = some
        sizes[len(real) :] = 1
        flat = np.concatenate((flat, np.array(special, np.int32)))
        order = np.concatenate((np.flatnonzero(np.repeat(plain, counts)), np.flatnonzero(np.repeat(~plain, counts))))
        rows = np.empty(len(which), np.int64)
        rows[order] = which
        per_word = sizes[rows]
        return flat[spread(borders_of(sizes)[rows], per_word)], np.diff(borders_of(per_word)[borders_of(counts)])

    def split(self, text: str) -> list[str | int]:
        """A text's words in byte letters, and the ids of special tokens that it spells out."""
        if self.whole_letters and text and self.plain_letters.issuperset(bare := (text[:-1] if text[-1] in self.parted else text).lower()):
            parts = ([bare] if bare else []) + ([text[-1]] if len(text) > len(bare) else [])
        else:
            parts = self.split_plainly(text)
        return [w.encode().decode("latin-1").translate(self.letters) if isinstance(w, str) else w for w in parts]

    def split_plainly(self, text: str) -> list[str | int]:
        """A text's words, and the ids of special tokens that it spells out, by the splitting pattern."""
        out: list[str | int] = []
        for piece in self.special_pattern.split(text) if self.special_pattern and "<" in text else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")  # sigma has one lower case here
                out.extend(self.pattern.findall(piece.lower()))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Names of the tokens, special ones too, joined by spaces: what a file without a decoder gives."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode_all(self, flat: np.ndarray, borders: np.ndarray) -> pa.Array:
        """The same for many texts, whose tokens lie between the borders."""
        names = self.name_column.take(pa.array(flat))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(borders, pa.int64()), names), pa.scalar(" ", pa.large_string())).cast(pa.string())


class PieceEncoder:
    """Encodes pieces without white space, keeping those of the last two generations of distinct pieces."""

    def __init__(self, bpe: Bpe, keep: int = 100_000):
        self.bpe, self.keep = bpe, keep
        self.new: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(bpe.size))  # one object per token, for all that is remembered
        #: What ``columns`` remembers: distinct pieces, their tokens one after the other, how many each has, and which were met in this generation.
        self.held = pa.array([], pa.large_binary())
        self.held_flat, self.held_sizes, self.met = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def columns(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many pieces, one after the other, and how many each has. No piece becomes an object unless the splitting pattern has to see it."""
        row = self._rows(pieces)
        sizes = self.held_sizes[row]
        return self.held_flat[spread(borders_of(self.held_sizes)[row], sizes)], sizes

    def counts(self, pieces: pa.Array) -> np.ndarray:
        """How many tokens each of many pieces has."""
        row = self._rows(pieces)
        return self.held_sizes[row]

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece stands among those that are remembered, after new ones have been encoded."""
        coded = pieces.dictionary_encode()
        if self.met.sum() > self.keep:
            flat_met = np.repeat(self.met, self.held_sizes)
            self.held, self.held_flat, self.held_sizes = self.held.filter(pa.array(self.met)), self.held_flat[flat_met], self.held_sizes[self.met]
            self.met = np.zeros(len(self.held), bool)
        row = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.held), -1).to_numpy().astype(np.int64)
        missing = row < 0
        row[missing] = len(self.held) + np.arange(missing.sum())
        new = coded.dictionary.filter(pa.array(missing))
        flat, sizes = self.bpe.encode_pieces(new)
        self.held = pa.concat_arrays([self.held, new])
        self.held_flat, self.held_sizes = np.concatenate((self.held_flat, flat)), np.concatenate((self.held_sizes, sizes))
        self.met = np.concatenate((self.met, np.ones(len(new), bool)))
        self.met[row] = True
        return row[coded.indices.to_numpy()]

    def __call__(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of each piece. Nothing here makes cycles, so the collector need not search some hundred thousand remembered tuples for them."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(pieces)
        finally:
            if collects:
                gc.enable()

    def _encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        if len(self.new) > self.keep:
            self.old, self.new = self.new, {}
        missing = []
        for p in set(pieces).difference(self.new):
            known = self.old.get(p)
            if known is None:
                missing.append(p)
            else:
                self.new[p] = known
        if missing:
            split = [self.bpe.split(p.decode()) for p in missing]
            fresh = list({w for parts in split for w in parts if isinstance(w, str) and w not in self.words})
            if len(self.words) > self.keep:
                self.words = {}
                fresh = list({w for parts in split for w in parts if isinstance(w, str)})
            number = self.numbers.__getitem__
            self.words.update(zip(fresh, (tuple(map(number, own)) for own in self.bpe.encode_words(fresh))))
            for p, parts in zip(missing, split):
                whole = len(parts) == 1 and isinstance(parts[0], str)
                self.new[p] = self.words[parts[0]] if whole else tuple(t for w in parts for t in (self.words[w] if isinstance(w, str) else (w,)))
        return list(map(self.new.__getitem__, pieces))


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    return PieceEncoder(Bpe(path))
