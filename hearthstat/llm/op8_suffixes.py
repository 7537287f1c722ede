"""Removal of repeated byte strings by a sparse suffix array over sampled anchors, range-partitioned and sorted in buckets.

Every string of ``length`` bytes holds ``length - gram + 1`` grams; the one of least hash, the leftmost of equals, is its
anchor. Equal strings have their anchor at the same offset, so comparing the suffixes that start at anchors, with the
``length - gram`` bytes before them, finds every repeat, while only about one position in 26 is an anchor. Suffixes whose
leading gram stands nowhere else are dropped before anything is moved.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm import packets
from hearthstat.llm.packets import Chunk, Earliest
from hearthstat.llm.shared import save, text_bytes
from hearthstat.llm.words import mix, per_text, powers

LENGTH = 100
GRAM = 50
HOT = 20_000
SAMPLE_BYTES = 32 << 20
_BLOCK = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E6D62D06F6A9A9B
_PRESENCE, _SUFFIX, _STRING = 0, 1, 2


class Anchors:
    """Anchors of a chunk: their places ``at``, the starts ``low`` .. ``high`` of the strings they stand for, and gram hashes."""

    def __init__(self, chunk: Chunk, length: int, gram: int):
        data, offsets = chunk.data, chunk.offsets
        whole = np.zeros(len(data) + 1, np.int8)
        long = np.diff(offsets) >= length
        whole[offsets[:-1][long]] += 1
        whole[offsets[1:][long] - length + 1] -= 1
        starts = np.cumsum(whole[:-1], dtype=np.int8).view(bool)
        window = length - gram + 1
        ahead, back = powers(_BASE, _BLOCK + length), powers(pow(_BASE, -1, 1 << 64), _BLOCK + length)
        at, low, high, grams = [], [], [], []
        for x in range(0, len(data), _BLOCK):
            own = np.flatnonzero(starts[x : x + _BLOCK])
            if not len(own):
                continue
            block = data[x : x + _BLOCK + length - 1]
            with np.errstate(over="ignore"):
                sums = np.concatenate(([np.uint64(0)], np.cumsum((block.astype(np.uint64) + np.uint64(1)) * ahead[: len(block)], dtype=np.uint64)))
                hashes = mix((sums[gram:] - sums[:-gram]) * back[: len(block) - gram + 1])
            least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
            size = 1
            while size * 2 <= window:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if rest := window - size:
                least = np.minimum(least[:-rest], least[rest:])
            place = (least[own] & _PLACE).astype(np.int64)
            new = np.ones(len(own), bool)
            new[1:] = place[1:] != place[:-1]
            first = np.flatnonzero(new)
            at.append(place[first] + x)
            grams.append(hashes[place[first]])
            low.append(own[first] + x)
            high.append(own[np.append(first[1:], len(own)) - 1] + x)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        at, low, high, grams = join(at, np.int64), join(low, np.int64), join(high, np.int64), join(grams, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]  # a run that a block border has cut is one again
        first = np.flatnonzero(new)
        self.at, self.low, self.hashes = at[first], low[first], grams[first]
        self.high = high[np.append(first[1:], len(at)) - 1] if len(at) else high
        self.docs = np.searchsorted(offsets, self.at, side="right") - 1


class Leading:
    """The distinct gram keys of a chunk's anchors and how often it has them."""

    def __init__(self, anchors: Anchors, parts: int):
        self.keys, self.which, self.count = np.unique(mix(anchors.hashes + np.uint64(1)) >> np.uint64(16), return_inverse=True, return_counts=True)
        self.places = packets.split_rising(self.keys, parts, bits=48)

    def ask(self, name: int) -> Iterator[tuple]:
        return packets.cut(_PRESENCE, name, self.keys, self.places, a=self.count.astype(np.uint32))

    def codes(self, found: dict) -> np.ndarray:
        """For each anchor: 0 if its gram stands nowhere else, 1 if it does, 2 if very often."""
        return packets.values_of(found, _PRESENCE, self.places, np.uint8)[self.which]


def merge_counts(asked: list[dict], hot: int) -> Iterator[tuple]:
    keys = [packets.expand(p["keys"], np.uint64, rising=True) for p in asked]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([packets.expand(p["a"], np.uint32) for p in asked]))
    code = ((total > 1).astype(np.uint8) + (total >= hot).astype(np.uint8))[which]
    at = 0
    for p, own in zip(asked, keys):
        yield (p["step"], p["part"], p["chunk"], p["n"], None, packets.squeeze(code[at : at + len(own)]), None, None)
        at += len(own)


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Stable order of equally long byte rows by multikey quicksort on tokens of 8 bytes: only ties go on to the next token."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    tokens = padded.view(">u8").astype(np.uint64)
    order = np.arange(n)
    group = np.zeros(n, np.int64)
    tied = np.arange(n)
    for c in range(tokens.shape[1]):
        if not len(tied):
            break
        own = order[tied]
        token = tokens[own, c]
        within = np.lexsort((token, group[tied]))
        order[tied] = own[within]
        token, held = token[within], group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (token[1:] != token[:-1]) | (held[1:] != held[:-1])
        heads = np.flatnonzero(new)
        group[tied] = tied[heads][np.cumsum(new) - 1]
        alone = np.diff(np.append(heads, len(tied))) == 1
        tied = tied[~alone[np.cumsum(new) - 1]]
    return order


def contexts(chunk: Chunk, anchors: Anchors, some: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Byte rows of anchors: the suffix (``length`` bytes), the bytes before it backwards, and how many of either the text has."""
    side = length - gram
    out = np.zeros((len(some), length + side + 2), np.uint8)
    steps = np.concatenate((np.arange(length), -1 - np.arange(side)))
    for x in range(0, len(some), 8192):
        own = some[x : x + 8192]
        at, low, high = anchors.at[own], chunk.offsets[anchors.docs[own]], chunk.offsets[anchors.docs[own] + 1]
        places = at[:, None] + steps
        inside = (places >= low[:, None]) & (places < high[:, None])
        out[x : x + 8192, :-2] = np.where(inside, chunk.data[np.where(inside, places, 0)], 0)
        out[x : x + 8192, -2] = np.minimum(high - at, length)
        out[x : x + 8192, -1] = np.minimum(at - low, side)
    return out


def _new_rows(rows: np.ndarray, upto: int) -> np.ndarray:
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :upto] != rows[:-1, :upto]).any(axis=1)
    return new


class Suffixes:
    """Repeated anchors of a chunk as sorted suffixes; equal ones with equal bytes before them are one class, asked about once."""

    def __init__(self, chunk: Chunk, anchors: Anchors, codes: np.ndarray, ids: np.ndarray, splitters: np.ndarray, length: int, gram: int):
        some = np.flatnonzero(codes == 1)
        place = anchors.at[some] - chunk.offsets[anchors.docs[some]]
        by_place = np.lexsort((place, ids[anchors.docs[some]]))
        some, place = some[by_place], place[by_place]
        rows = contexts(chunk, anchors, some, length, gram)
        order = multikey_order(rows)
        rows, self.some, self.place = rows[order], some[order], place[order]
        self.ids = ids[anchors.docs[self.some]]
        new = _new_rows(rows, rows.shape[1])
        self.heads, self.which = np.flatnonzero(new), np.cumsum(new) - 1
        self.rows = rows[self.heads]
        leading = np.ascontiguousarray(self.rows[:, :gram]).view(f"S{gram}").reshape(-1)
        self.places = np.concatenate(([0], np.searchsorted(leading, splitters), [len(leading)])).astype(np.int64)
        own = self.some[self.heads]
        self.span = np.stack((anchors.at[own] - anchors.high[own], anchors.at[own] - anchors.low[own]), axis=1).astype(np.uint8)

    def ask(self, name: int) -> Iterator[tuple]:
        for part in np.flatnonzero(np.diff(self.places)).tolist():
            s = slice(self.places[part], self.places[part + 1])
            body = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(self.rows[s]).tobytes())
            head = self.heads[s]
            yield (_SUFFIX, part, name, len(head), body, packets.squeeze(self.ids[head].astype(np.int64)), packets.squeeze(self.place[head].astype(np.int64)), self.span[s].tobytes())


def repeated_offsets(rows: np.ndarray, ids: np.ndarray, place: np.ndarray, span: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each row, as bits, the offsets at which its string stands at a smaller id or place in another row of equal gram."""
    side = length - gram
    order = multikey_order(rows)
    new = _new_rows(rows[order], gram)
    group = np.cumsum(new) - 1
    sizes = np.bincount(group, minlength=1)
    rank = np.empty(len(rows), np.int64)
    rank[np.lexsort((place, ids))] = np.arange(len(rows))
    bits = np.zeros(len(rows), np.uint64)
    many = np.flatnonzero(sizes[group] > 1)
    at = 0
    while at < len(many):
        end = min(at + 16384, len(many))
        while end < len(many) and group[many[end]] == group[many[end - 1]]:
            end += 1
        own = order[many[at:end]]
        with np.errstate(over="ignore"):
            steps = powers(_BASE, side)
            right = np.zeros((len(own), side + 1), np.uint64)
            left = np.zeros((len(own), side + 1), np.uint64)
            np.cumsum((rows[own, gram:length].astype(np.uint64) + np.uint64(1)) * steps, axis=1, out=right[:, 1:])
            np.cumsum((rows[own, length : length + side].astype(np.uint64) + np.uint64(1)) * steps, axis=1, out=left[:, 1:])
            low, high = span[own, 0].astype(np.int64), span[own, 1].astype(np.int64)
            count = high - low + 1
            item = np.repeat(np.arange(len(own)), count)
            offset = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + low[item]
            key = mix(left[item, offset] + np.uint64(0x9E3779B97F4A7C15) * (group[many[at:end]][item].astype(np.uint64) * np.uint64(side + 1) + offset.astype(np.uint64)))
            key = mix(key + right[item, side - offset])
        del left, right
        by = np.lexsort((rank[own[item]], key))
        key, who = key[by], own[item[by]]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        head = who[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        late = (ids[who] != ids[head]) | (place[who] != place[head])
        np.bitwise_or.at(bits, who[late], np.uint64(1) << offset[by][late].astype(np.uint64))
        at = end
    return bits


def merge_suffixes(asked: list[dict], length: int, gram: int) -> Iterator[tuple]:
    width = 2 * length - gram + 2
    rows = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(p["keys"]), np.uint8).reshape(-1, width) for p in asked])
    ids, place = (np.concatenate([packets.expand(p[c], np.int64) for p in asked]) for c in "ab")
    span = np.concatenate([np.frombuffer(p["c"], np.uint8).reshape(-1, 2) for p in asked])
    bits = repeated_offsets(rows, ids, place, span, length, gram)
    at = 0
    for p in asked:
        yield (p["step"], p["part"], p["chunk"], p["n"], None, packets.squeeze(bits[at : at + p["n"]]), None, None)
        at += p["n"]


class Strings:
    """Every string of the anchors whose gram is too frequent for one bucket, by its hash."""

    def __init__(self, chunk: Chunk, anchors: Anchors, codes: np.ndarray, ids: np.ndarray, length: int, parts: int):
        some = np.flatnonzero(codes == 2)
        count = anchors.high[some] - anchors.low[some] + 1
        item = np.repeat(np.arange(len(some)), count)
        self.at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + anchors.low[some][item]
        docs = anchors.docs[some][item]
        keys = np.zeros(len(self.at), np.uint64)
        steps = powers(_BASE, length)
        with np.errstate(over="ignore"):
            for x in range(0, len(keys), 16384):
                own = chunk.data[self.at[x : x + 16384, None] + np.arange(length)].astype(np.uint64) + np.uint64(1)
                keys[x : x + 16384] = mix((own * steps).sum(axis=1, dtype=np.uint64))
        self.earliest = Earliest(keys, ids[docs], self.at - chunk.offsets[docs], parts)


def _splitters(docs: DataFrame, id_col: str, text_col: str, total: int, parts: int, length: int, gram: int) -> np.ndarray:
    """Quantiles of the leading grams of a sample of documents; the sample's size does not grow with the corpus."""
    share = min(1.0, SAMPLE_BYTES / max(total, 1))

    def run(batches):
        for chunk in packets.chunks(batches, text_col):
            anchors = Anchors(chunk, length, gram)
            some = np.flatnonzero(mix(anchors.hashes) % np.uint64(64) == 0)
            yield pa.RecordBatch.from_arrays([pa.array([chunk.data[x : x + gram].tobytes() for x in anchors.at[some].tolist()], pa.binary())], names=["gram"])

    seen = sorted({bytes(r[0]) for r in docs.sample(share, 17).mapInArrow(run, "gram binary").collect()})
    return np.array(sorted({seen[len(seen) * k // parts] for k in range(1, parts)}) if seen else [], dtype=f"S{gram}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier is: in a document of smaller id, or in the same document at an earlier byte. Strings are judged on the input and
    do not cross documents. Returns ``row`` (a struct of all input columns), ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept`` (the remaining bytes; they need not be whole characters).

    1. The grams of all anchors are counted; an anchor whose gram is alone in the corpus cannot be in a repeat.
    2. The other suffixes go to buckets by their leading ``gram`` bytes, at splitters from a bounded sample. A bucket
       sorts its suffixes by multikey quicksort and compares, offset by offset, those with equal leading bytes.
    3. No group of equal leading bytes lies across a bucket border. A gram that stands ``hot`` times or more would make its bucket
       too large: its strings are compared across all buckets, by hash, in ranges of the hash.

    Null texts are empty. Null ids come last; rows that repeat an id are the same document, and a string at the same place
    of both is no repeat of itself. Empty tables give empty results.
    """
    if not 0 < length - gram <= 60 or length > 255:
        raise ValueError("length may exceed gram by 60 bytes at most, and be 255 at most")
    total, parts = text_bytes(docs, text_col), packets.ranges_for(docs, text_col)
    splitters = _splitters(docs, id_col, text_col, total, parts, length, gram)
    packed = packets.packs(docs, id_col, text_col)

    def merge(asked: list[dict]) -> Iterable[tuple]:
        step = asked[0]["step"]
        return merge_counts(asked, hot) if step == _PRESENCE else merge_suffixes(asked, length, gram) if step == _SUFFIX else packets.merge_earliest(asked)

    told = save(packets.answers(packets.requests(docs, id_col, text_col, lambda chunk, name: Leading(Anchors(chunk, length, gram), parts).ask(name)), merge), "op8-grams")

    def state(chunk, found):
        anchors = Anchors(chunk, length, gram)
        codes, ids = Leading(anchors, parts).codes(found), chunk.ids(id_col)
        return anchors, Suffixes(chunk, anchors, codes, ids, splitters, length, gram), Strings(chunk, anchors, codes, ids, length, parts)

    def ask(chunk, name, found):
        _, suffixes, strings = state(chunk, found)
        return packets.rows_table([*suffixes.ask(name), *strings.earliest.ask(_STRING, name)])

    answered = packets.answers(packets.meet(packed, told, text_col, ask, packets.REQUEST), merge)

    def use(chunk, _, found):
        anchors, suffixes, strings = state(chunk, found)
        edges = np.zeros(len(chunk.data) + 1, np.int32)

        def remove(low, high):
            np.add.at(edges, low, 1)
            np.add.at(edges, high + length, -1)

        if len(suffixes.some):
            head = suffixes.heads[suffixes.which]
            copy = (suffixes.ids != suffixes.ids[head]) | (suffixes.place != suffixes.place[head])
            own = suffixes.some[copy]
            remove(anchors.low[own], anchors.high[own])
            bits = packets.values_of(found, _SUFFIX, suffixes.places, np.uint64)[suffixes.which]
            for offset in range(length - gram + 1):
                starts = anchors.at[suffixes.some[(bits >> np.uint64(offset)) & np.uint64(1) == 1]] - offset
                remove(starts, starts)
        starts = strings.at[strings.earliest.later(found, _STRING)]
        remove(starts, starts)
        gone = np.cumsum(edges[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        cuts = chunk.offsets[:-1][chunk.offsets[:-1] < len(gone)]
        first[cuts] = gone[cuts]
        lost, spans = per_text(gone, chunk.offsets), per_text(first, chunk.offsets)
        kept = [chunk.data[a:b][~gone[a:b]].tobytes() if x else chunk.data[a:b].tobytes() for a, b, x in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), lost.tolist())]
        return pa.table({"row": packets.whole_rows(chunk.table), "n_bytes": np.diff(chunk.offsets), "n_removed": lost, "n_spans": spans, "kept": pa.array(kept, pa.binary())})

    schema = T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary").fields])
    return packets.meet(packed, told.unionByName(answered), text_col, use, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
