"""Token counts that follow edits: a segment tree per document over runs of pre-tokens, kept as a table; only touched runs are encoded again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hearthstat.llm.bpe import PieceEncoder, borders_of, bytes_of, cut_pieces, piece_encoder, spread
from hearthstat.llm.op3_bpe import public_file
from hearthstat.llm.packets import chunks
from hearthstat.llm.shared import save

RUN = 64
BLOCK_BYTES = 2 << 20
_SPACES = " \t\n\x0b\f\r"

#: An edit: from which character of the text as it then is, how many characters go, and what comes in their place.
Edit = tuple[int, int, str]
#: A tree's leaves: characters and tokens of each run. Inner nodes are sums of these and are added up when a tree is opened.
_TREE = "text string, chars array<int>, tokens array<int>, n_tokens long"


class SegmentTree:
    """Runs of whole pre-tokens, and per node of a binary tree the characters and tokens below it.

    No token spans white space, and every run but the last ends in it; so a run's tokens do not depend on its neighbours.
    """

    def __init__(self, text: str, chars: list[int], tokens: list[int], encoder: PieceEncoder):
        self.encoder, self.encoded = encoder, 0
        ends = np.cumsum(chars).tolist()
        self.runs = [text[end - n : end] for end, n in zip(ends, chars)]
        self.leaves = 1
        while self.leaves < len(self.runs):
            self.leaves *= 2
        pad = [0] * (self.leaves - len(chars))
        self.chars, self.tokens = ([0] * self.leaves + list(own) + pad for own in (chars, tokens))
        for node in range(self.leaves - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _find(self, place: int) -> tuple[int, int]:
        """The run that holds the character at ``place``, or the last run that has characters; and the offset in it."""
        node, place = 1, max(0, min(place, self.chars[1]))
        while node < self.leaves:
            left = self.chars[2 * node]
            if place < left or not self.chars[2 * node + 1]:
                node *= 2
            else:
                place, node = place - left, 2 * node + 1
        return min(node - self.leaves, len(self.runs) - 1), place

    def _set(self, run: int, text: str) -> None:
        pieces = text.encode().split()
        self.encoded += len(pieces)
        self.runs[run] = text
        node = self.leaves + run
        self.chars[node], self.tokens[node] = len(text), sum(map(len, self.encoder(pieces)))
        while node := node // 2:
            self._add_up(node)

    def edit(self, start: int, length: int, text: str) -> None:
        """Replaces ``length`` characters from ``start`` on, both cut to what there is."""
        start = max(0, min(start, self.chars[1]))
        length = max(0, min(length, self.chars[1] - start))
        first, offset = self._find(start)
        last, end = self._find(start + length)
        if last > first:
            changed = self.runs[first][:offset] + text + self.runs[last][end:]
        else:
            changed, last = self.runs[first][:offset] + text + self.runs[first][offset + length :], first
        # a run that no longer ends in white space takes its right neighbour in: there a piece may go on
        while last + 1 < len(self.runs) and (not changed or changed[-1] not in _SPACES):
            last += 1
            changed += self.runs[last]
        for run in range(first + 1, last + 1):
            self._set(run, "")
        self._set(first, changed)

    @property
    def text(self) -> str:
        return "".join(self.runs)

    @property
    def sums(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the runs."""
        return self.chars[self.leaves : self.leaves + len(self.runs)], self.tokens[self.leaves : self.leaves + len(self.runs)]


def run_sums(data: np.ndarray, offsets: np.ndarray, encoder: PieceEncoder, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in ``data``: how many runs each has, and all runs' characters and tokens. All words are looked up in one call.

    A run is ``run`` words, each with the white space after it, and before it at the text's start; a text without words is one run.
    """
    pieces, starts, before = cut_pieces(data, offsets)
    runs = np.maximum(-(-np.diff(before) // run), 1)
    first = np.repeat(before[:-1], runs) + run * spread(np.zeros(len(runs), np.int64), runs)
    at = np.repeat(offsets[:-1], runs)
    inner = first > np.repeat(before[:-1], runs)
    at[inner] = starts[first[inner]]
    chars = borders_of((data & 0xC0) != 0x80)[np.append(at, len(data))]
    tokens = borders_of(encoder.counts(pieces))[np.append(first, len(pieces))]
    return runs, np.diff(chars), np.diff(tokens)


def tree_sums(texts: list[str], encoder: PieceEncoder, run: int = RUN) -> Iterator[tuple[list[int], list[int]]]:
    """Characters and tokens of every text's runs."""
    runs, chars, tokens = run_sums(*bytes_of(pa.array([t.encode() for t in texts], pa.large_binary())), encoder, run)
    borders = borders_of(runs).tolist()
    for a, b in zip(borders, borders[1:]):
        yield chars[a:b].tolist(), tokens[a:b].tolist()


def build_trees(docs: DataFrame, path: str, carry: list[str], text_col: str = "text", run: int = RUN) -> DataFrame:
    """The table of trees: ``row`` (a struct of the columns in ``carry``), ``text``, the characters and tokens of its runs of ``run`` pieces, and ``n_tokens``.

    Write it once; :func:`edit_trees` takes it, and the updated table again. One pass without a shuffle. A null text is empty. Rows that repeat stand
    for themselves. Empty in, empty out.
    """

    def run_all(batches) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for chunk in chunks(batches, "_text", BLOCK_BYTES):
            runs, chars, tokens = run_sums(chunk.data, chunk.offsets, encoder, run)
            borders = borders_of(runs)
            lists = (pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(own, pa.int32())) for own in (chars, tokens))
            text = _whole(pc.fill_null(chunk.table["_text"], ""))
            yield _trees(_whole(chunk.table["row"]), text, *lists, pa.array(np.diff(borders_of(tokens)[borders]), pa.int64()))

    named = docs.selectExpr(f"struct({', '.join(f'`{c}`' for c in carry)}) AS row", f"`{text_col}` AS _text")
    return named.mapInArrow(run_all, T.StructType([named.schema["row"], *T.StructType.fromDDL(_TREE).fields]))


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _trees(*columns: pa.Array, **more: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(own, pa.int64()) for own in more.values())], names=["row", "text", "chars", "tokens", "n_tokens", *more])


def edit_trees(trees: DataFrame, path: str, edits: str | Callable[[str], Iterable[Edit]], n_edits: str = "n_edits", n_encoded: str = "n_encoded") -> DataFrame:
    """The table of trees after edits, which are applied one after the other, and how many edits and newly encoded pieces each text had.

    ``edits`` gives a text's edits, or names a field of ``row`` that is array<struct<start: int, length: int, text: string>>. A tree's inner sums are
    added up from its leaves. An edit walks down by characters, encodes the touched runs anew (and the next ones, as
    long as a piece goes on over the border), and adds up the sums on the way to the root. Texts without edits are not opened. One pass without a shuffle.

    Null edits are none, and an edit with a null is left out; places outside the text are cut to it. Empty in, empty out.
    """

    def run_all(batches) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            listed = pc.struct_field(column["row"], edits).to_pylist() if isinstance(edits, str) else None
            own = [[(e["start"], e["length"], e["text"]) for e in each or () if e and None not in e.values()] for each in listed] if listed is not None else [list(edits(t)) for t in column["text"].to_pylist()]
            opened = [i for i, each in enumerate(own) if each]
            encoded = [0] * len(own)
            kept = [column[c] for c in ("text", "chars", "tokens", "n_tokens")]
            changed = []
            for i, text, chars, tokens in zip(opened, *(c.take(pa.array(opened, pa.int64())).to_pylist() for c in kept[:3])):
                tree = SegmentTree(text, chars, tokens, encoder)
                for edit in own[i]:
                    tree.edit(*edit)
                changed.append((tree.text, *tree.sums, tree.tokens[1]))
                encoded[i] = tree.encoded
            if opened:
                places = np.arange(len(own))
                places[opened] = len(own) + np.arange(len(opened))
                kept = [pa.concat_arrays([c, pa.array(new, c.type)]).take(pa.array(places)) for c, new in zip(kept, zip(*changed))]
            yield _trees(column["row"], *kept, **{n_edits: [*map(len, own)], n_encoded: encoded})

    given = trees.select("row", *(f.name for f in T.StructType.fromDDL(_TREE)))
    return given.mapInArrow(run_all, T.StructType([*given.schema.fields, *T.StructType.fromDDL(f"`{n_edits}` long, `{n_encoded}` long").fields]))


_PRIVATE = re.compile(r"(?P<mail>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)|(?P<number>[0-9]{9,})")
_MANY_BREAKS = re.compile(r"\n{3,}")


def _replacements(text: str, found: Iterable[re.Match], put: Callable[[re.Match], str]) -> Iterator[Edit]:
    """Edits that put other texts in the place of matches, one after the other."""
    moved = 0
    for m in found:
        new = put(m)
        yield m.start() + moved, m.end() - m.start(), new
        moved += len(new) - (m.end() - m.start())


def redactions(text: str) -> Iterator[Edit]:
    """Edits that put a placeholder in the place of every mail address and every number of nine digits or more."""
    if "@" in text or any(d in text for d in "0123456789"):
        yield from _replacements(text, _PRIVATE.finditer(text), lambda m: "[mail]" if m["mail"] else "[number]")


def plain_ends(text: str) -> Iterator[Edit]:
    """Edits of a second round: three or more line breaks become two, and white space at the text's end goes."""
    last = len(text.rstrip(_SPACES))
    yield from _replacements(text[:last], _MANY_BREAKS.finditer(text, 0, last), lambda m: "\n\n")
    if last < len(text):
        removed = sum(len(m[0]) - 2 for m in _MANY_BREAKS.finditer(text, 0, last))
        yield last - removed, len(text) - last, ""


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees are built once and written; two rounds of edits follow, the second on the trees that the first has updated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = save(build_trees(docs, public_file(), ["doc_id"]), "op6-trees")
    first = edit_trees(trees.selectExpr("struct(row.doc_id AS doc_id, n_tokens AS n_tokens) AS row", "text", "chars", "tokens", "n_tokens"), public_file(), redactions)
    again = first.selectExpr("struct(row.*, n_edits AS n_edits, n_tokens AS n_tokens_after, n_encoded AS n_encoded) AS row", "text", "chars", "tokens", "n_tokens")
    second = edit_trees(again, public_file(), plain_ends, "n_edits_second", "n_encoded_second")
    return second.selectExpr("row.*", "n_edits_second", "n_tokens AS n_tokens_second", "n_encoded_second")
