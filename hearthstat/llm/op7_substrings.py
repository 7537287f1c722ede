"""Substring dedup by level-wise doubling: only windows that repeat at one length are looked at at twice that length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm import packets
from hearthstat.llm.shared import save
from hearthstat.llm.words import Words

LENGTH = 20
FIRST = 10


def _levels(length: int, first: int) -> list[int]:
    """first, 2 first, 4 first ... length."""
    out = [length]
    while out[-1] > first:
        if out[-1] % 2:
            raise ValueError("length must be first times a power of two")
        out.append(out[-1] // 2)
    return out[::-1]


class _Level:
    """The windows of a chunk at one level: the distinct keys it asks about, and which key each window has."""

    def __init__(self, hashes: np.ndarray, alive: np.ndarray, parts: int):
        self.at = np.flatnonzero(alive)
        #: A filter level needs 48 bits: what collides there is told apart at the last level.
        keys = hashes[self.at]
        keys >>= np.uint64(16)
        # as np.unique finds keys, places and counts, in half its room
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.which = np.empty(len(keys), np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order
        heads = np.flatnonzero(new)
        self.keys, self.count = keys[heads], np.diff(heads, append=len(keys))
        self.places = packets.split_rising(self.keys, parts, bits=48)

    def survivors(self, found: dict, step: int, n: int) -> np.ndarray:
        """Windows whose key repeats, in this chunk or in another."""
        out = np.zeros(n, bool)
        out[self.at] = ((self.count > 1) | packets.flags_of(found, step, self.places))[self.which]
        return out


def _windows(words: Words, length: int, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of a length, and which to look at: all, or those of which both halves are ``alive``."""
    hashes, valid = words.windows(length)
    if alive is not None:
        half = np.zeros(len(alive), bool)
        half[: max(0, len(alive) - length // 2)] = alive[length // 2 :]
        valid &= alive & half
    return hashes, valid


def _walk(chunk, levels: list[int], parts: int, id_col: str, found: dict, upto: int):
    """Runs the levels below ``upto`` on the answers found; gives the words and the state of level ``upto``."""
    words = Words(chunk.data, chunk.offsets)
    alive = None
    for k, length in enumerate(levels):
        hashes, valid = _windows(words, length, alive)
        if k == len(levels) - 1:
            at = np.flatnonzero(valid)
            docs = words.docs[at]
            return words, (at, packets.Earliest(hashes[at], chunk.ids(id_col)[docs], at - words.firsts[docs], parts))
        state = _Level(hashes, valid, parts)
        if k == upto:
            return words, state
        alive = state.survivors(found, k, len(valid))
    raise AssertionError


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """Removes every word covered by a window of ``length`` words that also starts earlier.

    Earlier is: in a document of smaller id, or in the same document at an earlier word. Windows are judged on the
    input. Returns ``row`` (a struct of all input columns), ``n_words``, ``n_removed``, and ``kept``: the kept words joined by one space.

    Levels: windows of ``first`` words are counted over the corpus; only where both halves of a window of twice that
    length repeat is it looked at, and so on to ``length``. A level without candidates ends the work of its chunk, and
    no level beyond ``length`` is needed here: a longer repeat is made of repeats of ``length`` words. ``longest_repeats`` goes on until
    no candidate survives.

    A null text has no words. Rows that repeat a document id are the same document: a window at the same place of both is
    no repeat of itself. Null ids come last. Empty tables give empty results; other columns travel in ``row`` unchanged.
    """
    levels, parts = _levels(length, first), packets.ranges_for(docs, text_col)
    packed = packets.packs(docs, id_col, text_col)
    told: DataFrame | None = None
    for k in range(len(levels)):
        last = k == len(levels) - 1

        def ask(chunk, name, found=None, k=k, last=last):
            _, state = _walk(chunk, levels, parts, id_col, found or {}, k)
            if last:
                return state[1].ask(k, name)
            return packets.cut(k, name, state.keys, state.places)

        if told is None:
            asked = packets.requests(docs, id_col, text_col, ask)
        else:
            asked = packets.meet(packed, told, text_col, lambda chunk, name, found, ask=ask: packets.rows_table(ask(chunk, name, found)), packets.REQUEST)
        answered = save(packets.answers(asked, packets.merge_earliest if last else packets.merge_presence), f"op7-level{k}")
        told = answered if told is None else told.unionByName(answered)

    def use(chunk, _, found):
        words, (at, windows) = _walk(chunk, levels, parts, id_col, found, len(levels) - 1)
        starts = at[windows.later(found, len(levels) - 1)]
        edges = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
        gone = np.cumsum(edges[:-1]) > 0
        lost = np.bincount(words.docs[gone], minlength=len(chunk)).astype(np.int64)
        kept = []
        for i in range(len(chunk)):
            own = chunk.text(i).split()
            if lost[i]:
                mask = ~gone[words.firsts[i] : words.firsts[i + 1]]
                own = [own[j] for j in np.flatnonzero(mask).tolist()]
            kept.append(b" ".join(own).decode())
        return pa.table({"row": packets.whole_rows(chunk.table), "n_words": words.counts, "n_removed": lost, "kept": pa.array(kept, pa.string())})

    schema = T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL("n_words long, n_removed long, kept string").fields])
    return packets.meet(packed, told, text_col, use, schema)


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """``row`` (a struct of all input columns) and ``longest``: the greatest of length, 2 length, 4 length ... words at which a window of
    the document stands anywhere a second time; 0 if none does.

    The doubling goes on until no candidate survives: as many rounds as the logarithm of the longest repeat. Odd rows as in ``dedup_substrings``.
    """
    levels, parts = _levels(length, first), packets.ranges_for(docs, text_col)
    packed = packets.packs(docs, id_col, text_col)

    def states(chunk, lengths, found):
        words, alive = Words(chunk.data, chunk.offsets), None
        for k, own in enumerate(lengths):
            hashes, valid = _windows(words, own, alive)
            state = _Level(hashes, valid, parts)
            yield words, state
            if k in found:
                alive = state.survivors(found, k, len(valid))

    told, k = None, 0
    while True:
        lengths = levels + [length * 2**i for i in range(1, max(0, k + 2 - len(levels)))]

        def ask(chunk, name, found=None, lengths=tuple(lengths[: k + 1]), k=k):
            *_, (_, state) = states(chunk, lengths, found or {})
            return packets.cut(k, name, state.keys, state.places, a=(state.count > 1).astype(np.uint8))

        if told is None:
            asked = packets.requests(docs, id_col, text_col, ask)
        else:
            asked = packets.meet(packed, told, text_col, lambda chunk, name, found, ask=ask: packets.rows_table(ask(chunk, name, found)), packets.REQUEST)
        answered = save(packets.answers(asked, packets.merge_presence), f"op7-longest{k}")
        told = answered if told is None else told.unionByName(answered)
        if answered.where(F.regexp_replace(F.hex("a"), "0", "") != "").isEmpty():
            break
        k += 1

    def use(chunk, _, found, lengths=tuple(lengths[: k + 1])):
        longest = np.zeros(len(chunk), np.int64)
        for i, (words, state) in enumerate(states(chunk, lengths, found)):
            if lengths[i] >= length:
                alive = state.survivors(found, i, len(words.docs))
                longest[np.unique(words.docs[alive])] = lengths[i]
        return pa.table({"row": packets.whole_rows(chunk.table), "longest": longest})

    schema = T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL("longest long").fields])
    return packets.meet(packed, told, text_col, use, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: DuckDB SQL of op7_substring_dedup, for tables whose ids do not repeat.
OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), k AS (
    SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20) AS x
), r AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k) AS y WHERE n > 1
), c AS (
    SELECT DISTINCT doc_id, s + o AS i FROM r, (SELECT unnest(range(0, 20)) AS o) AS z
), v AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), t AS (
    SELECT v.doc_id AS doc_id, count(c.i) AS n_removed, coalesce(string_agg(CASE WHEN c.i IS NULL THEN v.word END, ' ' ORDER BY v.i), '') AS kept
    FROM v LEFT JOIN c ON v.doc_id = c.doc_id AND v.i = c.i GROUP BY v.doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
