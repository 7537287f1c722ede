"""Prediction by partial matching: a byte-context trie with escapes (method C) and symbol exclusion scores whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm import ngrams, packets
from hearthstat.llm.ngrams import add_up, group_sums, look_up
from hearthstat.llm.shared import save
from hearthstat.llm.words import Words, lower_ascii

CONTEXT = 5
_GRAM, _LOW, _WORD, _TOTAL = 0, 1, 2, 3


class LowOrders:
    """Contexts of two, one and no bytes: at most 2 ** 24 counts, whatever the corpus is."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.pairs, self.total, self.kinds, self.shared = {}, {}, {}, {}
        for j in (2, 1, 0):
            own = keys & np.uint64((1 << 8 * (j + 1)) - 1)
            self.pairs[j] = add_up(own, counts)
            pair, number = self.pairs[j]
            context = (pair >> np.uint64(8)).astype(np.int64)
            self.total[j] = np.bincount(context, weights=number, minlength=1 << 8 * j)
            self.kinds[j] = np.bincount(context, minlength=1 << 8 * j)
        for j in (1, 0):  # of a context of j bytes: the counts of the symbols that the context one byte longer has, too
            pair, _ = self.pairs[j + 1]
            below = look_up(*self.pairs[j], pair & np.uint64((1 << 8 * (j + 1)) - 1))
            self.shared[j] = np.bincount((pair >> np.uint64(8)).astype(np.int64), weights=below, minlength=1 << 8 * (j + 1))


def costs(keys: np.ndarray, counts: np.ndarray, context: int, low: LowOrders) -> np.ndarray:
    """log10 probability of the last byte of each n-gram after its other bytes.

    ``keys`` holds all n-grams of the corpus, and of the texts to score, whose three bytes before the last are the same; a count
    is 0 where the training texts do not have it. From the longest context down: a symbol seen there has count / (total + kinds);
    if not, the escape kinds / (total + kinds) leads to the next shorter context, where symbols of the longer one are left out.
    """
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    shared = np.zeros(len(keys))
    longer = np.zeros(len(keys))
    for j in range(context, -1, -1):
        pairs = keys & np.uint64((1 << 8 * (j + 1)) - 1)
        if j > 2:
            distinct, which, number = group_sums(pairs, counts)
            above, of, total, kinds = group_sums(distinct >> np.uint64(8), number, number > 0)
            number, total, kinds = number[which], total[of][which], kinds[of][which]
        else:
            number = look_up(*low.pairs[j], pairs).astype(np.float64)
            above = (pairs >> np.uint64(8)).astype(np.int64)
            total, kinds = low.total[j][above], low.kinds[j][above]
        if j < 2:
            shared = low.shared[j][((keys >> np.uint64(8)) & np.uint64((1 << 8 * (j + 1)) - 1)).astype(np.int64)]
        left, new = total - shared, kinds - longer
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = open_ & (number > 0)
            out[hit] += np.log10(number[hit] / (left[hit] + new[hit]))
            open_ &= ~hit
            escape = open_ & (new > 0)
            out[escape] += np.log10(new[escape] / (left[escape] + new[escape]))
        if j > 2:  # for the next order: counts there of the symbols that this context has
            below = pairs & np.uint64((1 << 8 * j) - 1)
            if j > 3:
                _, at, sums = group_sums(below, counts)
                each = sums[at]
            else:
                each = look_up(*low.pairs[2], below).astype(np.float64)
            first = np.unique(which, return_index=True)[1]
            once = np.zeros(len(keys))
            once[first] = np.where(number[first] > 0, each[first], 0)
            _, of_row, shared = group_sums(pairs >> np.uint64(8), once)
            shared = shared[of_row]
        longer = kinds
    rest = open_ & (longer < 256)
    out[rest] -= np.log10(256 - longer[rest])
    return out


def _merge_grams(asked: list[dict], context: int, low: LowOrders) -> Iterator[tuple]:
    keys = [packets.expand(p["keys"], np.uint64, rising=True) for p in asked]
    whole, counts = add_up(np.concatenate(keys), np.concatenate([packets.expand(p["a"], np.uint32) for p in asked]).astype(np.int64))
    values = costs(whole, counts.astype(np.float64), context, low).astype(np.float32)
    for p, own in zip(asked, keys):
        yield (p["step"], p["part"], p["chunk"], p["n"], None, packets.squeeze(values[np.searchsorted(whole, own)]), None, None)


def _merge_sums(asked: list[dict], reply: bool) -> Iterator[tuple]:
    """Adds counts up. Gives the merged arrays, or answers each packet and tells how many kinds (n) and tokens (chunk) there are."""
    keys = [packets.expand(p["keys"], np.uint64, rising=True) for p in asked]
    whole, counts = add_up(np.concatenate(keys), np.concatenate([packets.expand(p["a"], np.uint32) for p in asked]).astype(np.int64))
    step, part = asked[0]["step"], asked[0]["part"]
    if not reply:
        yield (step, part, 0, len(whole), packets.squeeze(whole, rising=True), packets.squeeze(counts), None, None)
        return
    for p, own in zip(asked, keys):
        yield (step, part, p["chunk"], p["n"], None, packets.squeeze(counts[np.searchsorted(whole, own)]), None, None)
    yield (_TOTAL, part, int(counts.sum()), int((counts > 0).sum()), None, None, None, None)


class _Asked:
    """What a chunk asks: its byte n-grams, its words, and (counts only) its n-grams of three bytes."""

    def __init__(self, chunk: packets.Chunk, train: np.ndarray, context: int, parts: int):
        self.texts = [lower_ascii(np.frombuffer(chunk.text(i), np.uint8)).tobytes() for i in range(len(chunk))]
        learnt = [t for t, own in zip(self.texts, train.tolist()) if own]
        trained, counts = ngrams.count(learnt, context + 1)
        others, _ = ngrams.count([t for t, own in zip(self.texts, train.tolist()) if not own], context + 1)
        self.keys, self.counts = add_up(np.concatenate((trained, others)), np.concatenate((counts, np.zeros(len(others), np.int64))))
        self.order, self.places = ngrams.by_context(self.keys, parts)
        self.low = add_up(trained & np.uint64(0xFFFFFF), counts)
        words = Words(lower_ascii(chunk.data), chunk.offsets)
        self.words, self.which = np.unique(words.hashes, return_inverse=True)
        self.word_counts = np.bincount(self.which, weights=train[words.docs], minlength=len(self.words)).astype(np.uint32)
        self.word_places = packets.split_rising(self.words, parts)
        self.word_docs, self.n_words = words.docs, words.counts

    def rows(self, name: int, parts: int) -> Iterator[tuple]:
        yield from packets.cut(_GRAM, name, self.keys[self.order], self.places, a=self.counts[self.order].astype(np.uint32))
        yield from packets.cut(_WORD, name, self.words, self.word_places, a=self.word_counts)
        if len(self.low[0]):
            order, places = ngrams.by_context(self.low[0] << np.uint64(16), parts)
            yield from packets.cut(_LOW, name, self.low[0][order], places, a=self.low[1][order].astype(np.uint32))


def ppm_scores(docs: DataFrame, train: str = "train", id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """Scores every text under a PPM model and a word unigram model learnt from the rows whose ``train`` column is true.

    Returns ``row`` (a struct of all input columns), ``n_tokens`` (words and one end), ``n_known`` (tokens the training texts
    have), ``train_tokens``, ``base_score`` (add-one unigrams) and ``score``: log10 of the probability that the PPM
    trie, with contexts of up to ``context`` bytes, gives the text's bytes (A-Z in lower case) and its end.

    Each chunk sends its distinct n-grams of ``context`` + 1 bytes with their training counts. All n-grams with the same three
    bytes before the last meet in one range, which therefore knows every context of three bytes and more in full, and answers with the
    finished log probabilities: symbol exclusion included, as that depends on the n-gram alone. Shorter
    contexts are sent to every range; there are at most 2 ** 24 counts of them.

    A null text is empty, and scores its end alone. A null ``train`` is false. Without training rows every byte costs 1 / 256.
    Rows that repeat are scored, and learnt, as often as they stand. Empty tables give empty results.
    """
    parts = packets.ranges_for(docs, text_col)
    flag = lambda chunk: chunk.table[train].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    asked = save(packets.requests(docs, id_col, text_col, lambda chunk, name: _Asked(chunk, flag(chunk), context, parts).rows(name, parts)), "op5-asked")
    rows = packets.answers(asked.where(F.col("step") == _LOW), lambda p: _merge_sums(p, reply=False)).collect()
    held = [packets.expand(bytes(r["keys"]), np.uint64, rising=True) for r in rows], [packets.expand(bytes(r["a"]), np.int64) for r in rows]
    low = docs.sparkSession.sparkContext.broadcast(LowOrders(*(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(held, (np.uint64, np.int64)))))

    words = save(packets.answers(asked.where(F.col("step") == _WORD), lambda p: _merge_sums(p, reply=True)), "op5-words")
    ends = docs.agg(F.count(F.when(F.col(train), 1))).first()[0]
    kinds, tokens = words.where(F.col("step") == _TOTAL).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chunk"), F.lit(0))).first()
    kinds, tokens = kinds + int(ends > 0), tokens + ends
    size = tokens + kinds + 1

    told = packets.answers(asked.where(F.col("step") == _GRAM), lambda p: _merge_grams(p, context, low.value))

    def use(chunk, _, found):
        own = _Asked(chunk, flag(chunk), context, parts)
        values = ngrams.answered(found, _GRAM, own.order, own.places, np.float32)
        known = packets.values_of(found, _WORD, own.word_places, np.int64)[own.which]
        base = np.bincount(own.word_docs, weights=np.log10(known + 1.0), minlength=len(chunk)) + log10(ends + 1)
        n_tokens = own.n_words + 1
        return pa.table({
            "row": packets.whole_rows(chunk.table),
            "n_tokens": n_tokens,
            "n_known": np.bincount(own.word_docs, weights=known > 0, minlength=len(chunk)).astype(np.int64) + int(ends > 0),
            "train_tokens": np.full(len(chunk), tokens, np.int64),
            "base_score": base - n_tokens * log10(size),
            "score": ngrams.sums_per_text(own.texts, context + 1, own.keys, values),
        })

    schema = T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return packets.meet(packets.packs(docs, id_col, text_col), told.unionByName(words.where(F.col("step") == _WORD)), text_col, use, schema)


def adaptive_score(text: bytes, context: int = CONTEXT) -> float:
    """log10 probability of a text and its end under a trie that starts empty and learns from each byte after coding it."""
    trie: dict[bytes, dict[int, int]] = {}
    seen = bytes([ngrams.BEFORE]) * context
    total = 0.0
    for symbol in [*text, ngrams.END]:
        excluded: set[int] = set()
        for j in range(context, -1, -1):
            node = {s: c for s, c in trie.get(seen[len(seen) - j :], {}).items() if s not in excluded}
            if not node:
                continue
            weight = sum(node.values()) + len(node)
            if symbol in node:
                total += log10(node[symbol] / weight)
                break
            total += log10(len(node) / weight)
            excluded |= node.keys()
        else:
            total -= log10(256 - len(excluded))
        for j in range(context + 1):
            node = trie.setdefault(seen[len(seen) - j :], {})
            node[symbol] = node.get(symbol, 0) + 1
        seen = (seen + bytes([symbol]))[-context:] if context else b""
    return total


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (~held).alias("train"))
    return ppm_scores(docs).select(F.col("row.doc_id").alias("doc_id"), (~F.col("row.train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
