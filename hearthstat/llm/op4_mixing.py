"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks to sources, then to shards."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthstat.llm.shared import save

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK = 16
LEAST_BLOCKS = 50
SHARD = 1 << 20
SOURCES = 1_000_000
SEED = 41
WORD = r"[^\x20\x09-\x0D]+"


def apportion(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: seats go one by one to the highest quotient votes / (2 given + 1), none above its cap; earlier entries win ties.

    All quotients above 1 / d are given at once, for a d found by bisection; the few left over are ranked.
    """
    votes, caps = np.asarray(votes, np.float64), np.where(np.asarray(votes) > 0, caps, 0).astype(np.int64)
    seats = min(int(seats), int(caps.sum()))

    def given(scale: float) -> np.ndarray:
        return np.minimum(np.floor((votes * scale + 1) / 2).astype(np.int64), caps)  # quotients of at least 1 / scale

    low, high = 0.0, 1.0
    while given(high).sum() < seats:
        high *= 2
    while high - low > 1e-12 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle).sum() <= seats else (low, middle)
    out = given(low * (1 - 1e-12))  # a little less, so that rounding cannot part equal quotients
    heap = [(-v / (2 * n + 1), i) for i, (v, n, c) in enumerate(zip(votes.tolist(), out.tolist(), caps.tolist())) if n < c]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heap[0]
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
        else:
            heapq.heappop(heap)
    return out


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """Targets in tokens: ``share`` of all sizes by weight, none above ``repeats`` times its size; excess is shared again by weight."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / total > repeats * sizes[i]}
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        open_ -= over
        rest -= sum(out[i] for i in over)
    return out


def _give(groups: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Splits the seats of each group among its items by their tokens."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(item)
        frame["given"] = apportion(frame["tokens"].to_numpy(), frame["seats"].iloc[0], frame["most"].to_numpy())
        return frame[[*keys, item, "given"]]

    return groups.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} long" for k in keys), f"{item} long", "given long"]))


def mix(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """How many words of each document a weighted mix takes.

    Returns ``row`` (a struct of the columns in ``carry``), ``size`` (words), ``source_size``, ``target`` (of the source, in words), ``passes`` (whole
    copies) and ``extra`` (words from the document's start in the last, partial pass), ``taken`` = passes * size + extra.

    Sources in code-point order, null last, weigh ``weights`` in turn. Equal blocks go to sources by Sainte-Laguë
    on their targets, then to bundles of shards and to shards by their words. A block has at most ``block`` words, and fewer where the smallest source has
    less than ``LEAST_BLOCKS`` of them: down to one word, so a small source comes as near to its target as a large one. A shard holds about ``shard`` words of
    one source, dealt by a seeded hash of the id and text; its documents are laid end to end in seeded order, ``repeats`` times over, and cut into blocks, of which its quota takes
    the first: whole passes, then part of one. So a source's words differ from its target by about a block, and only one document per shard is cut.
    A source that is to be taken as often as may be is taken whole.

    Bounds: the table of sources goes through the driver, and may have a million rows (else an error); a group that is apportioned has about
    the square root of a source's number of shards; windows hold one shard.

    A null or empty text has no words, and none are taken. A null source is a source. Rows that repeat take part each for itself. Reruns agree,
    since order depends on ids and texts alone, and rows that share both are alike. Empty in, empty out.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = save(docs.select(F.struct(*carry).alias("row"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("order"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "op4-sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(SOURCES + 1).collect()
    if len(sources) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: {source_col} is no source column")
    sources.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r[1] for r in sources]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share, repeats)
    block = max(1, min(block, min((s for s in sizes if s), default=block) // LEAST_BLOCKS))
    shards = [max(1, -(-s // shard)) for s in sizes]
    bundles = [max(1, int(n**0.5)) for n in shards]
    seats = apportion(np.array(goals), round(sum(goals) / block), np.array([-(-repeats * s // block) for s in sizes], np.int64)) if sources else []
    plan = docs.sparkSession.createDataFrame(
        [(r[0], i, r[1], goals[i], int(seats[i]), shards[i], bundles[i]) for i, r in enumerate(sources)],
        "source string, number long, source_size long, target double, seats long, shards long, bundles long",
    )
    placed = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop("source").withColumn("shard", F.pmod("order", "shards"))
    dealt = placed.withColumn("bundle", F.pmod("shard", "bundles")).groupBy("number", "seats", "bundle", "shard").agg(F.sum("size").alias("tokens"))
    dealt = save(dealt.withColumn("most", F.ceil(F.col("tokens") * repeats / block)), "op4-shards")
    of_bundles = dealt.groupBy("number", "seats", "bundle").agg(F.sum("tokens").alias("tokens"), F.sum("most").alias("most"))
    per_bundle = _give(of_bundles, ["number"], "bundle").withColumnRenamed("given", "seats")
    per_shard = _give(dealt.drop("seats").join(per_bundle, ["number", "bundle"]), ["number", "bundle"], "shard").select("number", "shard", "given")
    quotas = dealt.select("number", "shard", "tokens").join(per_shard, ["number", "shard"])

    laid = W.partitionBy("number", "shard").orderBy("order", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(laid), F.lit(0))
    whole = F.col("target") >= repeats * F.col("source_size")
    words = F.when(whole, repeats * F.col("tokens")).otherwise(F.least(F.col("given") * block, repeats * F.col("tokens")))
    passes = F.when(F.col("tokens") > 0, F.floor(words / F.col("tokens"))).otherwise(0)
    rest = words - F.col("passes") * F.col("tokens")
    return (
        placed.join(quotas, ["number", "shard"]).withColumn("before", before).withColumn("passes", passes)
        .withColumn("extra", F.greatest(F.lit(0), F.least(rest - F.col("before"), F.col("size"))))
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
        .select("row", "size", "source_size", "target", "passes", "extra", "taken")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")
