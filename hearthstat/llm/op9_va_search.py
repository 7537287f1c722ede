"""Exact top-k search by inner product over a vector-approximation file: bounds from quantised cells, then few exact vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthstat.llm.shared import save

K = 5
SCALE = 256
EVERY = 50
BLOCK = 8192
QUERY_BLOCK = 256
TILE_QUERIES = 64
CELLS = 16
_FIRST = 32
_PACKET = "width int, n int, ids binary, cells binary, marks binary, exact binary"


def whole_numbers(batch: pa.RecordBatch, vector_col: str, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of a batch, by number of components; rows with a null or non-finite component, or no id, are left out."""
    by_width: dict[int, list] = {}
    for key, vector in zip(batch.column("id").to_pylist(), batch.column(vector_col)):
        if key is None or not vector.is_valid or vector.values.null_count:
            continue
        with np.errstate(over="ignore"):
            values = np.floor(scale * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(values).all():
            by_width.setdefault(len(values), []).append((key, values))
    for rows in by_width.values():
        values = np.stack([v for _, v in rows])
        small = not values.size or np.abs(values).max() ** 2 * values.shape[1] < 2**53
        yield np.array([k for k, _ in rows], np.int64), values.astype(np.int64) if small else np.array([[int(x) for x in v] for v in values], object)


def _packets(vectors: DataFrame, vector_col: str, scale: int, size: int, cells: int) -> DataFrame:
    """Vectors in packets of ``size``: ids, the cell of every component, the least and greatest component of every cell, and the exact integers."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, values in whole_numbers(batch, vector_col, scale):
                for at in range(0, len(ids), size):
                    own, exact = ids[at : at + size], values[at : at + size]
                    if exact.dtype == object:
                        rows.append((exact.shape[1], len(own), own.tobytes(), None, None, "\n".join(" ".join(map(str, v)) for v in exact).encode()))
                        continue
                    low, high = exact.min(axis=0), exact.max(axis=0)
                    cell = ((exact - low) * cells // (high - low + 1)).astype(np.uint8)
                    marks = np.zeros((2, cells, exact.shape[1]), np.int64)
                    for c in range(cells):
                        inside = cell == c
                        marks[0, c] = np.where(inside, exact, high).min(axis=0)
                        marks[1, c] = np.where(inside, exact, low).max(axis=0)
                    rows.append((exact.shape[1], len(own), own.tobytes(), cell.tobytes(), marks.tobytes(), exact.tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            names = [f.split()[0] for f in _PACKET.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return vectors.mapInArrow(run, _PACKET)


def _exact(row: dict) -> np.ndarray:
    if row["cells"] is None:
        return np.array([[int(x) for x in line.split()] for line in row["exact"].decode().split("\n")], object).reshape(row["n"], row["width"])
    return np.frombuffer(row["exact"], np.int64).reshape(row["n"], row["width"])


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, block: dict, k: int, cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best of a block, ties to smaller ids, the query's own id left out.

    An upper bound of each score comes from the cells alone. Exact vectors are read in the order of the bounds: a first few, and then
    all others whose bound reaches the k-th score found; the rest cannot be among the k best.
    """
    ids, exact = np.frombuffer(block["ids"], np.int64), _exact(block)
    bounds = None
    if block["cells"] is not None and queries.dtype != object:
        low, high = np.frombuffer(block["marks"], np.int64).reshape(2, cells, -1)
        cell = np.frombuffer(block["cells"], np.uint8).reshape(block["n"], block["width"])
        at = np.arange(block["width"])
        q = queries.astype(np.float64)
        bounds = np.maximum(q, 0) @ high[cell, at].T.astype(np.float64) + np.minimum(q, 0) @ low[cell, at].T.astype(np.float64)
    for i, own in enumerate(query_ids.tolist()):
        others = np.flatnonzero(ids != own)
        if bounds is None:
            picked = others
        else:
            bound = bounds[i, others]
            first = others[np.argpartition(-bound, _FIRST)[:_FIRST]] if len(others) > _FIRST else others
            scores = exact[first] @ queries[i]
            least = np.sort(scores)[-k] if len(scores) >= k else -np.inf
            picked = others[bound >= least]
        scores = exact[picked] @ queries[i]
        if scores.dtype == object:
            scores = np.array([max(-(2**63) + 1, min(int(s), 2**63 - 1)) for s in scores], np.int64)
        order = np.lexsort((ids[picked], -scores))[:k]
        yield own, ids[picked[order]], scores[order]


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """For every row where ``is_query`` holds, the ``k`` other rows of greatest inner product: query_id, rank, vec_id, score.

    Components x count as floor(scale * x). The vectors are written once as a vector-approximation table, in packets of ``block``. Packets of
    queries and of vectors meet in tiles: a tile holds about one packet of vectors and at most some 64 of queries, however many there are. Each
    tile keeps k rows per query, and a window over those ranks them.

    Vectors that are null, or hold a null or non-finite component, and rows without an id take no part. Vectors are compared with
    those of as many components. Rows that share an id are never a result of a query of that id; elsewhere each stands for itself. A query id that
    stands in several rows asks once, with the least of its vectors. Ties go to the smaller id.
    Where products might not fit 53 bits they are taken in unbounded integers, and scores are cut to 2 ** 63 - 1 either way before they are ranked. Empty in, empty out.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    table = save(_packets(kept.select("id", "vector"), "vector", scale, block, cells), "op9-cells")
    whole = F.forall("vector", lambda x: x.isNotNull() & (F.abs(scale * x.cast("double")) < float("inf")))  # NaN is above infinity
    asks = kept.where("asks and id is not null").where(F.col("vector").isNotNull() & whole).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = save(_packets(asks, "vector", scale, QUERY_BLOCK, cells), "op9-queries")
    columns, rows = max(1, table.count()), max(1, -(-asked.count() // TILE_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("width", "n", "ids"), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = table.withColumn("x", deal(columns)).withColumn("y", spread(rows))
    right = asked.withColumn("y", deal(rows)).withColumn("x", spread(columns))

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        best: dict[int, list[tuple[int, int]]] = {}
        held = blocks.to_pylist()
        for packet in queries.to_pylist():
            numbers = _exact(packet)
            for own in held:
                if own["width"] == packet["width"]:
                    for query, ids, scores in best_of_block(numbers, np.frombuffer(packet["ids"], np.int64), own, k, cells):
                        best.setdefault(query, []).extend((-int(s), int(i)) for s, i in zip(scores, ids))
        rows = [(q, i, -s) for q, found in best.items() for s, i in sorted(found)[:k]]
        return pa.table({name: pa.array([r[j] for r in rows], pa.int64()) for j, name in enumerate(("query_id", "vec_id", "score"))})

    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(run, "query_id long, vec_id long, score long")
    ranked = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


#: DuckDB SQL of op9_va_search.
OP9_SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id
    WHERE q.vec_id % {EVERY} = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
