"""Embedding near-dedup: inverted lists with product-quantised residuals, table-lookup distances over sufficient probes, exact cosine."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.graph import components
from hearthstat.llm.shared import save

COSINE = 0.98
PARTS = 16
WORDS = 256
LIST_ROWS = 512
SAMPLE = 16_384
BLOCK = 4096
_ROUNDS = 6
_QUERIES = 256
_DENSE = 4
_PAIRS = 1 << 16
_DEAL = 16_384
#: Allowance for rounding in the bounds; links themselves are decided by the exact cosine.
_SLACK = 1e-7


def units(bodies: list[bytes], width: int) -> np.ndarray:
    """Vectors kept as bytes, in double precision and of length 1."""
    joined = b"".join(bodies)
    values = np.frombuffer(joined, np.float32 if len(joined) == 4 * width * len(bodies) else np.float64).reshape(len(bodies), width).astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # neither overflow nor loss in the squares
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.einsum("ij,ij->i", a, a)[:, None] - 2 * a @ b.T + np.einsum("ij,ij->i", b, b)[None, :])


def means(points: np.ndarray, count: int) -> np.ndarray:
    """Centres of a few rounds of k-means from evenly spaced points; a centre without points stays."""
    centres = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)].copy()
    for _ in range(_ROUNDS):
        near = np.argmin(_squared(points, centres), axis=1)
        held = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, weights=points[:, d], minlength=len(centres)) for d in range(points.shape[1])], axis=1) if points.shape[1] else centres
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


class Index:
    """Centres of the lists and codebooks of the residuals' parts, fitted on sample vectors.

    It works on the first ``width`` components, others being zero where a vector has fewer: distances there are at most the full ones. So it sets how
    much work is done, never which links are found.
    """

    def __init__(self, bodies: list[tuple[bytes, int]], lists: int, parts: int, far: float):
        self.far = far
        self.width = max(Counter(w for _, w in bodies).items(), key=lambda x: (x[1], x[0]))[0]
        points = np.concatenate([self.fit(units([b for b, w in bodies if w == width], width)) for width in sorted({w for _, w in bodies})])
        self.centres = means(points, lists)
        self.dims = np.array_split(np.arange(self.width), parts)
        rest = points - self.centres[np.argmin(_squared(points, self.centres), axis=1)]
        self.books = [means(rest[:, d], WORDS) for d in self.dims]
        self.between = np.sqrt(_squared(self.centres, self.centres))

    def fit(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), self.width))
        out[:, : values.shape[1]] = values[:, : self.width]
        return out

    def place(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, whether each list must be visited, codes and distance to the coded vector.

        A straight line between two vectors of different lists crosses the plane midway between the lists' centres, so one of the two lies within half
        their distance of that plane. Lists whose plane is within half the greatest distance of a link are visited; that finds every link.
        """
        squared = _squared(values, self.centres)
        own = np.argmin(squared, axis=1)
        rows = np.arange(len(values))
        with np.errstate(divide="ignore", invalid="ignore"):
            to_plane = (squared - squared[rows, own][:, None]) / (2 * self.between[own])
        visits = to_plane <= self.far / 2 + _SLACK
        visits[rows, own] = True
        rest = values - self.centres[own]
        codes = np.stack([np.argmin(_squared(rest[:, d], book), axis=1) for d, book in zip(self.dims, self.books)], axis=1).astype(np.uint8)
        off = rest - np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return own, visits, codes, np.sqrt(np.einsum("ij,ij->i", off, off))

    def candidates(self, queries: np.ndarray, of: int, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member of list ``of``) that may be near enough: by sums of looked-up distances, which are abandoned once too large."""
        rest = queries - self.centres[of]
        tables = [_squared(rest[:, d], book) for d, book in zip(self.dims, self.books)]
        most = (self.far + off + _SLACK) ** 2
        total = np.zeros((len(queries), len(codes)))
        for p in range(min(_DENSE, len(tables))):
            total += tables[p][:, codes[:, p]]
        q, m = np.nonzero(total <= most)
        total = total[q, m]
        for p in range(_DENSE, len(tables)):
            total = total + tables[p][q, codes[m, p]]
            near = total <= most[m]
            q, m, total = q[near], m[near], total[near]
        return q, m


def _union(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each component after the links a-b."""
    while True:
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        if not apart.any():
            return roots
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(roots, shorter := roots[roots]):
            roots = shorter


class Tile:
    """A block of a list's members and a block of its visitors: who is linked with how many, and a star per component of the links."""

    def __init__(self, index: Index, members: pd.DataFrame, visitors: pd.DataFrame, cosine: float):
        width, of = int(members["width"].iloc[0]), int(members["list"].iloc[0])
        ours, theirs = units(list(members["vector"]), width), units(list(visitors["vector"]), width)
        codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), -1)
        off, home = members["off"].to_numpy(), visitors["home"].to_numpy()
        order = pd.factorize(np.concatenate([members["node"].to_numpy(), visitors["node"].to_numpy()]), sort=True)[0]
        ranks, their_ranks = order[: len(members)], order[len(members) :]
        n, their_n = members["n"].to_numpy(np.int64), visitors["n"].to_numpy(np.int64)
        self.links = np.zeros(len(members), np.int64)
        self.their_links = np.zeros(len(visitors), np.int64)
        self.roots = np.arange(len(members) + len(visitors))
        visited = np.zeros((len(members), len(index.centres)), bool)
        visited[np.repeat(np.arange(len(members)), members["visits"].map(len)), np.concatenate(members["visits"].to_list())] = True
        shaped = index.fit(theirs)
        for at in range(0, len(visitors), _QUERIES):
            q, m = index.candidates(shaped[at : at + _QUERIES], of, codes, off)
            q = q + at
            for low in range(0, len(q), _PAIRS):
                i, j = q[low : low + _PAIRS], m[low : low + _PAIRS]
                found = np.einsum("ij,ij->i", theirs[i], ours[j]) >= cosine
                i, j = i[found], j[found]
                # each pair counts once: in the one list where both live, or, if each visits the other's list, in the lower one
                alike = home[i] == of
                counts = np.where(alike, their_ranks[i] < ranks[j], (home[i] > of) | ~visited[j, home[i]])
                i, j = i[counts], j[counts]
                np.add.at(self.links, j, their_n[i])
                np.add.at(self.their_links, i, n[j])
                self.roots = _union(self.roots, j, i + len(members))


_TILE = ["label", "width", "list", "b", "c"]


def _met(index: Index, cosine: float):
    def run(members: pa.Table, visitors: pa.Table) -> pa.Table:
        members, visitors = members.to_pandas(), visitors.to_pandas()
        nodes, links, tops = [], [], []
        theirs = visitors.groupby(_TILE).indices
        for key, at in members.groupby(_TILE).indices.items():
            own, others = members.iloc[at], visitors.iloc[theirs.get(key, [])]
            if not len(others):
                continue
            tile = Tile(index, own, others, cosine)
            both = np.concatenate([own["node"].to_numpy(), others["node"].to_numpy()])
            counted = np.concatenate([tile.links, tile.their_links])
            some = np.flatnonzero(counted)
            nodes += both[some].tolist()
            links += counted[some].tolist()
            tops += both[tile.roots[some]].tolist()
        return pa.table({"node": pa.array(nodes, pa.binary()), "links": pa.array(links, pa.int64()), "top": pa.array(tops, pa.binary())})

    return run


def _named(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label (as text), width, vector (its bytes) and node (a 128-bit digest of the three) of every row; rows that link with nothing have only an id."""
    single = vectors.schema[vector_col].dataType.jsonValue() == {"type": "array", "elementType": "float", "containsNull": True}
    vector = F.col("vector") if single else F.col("vector").cast("array<double>")
    able = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.select("id", "label", F.when(able, vector).alias("vector"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            kind = np.float32 if single else np.float64
            # the bytes of a null row's range, if it has any, are never read
            offsets = column.offsets.to_numpy()
            body = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
            out = [(None,) * 4] * len(column)
            for i, (label, there) in enumerate(zip(batch.column(1).to_pylist(), column.is_valid().to_pylist())):
                if there:
                    own = body[offsets[i] : offsets[i + 1]]
                    state = xxhash.xxh3_128(f"{len(label)}:{label}:{len(own)}:".encode())
                    state.update(own.tobytes())
                    out[i] = (label, len(own), own.tobytes(), state.digest())
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=["id", "label", "width", "vector", "node"])

    return rows.mapInArrow(run, "id long, label string, width int, vector binary, node binary")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", cosine: float = COSINE, parts: int = PARTS,
                 list_rows: int = LIST_ROWS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Groups of vectors of one label linked by a cosine of at least ``cosine``: id, ``n_links``, ``component_id``, ``kept``, one row per input row.

    1. Equal vectors of a label are one class, made by a partial aggregate; it takes part once and counts for its rows.
    2. An index is fitted on about ``sample`` classes: a centre per some ``list_rows`` classes (at most sample / 32), and 256 codewords for each part of
       the residuals. Every class is put on the list of its nearest centre with its residual's code, and visits all lists that may hold a link of it.
    3. Lists are cut into blocks of members and of visitors that meet in tiles. In a tile, looked-up distances to the coded members, less the known coding error, leave
       few candidates; those are decided by the exact cosine. A tile gives counts per vector and one star per component of its links, so a group
       of near copies sends as many rows as it has members, not its pairs.
    4. Counts are added up, and stars make components.

    Probes are sufficient by the planes between centres, so no link is lost whatever the sample was. Only vectors on one list are compared; where vectors
    of a label are truly that near, all pairs are counted, in as many tiles as blocks meet.

    Labels null, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Vectors of different widths do not link.
    A null id is no smallest id: ``component_id`` is null only if no row of the group has an id, and ``kept`` is then true. Rows that repeat an id
    stand for themselves and are links of each other if their vectors are. Empty in, empty out. Other columns are not read.
    """
    named = _named(vectors, id_col, label_col, vector_col)
    classes = named.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("width").alias("width"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least")
    )
    classes = save(classes, "op11-classes")
    total = classes.count()
    rows = named.select("id", "node")
    plain = lambda part: part.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return plain(rows)
    # one in so many by digest: the expected number is the sample's, and twice that is never passed
    taken = classes.where(F.pmod(F.xxhash64("node"), F.lit(total)) < sample).select("vector", "width").limit(2 * sample).collect() or classes.select("vector", "width").limit(1).collect()
    index = Index([(bytes(r[0]), r[1]) for r in taken], max(1, min(total // list_rows, sample // 32)), parts, math.sqrt(max(0.0, 2 - 2 * cosine)))

    def placed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            for width in np.unique(widths).tolist():
                own = batch.take(pa.array(np.flatnonzero(widths == width)))
                at, visits, codes, off = index.place(index.fit(units(own.column(3).to_pylist(), width)))
                which, where = np.nonzero(visits)
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(len(at) + 1)).astype(np.int32)), pa.array(where.astype(np.int32)))
                extra = [pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), listed]
                yield pa.RecordBatch.from_arrays([*own.columns, *extra], names=[*own.schema.names, "list", "code", "off", "visits"])

    shape = T.StructType([*classes.select("node", "label", "width", "vector", "n").schema.fields, *T.StructType.fromDDL("list int, code binary, off double, visits array<int>").fields])
    lists = save(classes.select("node", "label", "width", "vector", "n").mapInArrow(placed, shape), "op11-lists")
    anew = [F.col(c).alias(c) for c in ("node", "label", "width", "vector", "n")]
    visits = lists.select(*anew, F.explode("visits").alias("list"), F.col("list").alias("home"))
    key = ["label", "width", "list"]
    sizes = visits.groupBy(*key).agg(F.sum((F.col("list") == F.col("home")).cast("long")).alias("members"), F.count(F.lit(1)).alias("visitors")).where("members > 0")
    sizes = sizes.select(*key, F.ceil(F.col("members") / block).alias("blocks"), F.ceil(F.col("visitors") / block).alias("turns"), "visitors")
    sizes = save(sizes, "op11-sizes")
    deals = max(1, -(-(sizes.agg(F.sum(F.col("visitors") * F.col("blocks"))).first()[0] or 0) // _DEAL))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = F.pmod(F.xxhash64(*_TILE), F.lit(deals)).alias("deal")
    pick = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n))
    members = lists.join(sizes, key).withColumn("b", pick("blocks", 1)).withColumn("c", every("turns")).select(*_TILE, deal, "node", "vector", "n", "code", "off", "visits")
    visitors = visits.join(sizes.drop("visitors"), key).withColumn("c", pick("turns", 2)).withColumn("b", every("blocks")).select(*_TILE, deal, "node", "vector", "n", "home")
    met = members.groupBy("deal").cogroup(visitors.groupBy("deal")).applyInArrow(_met(index, cosine), "node binary, links long, top binary")
    met = save(met, "op11-links")

    label = components(met.select(F.col("node").alias("a"), F.col("top").alias("b")))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    group = classes.select("node", "n", "least").join(label, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    group = save(group.select("node", "component", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "op11-groups")
    first = group.groupBy("component").agg(F.min("least").alias("component_id"))
    found = rows.where("node is not null").join(group.join(first, "component").select("node", "n_links", "component_id"), "node")
    linked = found.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(plain(rows.where("node is null")))


def op11_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


#: DuckDB SQL of op11_embedding_groups, for tables whose ids do not repeat: all pairs of a label, and their transitive closure.
OP11_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
    SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm
    FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ) AS x
), l AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm) >= {COSINE}
), r AS (
    SELECT vec_id, vec_id AS reached FROM embeddings
    UNION
    SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a
)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = r.vec_id) AS BIGINT) AS n_links, min(reached) AS component_id, vec_id = min(reached) AS kept
FROM r GROUP BY vec_id
"""
