"""Vector code compression: product codes from integer codebooks, found by sums over tables of per-dimension value dictionaries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.packets import whole_rows
from hearthstat.llm.shared import save

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
_ROWS = 4096
_VALUES = 1 << 20
_LIMB = 32
_MOST = 2**63 - 1

#: One entry per part: the integer vectors of its codebook.
Codebooks = list[list[list[int]]]


def usable(vector):
    """Condition on an array column: it is there, and its components are neither null nor infinite nor NaN."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite numbers: 64-bit integers where sums of squared differences fit, else unbounded integers."""
    with np.errstate(over="ignore"):
        floors = np.floor(values * scale)
    if not floors.size or np.abs(floors).max() < (2**60 / max(1, values.shape[1])) ** 0.5:
        return floors.astype(np.int64)
    exact = lambda x: int(x) * scale if abs(x) > 2**52 else math.floor(x * scale)
    return np.array([[exact(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def _numbers(values: np.ndarray) -> bytes:
    return values.tobytes() if values.dtype != object else " ".join(map(str, values)).encode()


def dictionary_table(vectors: DataFrame, carry: list[str], vector_col: str, scale: int = SCALE) -> DataFrame:
    """The usable vectors of a table in chunks of some thousand: per dimension the distinct integers, and every vector as numbers of those.

    ``rows`` holds the columns of ``carry``. Vectors of one chunk are of one width.
    """
    kept = vectors.select(F.struct(*carry).alias("row"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    schema = T.StructType.fromDDL("n int, width int, big boolean, sizes binary, numbers binary, codes binary")
    schema = T.StructType([*schema.fields, T.StructField("rows", T.ArrayType(kept.schema["row"].dataType))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, column = batch.column(0), batch.column(1)
            widths = column.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                places = np.flatnonzero(widths == width)
                step = max(1, min(_ROWS, _VALUES // max(1, width)))
                for at in range(0, len(places), step):
                    own = pa.array(places[at : at + step])
                    values = whole(column.take(own).flatten().to_numpy(zero_copy_only=False).reshape(len(own), width), scale)
                    listed = [np.unique(values[:, d], return_inverse=True) for d in range(width)]
                    numbers = np.concatenate([found for found, _ in listed]) if listed else np.zeros(0, np.int64)
                    sizes = np.array([len(found) for found, _ in listed], np.uint16)
                    codes = np.array([code for _, code in listed], np.uint16)
                    held = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), rows.take(own))
                    plain = [pa.array([x], kind) for x, kind in zip((len(own), width, numbers.dtype == object, sizes.tobytes(), _numbers(numbers), codes.tobytes()), (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*plain, held], names=schema.names)

    return kept.mapInArrow(run, schema)


class Chunk:
    """Vectors as numbers into the dictionaries of their dimensions."""

    def __init__(self, row: dict):
        self.n, self.width = row["n"], row["width"]
        sizes = np.frombuffer(row["sizes"], np.uint16).astype(np.int64)
        numbers = np.array([int(x) for x in row["numbers"].split()], object) if row["big"] else np.frombuffer(row["numbers"], np.int64)
        self.values = np.split(numbers, np.cumsum(sizes)[:-1]) if self.width else []
        self.codes = np.frombuffer(row["codes"], np.uint16).reshape(self.width, self.n).astype(np.int64)

    def nearest(self, dims: list[int], entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Per vector the nearest entry of a part's codebook, ties to the lower one, and the squared distance to it."""
        fits = all(self.values[d].dtype != object for d in dims) and max((abs(x) for e in entries for x in e), default=0) ** 2 * 4 * max(1, len(dims)) < 2**62
        kind = np.int64 if fits else object
        book = np.array(entries, kind).reshape(len(entries), len(dims))
        distance = np.zeros((self.n, len(entries)), kind)
        for k, d in enumerate(dims):
            table = self.values[d].astype(kind)[:, None] - book[None, :, k]
            distance += (table * table)[self.codes[d]]
        best = np.argmin(distance, axis=1) if kind is np.int64 else np.array([min(range(len(entries)), key=own.__getitem__) for own in distance.tolist()], np.int64)
        return best, distance[np.arange(self.n), best]


def part_dims(width: int, parts: int) -> list[list[int]]:
    """The dimensions of each part: equal and consecutive; where the width is no multiple, the first parts have one more."""
    return [d.tolist() for d in np.array_split(np.arange(width), parts)]


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """An integer as 32-bit pieces from the lowest on, the last one signed."""
    place = 0
    while not -(1 << _LIMB - 1) <= total < 1 << _LIMB - 1:
        yield place, total & (1 << _LIMB) - 1
        total, place = total >> _LIMB, place + 1
    yield place, total


def _updated(table: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """The codebooks after one round. Sums are added up per task, then per cell; what is collected is as large as the codebooks."""
    parts = part_dims(width, len(books))

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(book), len(dims) + 1), object) for book, dims in zip(books, parts)]
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                for p, dims in enumerate(parts):
                    best, _ = chunk.nearest(dims, books[p])
                    for k, d in enumerate(dims):
                        add = np.zeros(len(books[p]), chunk.values[d].dtype)
                        np.add.at(add, best, chunk.values[d][chunk.codes[d]])
                        sums[p][:, k] += add.astype(object)
                    sums[p][:, -1] += np.bincount(best, minlength=len(books[p])).astype(object)
        out = [(p, e, k, place, piece) for p, own in enumerate(sums) for e, k in np.ndindex(own.shape) for place, piece in _limbs(int(own[e, k]))]
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["part", "entry", "position", "place", "piece"])

    cells = table.where(F.col("width") == width).drop("rows").mapInArrow(run, "part int, entry int, position int, place int, piece long")
    totals: dict[tuple, int] = {}
    for part, entry, position, place, piece in cells.groupBy("part", "entry", "position", "place").agg(F.sum("piece")).collect():
        totals[part, entry, position] = totals.get((part, entry, position), 0) + (piece << _LIMB * place)
    out = []
    for p, (book, dims) in enumerate(zip(books, parts)):
        counts = [totals.get((p, e, len(dims)), 0) for e in range(len(book))]
        out.append([[totals[p, e, k] // counts[e] for k in range(len(dims))] if counts[e] else entry for e, entry in enumerate(book)])
    return out


def first_vectors(vectors: DataFrame, id_col: str, vector_col: str, count: int, scale: int = SCALE) -> list[list[int]]:
    """The integer vectors of the ``count`` smallest ids (null last, ties by the vector) that have the width of the smallest one."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    order = (F.col("id").asc_nulls_last(), F.col("vector"))
    rows = kept.orderBy(*order).limit(count).collect()
    if any(len(r[1]) != len(rows[0][1]) for r in rows):
        rows = kept.where(F.size("vector") == len(rows[0][1])).orderBy(*order).limit(count).collect()
    return [whole(np.array([r[1]], float).reshape(1, -1), scale)[0].tolist() for r in rows]


def train(table: DataFrame, start: list[list[int]], parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of a dictionary table after ``rounds`` rounds of assignment and floored means, from the start vectors. Unused entries stay."""
    width = len(start[0])
    books: Codebooks = [[[vector[d] for d in dims] for vector in start] for dims in part_dims(width, parts)]
    for _ in range(rounds):
        books = _updated(table, books, width)
    return books


def assign(table: DataFrame, books: Codebooks) -> DataFrame:
    """``row``, ``code`` (one byte per part) and ``error`` (squared distances summed over parts, cut to 2 ** 63 - 1) of every vector.

    Vectors of another width than the codebooks' have null for both.
    """
    width = sum(len(book[0]) for book in books)
    parts = part_dims(width, len(books))
    row = table.schema["rows"].dataType.elementType

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.names.index("rows"))
            for i, held in enumerate(batch.drop_columns(["rows"]).to_pylist()):
                codes, errors = [None] * held["n"], [None] * held["n"]
                if held["width"] == width:
                    chunk = Chunk(held)
                    found = [chunk.nearest(dims, book) for dims, book in zip(parts, books)]
                    codes = [c.tobytes() for c in np.stack([best for best, _ in found], axis=1).astype(np.uint8)]
                    errors = [min(int(e), _MOST) for e in sum(distance.astype(object) for _, distance in found)]
                yield pa.RecordBatch.from_arrays([rows.slice(i, 1).flatten(), pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], names=["row", "code", "error"])

    return table.mapInArrow(run, T.StructType([T.StructField("row", row), *T.StructType.fromDDL("code binary, error long").fields]))


def compress(vectors: DataFrame, carry: list[str], id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Product codes of a table's vectors, and the codebooks.

    Component x is the integer floor(scale * x). Vectors are cut into ``parts`` equal consecutive parts; a part's codebook starts from that part of the
    ``entries`` (at most 256) vectors of smallest id, and each round moves an entry to the floored mean of the parts nearest to it, ties to the lower entry.

    A chunk of some thousand vectors keeps the distinct integers of each dimension and numbers into them. In a pass it tabulates the squared differences of
    every distinct integer to all entries, per dimension; the distances of all vectors are then rows gathered from these tables and added up. The
    dictionary table is written once and read once a round. Nothing is shuffled but sums, one per cell of the codebooks and task.

    Rows with a null vector, or a null or non-finite component, are left out. Vectors of another width than that of the smallest id have a null code
    and take no part in the means. A null id is the largest; rows that repeat stand for themselves, equal ids start in order of their vectors.
    Where sums of squares might not fit 62 bits, integers are unbounded. Empty in, empty out, with no codebooks. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte per part: entries must be between 1 and 256")
    start = first_vectors(vectors, id_col, vector_col, entries, scale)
    table = save(dictionary_table(vectors, carry, vector_col, scale), "op13-dictionaries")
    if not start:
        row = table.schema["rows"].dataType.elementType
        return vectors.sparkSession.createDataFrame([], T.StructType([T.StructField("row", row), *T.StructType.fromDDL("code binary, error long").fields])), []
    books = train(table, start, parts, rounds)
    return assign(table, books), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"), ["vec_id", "label"])
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = save(coded.select("row.vec_id", "row.label", F.lower(F.hex("code")).alias("code"), "error"), "op13-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    labels = found.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    joined = found.join(labels, found["label"].eqNullSafe(labels["of"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """CTEs of one round: the nearest entry of codebook ``n`` per part, and codebook ``n + 1``."""
    return f"""
a{n} AS MATERIALIZED (
    SELECT rn, part, min(CAST(list_sum(list_transform(range(1, w + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS HUGEINT) * {ENTRIES} + entry) AS m
    FROM p JOIN c{n} AS c USING (part) GROUP BY rn, part
)""" + (f""",
u{n} AS (
    SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS x
    FROM (SELECT part, CAST(m % {ENTRIES} AS BIGINT) AS entry, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
          FROM a{n} JOIN p USING (rn, part), unnest(range(1, w + 1)) AS t(i) GROUP BY 1, 2, 3) AS y
),
c{n + 1} AS MATERIALIZED (
    SELECT c.part, c.entry, coalesce(x.v, c.v) AS v
    FROM c{n} AS c LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM u{n} GROUP BY part, entry) AS x USING (part, entry)
),""" if n < ROUNDS else "")  # fmt: skip


#: DuckDB SQL of op13_vector_codes, for vectors of one width that is a multiple of the parts, and ids that do not repeat.
OP13_SQL = f"""
WITH k AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT rn, part, len(e) // {PARTS} AS w, list_slice(e, part * (len(e) // {PARTS}) + 1, (part + 1) * (len(e) // {PARTS})) AS v
    FROM k, unnest(range(0, {PARTS})) AS t(part)
), c0 AS MATERIALIZED (
    SELECT part, rn - 1 AS entry, v FROM p WHERE rn <= {ENTRIES}
),{"".join(_round(n) for n in range(ROUNDS + 1))},
r AS (
    SELECT rn, string_agg(printf('%02x', CAST(m % {ENTRIES} AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rn
), h AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN r USING (rn), h
"""
