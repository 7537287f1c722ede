import hashlib
import math
import random

import numpy as np

from hearthstat.llm.op13_vector_codes import OP13_SQL, compress, op13_vector_codes


def floors(vector):
    return [int(x) * 256 if abs(x) > 2**52 else math.floor(256.0 * x) for x in vector]


def brute(rows, parts=16, entries=64, rounds=2):
    """(id, label, code, error) and codebooks, by loops over plain integers."""
    kept = [(i, label, list(v)) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], []
    width = len(kept[0][2])
    dims = [d.tolist() for d in np.array_split(np.arange(width), parts)]
    same = [(i, label, floors(v)) for i, label, v in kept if len(v) == width]
    books = [[[v[d] for d in own] for _, _, v in same[:entries]] for own in dims]

    def nearest(p, v):
        distances = [sum((v[d] - x) ** 2 for d, x in zip(dims[p], entry)) for entry in books[p]]
        return min(range(len(distances)), key=distances.__getitem__), min(distances)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in same:
                groups.setdefault(nearest(p, v)[0], []).append([v[d] for d in dims[p]])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else entry for e, entry in enumerate(books[p])]
    out = [(i, label, None, None) for i, label, v in kept if len(v) != width]
    for i, label, v in same:
        found = [nearest(p, v) for p in range(parts)]
        out.append((i, label, bytes(c for c, _ in found), min(sum(e for _, e in found), 2**63 - 1)))
    return out, books


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'c' as code", "1 as error", "2 as n", "3 as rows").repartition(3)
    coded, books = compress(df, ["vec_id", "label"], **options)
    got = [(r.row.vec_id, r.row.label, None if r.code is None else bytes(r.code), r.error) for r in coded.collect()]
    want, wanted_books = brute(rows, **options)
    assert books == wanted_books
    assert sorted(got, key=str) == sorted(want, key=str)


def test_like_plain_loops(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(200), [rnd.choice([-0.3, 0.1, 0.7, rnd.random(), -2.5]) for _ in range(8)], rnd.choice([None, 1, 2])) for _ in range(240)]
    rows += rows[:30] + [(None, [0.5] * 8, 3), (None, None, 1), (3, [None] * 8, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] + [0.0] * 7, 1), (6, [], 2), (7, [1.0, 2.0], 2), (8, [0.1] * 9, None)]
    check(spark, rows, parts=4, entries=5, rounds=2)
    check(spark, rows, parts=3, entries=256, rounds=1)
    check(spark, rows, parts=16, entries=1, rounds=0)


def test_large_numbers_and_odd_widths(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([1e300, -1e308, 1e17, 3.0, -1e9, rnd.gauss(0, 1e6)]) for _ in range(5)], 1) for i in range(60)]
    check(spark, rows, parts=2, entries=6, rounds=2)
    check(spark, [(1, [], 1), (2, [], None)], parts=16, entries=4, rounds=2)
    check(spark, [(1, None, 1)])
    check(spark, [(9, [0.25] * 4, 1)], parts=2, entries=64, rounds=2)


def test_query_on_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    coded, books = brute(rows)
    sums = {}
    for _, label, _, error in coded:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = sorted((i, code.hex(), error, sums[label], digest) for i, label, code, error in coded)
    got = op13_vector_codes(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    assert sorted(map(tuple, got.collect())) == want
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, connection.sql(OP13_SQL).fetchall())) == want


def test_query_on_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op13_vector_codes(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(1, [0.5] * 32, None), (2, [0.25] * 32, None), (3, None, None), (4, [1.0] * 32, 7), (5, [1.0], 7)], schema).write.parquet(f"{tmp_path}/some/embeddings.parquet")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in op13_vector_codes(spark, f"{tmp_path}/some").collect()}
    assert got == {1: ("00" * 16, 0, 0), 2: ("01" * 16, 0, 0), 4: ("02" * 16, 0, 0), 5: (None, None, 0)}
