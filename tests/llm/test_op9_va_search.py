import math
import os
import random

import duckdb
from pyspark.sql import functions as F

from hearthstat.llm.op9_va_search import OP9_SQL, op9_va_search, top_k


def cut(score):
    return max(1 - 2**63, min(score, 2**63 - 1))


def brute(rows, every, k=5):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256.0 * x) for x in v):
            continue
        whole.append((i, [math.floor(256.0 * x) for x in v]))
    out = set()
    for q in {i for i, _ in whole if i % every == 0}:
        scores = [(-cut(sum(a * b for a, b in zip(x, y))), j) for i, x in whole if i == q for j, y in whole if j != q and len(x) == len(y)]
        out |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])}
    return sorted(out)


def test_like_brute_force_with_ties_and_odd_vectors(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([0.1, -0.2, 0.0, 1.5]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 360)]
    rows += [(None, [1.0] * 6), (1000, None), (1010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1020, [float("nan")] * 6), (1030, [float("inf")] * 6), (1040, [1e308] * 6)]
    rows += [(1050, [1e12, -1e12]), (1051, [1e12, 3e12]), (1052, [-7e11, 1.0]), (1060, []), (1061, []), (1070, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'c' as rank", "1 as id")
    for block in (8192, 7):
        got = top_k(df, F.col("vec_id") % 10 == 0, block=block)
        assert sorted(map(tuple, got.collect())) == brute(rows, 10)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_repeated_query_rows_ask_once(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (100, [3.0, 0.0]), (100, [1.0, 9.0]), (100, [0.0, None]), *[(i, [float(i), 1.0]) for i in range(1, 8)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    # 50 asks with (1, 2) and 100 with (1, 9); as candidates both rows of an id count
    assert got == [(50, 1, 100), *[(50, k, 9 - k) for k in range(2, 6)], (100, 1, 50), (100, 2, 50), (100, 3, 7), (100, 4, 6), (100, 5, 5)]


def test_query_on_table_and_its_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op9_va_search(spark, sf)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows, 50)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, connection.sql(OP9_SQL).fetchall())) == brute(rows, 50)
