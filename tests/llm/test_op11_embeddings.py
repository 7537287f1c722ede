import math
import os
import random

import duckdb
import numpy as np
import pytest

from hearthstat.llm.op11_embeddings import OP11_SQL, Index, near_vectors, op11_embedding_groups


def brute(rows, cosine=0.98):
    """Sorted (id, n_links, component_id, kept) from all pairs."""
    able = [label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, label, v in rows]
    unit = [None] * len(rows)
    for k, (_, _, v) in enumerate(rows):
        if able[k]:
            x = np.array(v, float)
            x = x / np.abs(x).max()
            unit[k] = x / math.sqrt(float(x @ x))
    links = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if able[a] and able[b] and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= cosine:
                links[a].append(b)
                links[b].append(a)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        todo = [a] if group[a] == a else []
        while todo:
            for c in links[todo.pop()]:
                if group[c] > a:
                    group[c] = a
                    todo.append(c)
    least = {}
    for (i, _, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return sorted(((i, len(links[k]), least[group[k]], i == least[group[k]]) for k, (i, _, _) in enumerate(rows)), key=str)


def vectors(rnd, n, width, spread):
    """Clusters of near copies whose cosines lie on both sides of the limit, and single vectors."""
    out, base = [], None
    for _ in range(n):
        if base is None or rnd.random() < 0.2:
            base = [rnd.gauss(0, 1) for _ in range(width)]
        out.append([float(np.float32(x + rnd.gauss(0, spread * rnd.random()))) for x in base])
    return out


SCHEMA = "vec_id long, label int, embedding array<{}>"


@pytest.mark.parametrize("options", [{}, {"list_rows": 4, "sample": 320, "block": 16}, {"list_rows": 30, "sample": 64, "block": 7, "parts": 3}])
def test_like_all_pairs(spark, options):
    rnd = random.Random(11)
    rows = [(1000 + i, rnd.choice([1, 1, 2, None]), v) for i, v in enumerate(vectors(rnd, 400, 12, 0.3))]
    rows += [(5000 + i, 1, rows[0][2]) for i in range(40)] + rows[3:9]
    rows += [(None, 1, rows[0][2]), (None, 2, [9.0] * 12), (None, 2, [9.5] * 12), (7, 1, None), (8, 1, [0.0] * 12), (9, 1, [None] * 12), (10, 1, [math.nan] * 12), (11, 1, [math.inf] * 12), (12, 1, []), (13, 1, [1.0]), (14, 1, [2.0]), (15, 2, [1.0]), (16, 1, [-1.0])]
    df = spark.createDataFrame(rows, SCHEMA.format("float")).selectExpr("*", "1 as node", "'x' as kept", "2 as n_links").repartition(4)
    assert sorted(map(tuple, near_vectors(df, **options).collect()), key=str) == brute(rows)


def test_doubles_of_any_size(spark):
    rnd = random.Random(12)
    rows = [(i, 1, [x * 10.0 ** rnd.choice([-300, 0, 290]) for x in (rnd.choice([1.0, 1.02]), rnd.choice([1.0, 0.8, -1.0]))]) for i in range(60)]
    rows += [(100 + i, 1, v) for i, v in enumerate([[1e300, 1e300], [5e-324, 0.0], [1.0, 0.0], [-0.0, 3.0], [0.0, 4.0]])]
    assert sorted(map(tuple, near_vectors(spark.createDataFrame(rows, SCHEMA.format("double")), list_rows=5, sample=96).collect()), key=str) == brute(rows)
    assert near_vectors(spark.createDataFrame([], SCHEMA.format("float"))).count() == 0
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(1, None, [1.0]), (None, 3, None)], SCHEMA.format("float"))).orderBy("vec_id").collect()] == [(None, 0, None, True), (1, 0, 1, True)]


def test_lists_leave_most_pairs_uncompared_and_lose_no_link():
    rng = np.random.default_rng(13)
    base = rng.normal(size=(3000, 64))
    points = np.concatenate([base, base[:300] + rng.normal(size=(300, 64)) * 0.02 * rng.integers(1, 9, (300, 1))])
    points /= np.linalg.norm(points, axis=1)[:, None]
    index = Index([(p.tobytes(), 64) for p in points[:1600]], 50, 16, 0.2)
    own, visits, codes, off = index.place(points)
    assert visits.mean() < 0.3
    tried, found = 0, set()
    for of in range(len(index.centres)):
        members, visitors = np.flatnonzero(own == of), np.flatnonzero(visits[:, of])
        q, m = index.candidates(points[visitors], of, codes[members], off[members])
        tried += len(q)
        found |= {tuple(sorted(x)) for x in zip(visitors[q].tolist(), members[m].tolist()) if x[0] != x[1]}
    cosines = points @ points.T
    wanted = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cosines >= 0.98, 1)))}
    assert len(wanted) > 150 and wanted <= found
    assert tried < 0.01 * len(points) ** 2


def test_query_on_table_and_its_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    got = op11_embedding_groups(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    rnd = random.Random(14)
    some = [(i, rnd.choice([1, 2, None]), v) for i, v in enumerate(vectors(rnd, 150, 8, 0.3))] + [(900, 1, None), (901, 1, [0.0] * 8)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE embeddings (vec_id BIGINT, label INT, embedding FLOAT[])")
    connection.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", some)
    assert sorted(connection.sql(OP11_SQL).fetchall(), key=str) == brute(some)
