import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hearthstat.llm.op4_mixing import apportion, mix, op4_mixing, targets


def one_by_one(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in zip(votes, caps) if v > 0))):
        best = max((i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def test_apportionment_gives_to_the_highest_quotient():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 9)
        votes = [rnd.choice([0, 1, 2, 5, 10, rnd.random() * 50]) for _ in range(n)]
        caps = [rnd.randint(0, 12) for _ in range(n)]
        seats = rnd.randint(0, 40)
        assert apportion(np.array(votes), seats, np.array(caps)).tolist() == one_by_one(votes, seats, caps)
    assert apportion(np.array([53, 24, 23]), 7, np.array([99] * 3)).tolist() == [3, 2, 2]


def test_targets_are_shared_again():
    assert targets([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert targets([10, 1000, 1000], [5, 2, 1])[0] == 20.0
    assert targets([], []) == []


def check(rows, got, block):
    """Every source's taken words come within a block of its target."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    by_source = defaultdict(int)
    for i, _, s in rows:
        by_source[s] += size[i]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets([by_source[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    taken = defaultdict(int)
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by_source[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= block, (s, taken[s], want[s])


def brute(sizes, sources):
    """Words taken of documents by their place in the seeded order of their source, one shard a source, blocks dealt one by one."""
    order = sorted(set(sources), key=lambda s: (s is None, s or ""))
    totals = [sum(n for n, s in zip(sizes, sources) if s == x) for x in order]
    goals = targets(totals, [(5, 2, 1)[k % 3] for k in range(len(order))])
    block = max(1, min(16, min(t for t in totals if t) // 50))
    seats = one_by_one(goals, round(sum(goals) / block), [-(-2 * t // block) for t in totals])
    out = [0] * len(sizes)
    for x, goal, given, total in zip(order, goals, seats, totals):
        left = 2 * total if goal >= 2 * total else min(given * block, 2 * total)
        for _ in range(2):
            for k, (n, s) in enumerate(zip(sizes, sources)):
                if s == x:
                    out[k] += min(n, left)
                    left -= min(n, left)
    return out


def test_like_dealing_block_by_block(spark):
    rnd = random.Random(6)
    for scale in (1, 30, 400):
        rows = [(rnd.choice([i, i, None, 7]), " ".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 2 * scale))), rnd.choice(["a", "b", None, "c"])) for i in range(80)]
        rows += rows[:9]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        ordered = df.withColumn("o", F.xxhash64(F.lit(41), "doc_id", "text")).withColumn("n", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).orderBy("o", F.col("doc_id"), "n").collect()
        want = brute([r.n for r in ordered], [r.source for r in ordered])
        for parts in (1, 5):
            got = mix(df.repartition(parts), ["doc_id", "text", "source"]).collect()
            assert sorted((str(r.row), r.taken) for r in got) == sorted((str(Row(doc_id=r.doc_id, text=r.text, source=r.source)), w) for r, w in zip(ordered, want))


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, "one two three four five six", f"s{i:02d}") for i in range(60)]
    check(rows, mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).selectExpr("row.doc_id", "size", "source_size", "target", "taken").collect(), 1)
    rows += [(100 + i, "w " * 5000, "zz") for i in range(40)]
    check(rows, mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).selectExpr("row.doc_id", "size", "source_size", "target", "taken").collect(), 1)


def test_mix_on_small_shards_and_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randint(1, 120)), rnd.choice(["b", "a", None, "é", "z", "a", "a"])) for i in range(600)]
    rows += [(900, None, "a"), (901, "", "only empty"), (902, "\x0b \x85 ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target")
    out = mix(df, ["doc_id", "size"], shard=500).selectExpr("row.doc_id", "size", "source_size", "target", "taken", "row.size as own").collect()
    check(rows, out, 16)
    again = mix(df.repartition(7), ["doc_id", "size"], shard=500).selectExpr("row.doc_id", "taken").collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: r["taken"] for r in again}
    assert mix(df.limit(0), ["doc_id"]).count() == 0


def test_query_on_table(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(rows, op4_mixing(spark, sf).collect(), 16)
