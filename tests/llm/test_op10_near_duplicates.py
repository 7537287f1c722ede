import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from hearthstat.llm.graph import components
from hearthstat.llm.op10_near_duplicates import band_keys, near_duplicates, op10_near_duplicates


def brute(rows):
    """Links by full comparison of documents that share a shingle; groups by union."""
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[j : j + 5]) for j in range(len(words) - 4)])))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets:
        for x in s:
            holders.setdefault(x, []).append(i)
    by_id = dict(sets)
    for a, b in {tuple(sorted((x, y))) for h in holders.values() for x in h for y in h if x < y}:
        if 100 * len(by_id[a] & by_id[b]) >= 75 * len(by_id[a] | by_id[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def varied(seed, n):
    rnd = random.Random(seed)
    base = [rnd.choice("abcdefgh") + rnd.choice("xyzw") for _ in range(60)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(60)] = f"q{rnd.randrange(9)}"
        rows.append((i * 3 + 1, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "a B"), (903, "A b"), (904, "a b c"), (905, "  ")]


def test_like_brute_force_with_groups_that_need_second_centres(spark):
    rows = varied(2, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash"))
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)


def test_empty_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "z")], "doc_id long, text string")
    assert near_duplicates(df.limit(0)).count() == 0
    assert sorted(map(str, near_duplicates(df).collect())) == sorted([
        "Row(doc_id=None, n_shingles=2, component_id=5, kept=False)",
        "Row(doc_id=5, n_shingles=2, component_id=5, kept=True)",
        "Row(doc_id=5, n_shingles=2, component_id=5, kept=True)",
        "Row(doc_id=7, n_shingles=1, component_id=7, kept=True)",
    ])


def prose(k, changed=0):
    return " ".join("new" if j < changed else f"word{(k * 7919 + j * j) % 9973}" for j in range(90))


def test_rows_that_share_an_id_are_not_joined_by_it(spark):
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(3)), (5, prose(1, 1)), (None, prose(4)), (None, prose(4, 1)), (None, prose(4)), (6, prose(6)), (6, prose(7)), (8, prose(7, 1)), (2**63 - 1, prose(8)), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by_text = {}
    for r in near_duplicates(df, keyed=True).join(df.select("text", F.xxhash64("text").alias("text_key")).distinct(), "text_key").collect():
        by_text.setdefault((r.doc_id, r.text), set()).add((r.component_id, r.kept))
    assert all(len(found) == 1 for found in by_text.values()) and len(by_text) == len(set(rows))
    got = {key: next(iter(found)) for key, found in by_text.items()}
    assert got[None, prose(1)] == (5, False) and got[5, prose(1, 1)] == (5, True)
    assert got[None, prose(2)] == got[None, prose(3)] == got[None, ""] == (None, True)
    assert sorted([got[None, prose(4)], got[None, prose(4, 1)]]) == [(None, False), (None, True)]
    assert got[6, prose(6)] == got[6, prose(7)] == (6, True) and got[8, prose(7, 1)] == (6, False)
    assert got[2**63 - 1, prose(8)] == (2**63 - 1, True)


def test_very_long_text(spark):
    rows = [(1, prose(1) * 3000), (2, prose(1) * 3000 + " end"), (3, prose(2))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3)]


def test_query_on_table(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op10_near_duplicates(spark, sf).collect())) == brute(rows)


def test_bands_agree_as_often_as_similarity_says():
    rnd = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        whole = rnd.integers(0, 2**64, 14, dtype=np.uint64)
        a, b = np.sort(whole[:13]), np.sort(whole[1:])
        keys = band_keys(np.concatenate((a, b)), np.array([0, 13, 26]), 128, 32)
        hits += int((keys[0] == keys[1]).sum())
    assert abs(hits / 6400 - (12 / 14) ** 4) < 0.06


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (60, 61), (61, 62), (60, 62)], "a long, b long")
    got = {r[0]: r[1] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 60: 60, 61: 60, 62: 60}
    assert components(links.limit(0)).count() == 0
