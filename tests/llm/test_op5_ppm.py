import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthstat.llm.op5_ppm import adaptive_score, op5_ppm, ppm_scores


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def symbol_cost(trie, seen, context, symbol):
    total, excluded = 0.0, set()
    for j in range(context, -1, -1):
        node = {s: c for s, c in trie.get(seen[len(seen) - j :], {}).items() if s not in excluded}
        if not node:
            continue
        weight = sum(node.values()) + len(node)
        if symbol in node:
            return total + math.log10(node[symbol] / weight)
        total += math.log10(len(node) / weight)
        excluded |= node.keys()
    return total - math.log10(256 - len(excluded))


def trie_of(texts, context):
    trie = {}
    for text in texts:
        data = b"\xfe" * context + text + b"\xff"
        for i in range(context, len(data)):
            for j in range(context + 1):
                node = trie.setdefault(data[i - j : i], {})
                node[data[i]] = node.get(data[i], 0) + 1
    return trie


def brute(rows, context=5):
    """rows: (id, text, train); a trie learnt symbol by symbol and walked symbol by symbol."""
    train = [lowered(t) for _, t, own in rows if own]
    trie = trie_of([t.encode() for t in train], context)
    counts = Counter(w for t in train for w in re.findall(r"[^\x20\x09-\x0D]+", t))
    n, v = sum(counts.values()) + len(train), len(counts) + bool(train)
    out = {}
    for i, text, _ in rows:
        data = b"\xfe" * context + lowered(text).encode() + b"\xff"
        score = sum(symbol_cost(trie, data[k - context : k], context, data[k]) for k in range(context, len(data)))
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        c = [counts[w] for w in words] + [len(train)]
        out[i] = (len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c), score)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][:3] == row[:3], i
        assert got[i][3:] == pytest.approx(row[3:], rel=1e-6, abs=1e-6), i


def test_like_a_trie_walked_symbol_by_symbol(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("aAbc é\n") for _ in range(rnd.randint(0, 120))), i % 3 != 0) for i in range(30)]
    rows += [(100, None, True), (101, "", False), (102, "漢字zz\x00q", False), (103, "abcab" * 40, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").withColumn("score", F.lit("clash"))
    got = {r["row"]["doc_id"]: tuple(r)[1:] for r in ppm_scores(df).collect()}
    same(got, brute(rows))
    assert ppm_scores(df.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    rows = [(1, "ab", False), (2, None, None)]
    got = {r["row"]["doc_id"]: tuple(r)[1:] for r in ppm_scores(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()}
    assert got[1] == pytest.approx((2, 0, 0, 0.0, 3 * -math.log10(256))) and got[2] == pytest.approx((1, 0, 0, 0.0, -math.log10(256)))


def test_probabilities_after_a_context_sum_to_one():
    trie = trie_of([b"abracadabra", b"abba"], 3)
    for seen in (b"abr", b"zzb", b"\xfe\xfe\xfe", b"qqq"):
        assert sum(10 ** symbol_cost(trie, seen, 3, s) for s in range(256)) == pytest.approx(1)


def test_adaptive_code_is_shorter_for_repetition():
    assert adaptive_score(b"") == pytest.approx(-math.log10(256))
    assert adaptive_score(b"abcd" * 50) > adaptive_score(bytes(random.Random(1).choices(range(97, 123), k=200))) + 100


def test_query_on_table(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [(r[0], r[1], zlib.crc32(str(r[0]).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[2:] for r in op5_ppm(spark, sf).collect()}
    same(got, brute(rows))
