import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from hearthstat.llm.op7_substrings import dedup_substrings, longest_repeats, op7_substring_dedup

LAST = 2**63 - 1


def brute(rows, length):
    texts = [(LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for doc, words in texts:
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            first[window] = min(first.get(window, (doc, s)), (doc, s))
    out = []
    for doc, words in texts:
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            if first[tuple(words[s : s + length])] < (doc, s):
                gone[s : s + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    rows = df.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return sorted((LAST if r[0] is None else r[0], *tuple(r)[1:]) for r in rows)


@pytest.mark.parametrize("first", [5, 10, 20])
def test_like_brute_force(spark, first):
    rnd = random.Random(first)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 300)))) for i in range(12)]
    rows += [(None, "a " * 50), (30, None), (31, ""), (32, "x y z " * 30), (32, "x y z " * 30), (33, "é\x0bñ\x85   " * 45), (40, "a " * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(dedup_substrings(df, length=20, first=first)) == brute(rows, 20)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "w " * 45, 7, "c")], "doc_id long, text string, n_words int, chunk string")
    assert dedup_substrings(df.limit(0)).count() == 0
    row = dedup_substrings(df).collect()[0]
    assert row["row"].asDict() == {"doc_id": 1, "text": "w " * 45, "n_words": 7, "chunk": "c"}
    assert (row["n_words"], row["n_removed"], row["kept"]) == (45, 44, "w")


def test_doubling_goes_on_until_nothing_repeats(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[50:220])), (3, " ".join(words[100:125] + ["x"] * 3)), (4, "a b c"), (5, None)]
    rows += [(6, " ".join(rnd.choice("abcdefgh") for _ in range(300))), (7, "z " * 100)]
    seen = {}
    for doc, text in rows:
        own = (text or "").split()
        for n in (20, 40, 80, 160, 320):
            for s in range(len(own) - n + 1):
                seen.setdefault((n, tuple(own[s : s + n])), []).append(doc)
    want = {doc: max([k[0] for k, docs in seen.items() if doc in docs and len(docs) > 1], default=0) for doc, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["row"]["doc_id"]: r["longest"] for r in longest_repeats(df).collect()} == want == {1: 160, 2: 160, 3: 20, 4: 0, 5: 0, 6: 0, 7: 80}
    assert longest_repeats(df.limit(0)).count() == 0


def test_query_on_table(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op7_substring_dedup(spark, sf).collect())) == brute(rows, 20)
