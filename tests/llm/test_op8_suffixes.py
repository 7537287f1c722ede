import hashlib
import os
import random

import numpy as np
import pytest

from hearthstat.llm.op8_suffixes import multikey_order, op8_suffix_dedup, remove_repeats

LAST = 2**63 - 1


def brute(rows, length):
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for doc, data in texts:
        for s in range(len(data) - length + 1):
            string = data[s : s + length]
            first[string] = min(first.get(string, (doc, s)), (doc, s))
    out = []
    for doc, data in texts:
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < (doc, s):
                gone[s : s + length] = True
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    rows = df.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted((LAST if r[0] is None else r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in rows)


@pytest.mark.parametrize("hot", [3, 20_000])
def test_like_brute_force(spark, hot):
    rnd = random.Random(7)
    passages = ["".join(rnd.choice("abé ") for _ in range(n)) for n in (99, 100, 101, 130, 180, 400)]
    rows = []
    for i in range(40):
        text = "".join(rnd.choice(passages)[rnd.randint(0, 20) :] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 60))) for _ in range(3))
        rows.append((i, text))
    rows += [(None, passages[5]), (50, None), (51, ""), (52, "q" * 350), (52, "q" * 350), (53, "ab" * 120), (60, "q" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(remove_repeats(df, hot=hot)) == brute(rows, 100)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "w" * 120, 7)], "doc_id long, text string, n_bytes int")
    assert remove_repeats(df.limit(0)).count() == 0
    row = remove_repeats(df).collect()[0]
    assert row["row"]["n_bytes"] == 7 and (row["n_bytes"], row["n_removed"], row["n_spans"], bytes(row["kept"])) == (120, 119, 1, b"w")


def test_multikey_order_is_the_stable_byte_order():
    rnd = np.random.default_rng(1)
    rows = rnd.integers(0, 2, (500, 21), dtype=np.uint8)
    rows[::3] = rows[0]
    want = sorted(range(500), key=lambda i: (rows[i].tobytes(), i))
    assert multikey_order(rows).tolist() == want


def test_query_on_table(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op8_suffix_dedup(spark, sf).collect())) == brute(rows, 100)
