import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest
import test_op1_quality
import test_op7_substrings
import test_op10_near_duplicates
from tokenizers import Tokenizer

import corpus_pipeline
from hearthstat.llm.op3_bpe import public_file
from hearthstat.llm.op4_mixing import targets
from hearthstat.llm.shared import save
from hearthstat.llm.stages import DOCUMENT


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = save(stage(spark, docs, sf), "test-stage")
        out.append((docs.collect(), result.collect(), result.columns))
        docs = result
    return out


def test_columns(stages):
    assert all(columns == DOCUMENT for _, _, columns in stages[:-1])


def test_quality_keeps_whole_documents_that_pass(stages):
    given, kept, _ = stages[0]
    assert {tuple(r) for r in kept} <= {tuple(r) for r in given}
    passing = {r["doc_id"] for r in given if not test_op1_quality.counts(r["text"])[5]}
    assert {r["doc_id"] for r in kept} <= passing and len(kept) > 0.9 * len(passing)


def test_one_document_of_each_group_stays(stages):
    given, kept, _ = stages[1]
    want = {r[0] for r in test_op10_near_duplicates.brute([(r["doc_id"], r["text"]) for r in given]) if r[3]}
    assert {tuple(r) for r in kept} == {tuple(r) for r in given if r["doc_id"] in want} and len(kept) == len(want) < len(given)


def test_repeated_words_are_cut(stages):
    given, kept, _ = stages[2]
    want = {r[0]: r[3] for r in test_op7_substrings.brute([(r["doc_id"], r["text"]) for r in given], 20)}
    assert {r["doc_id"]: hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() for r in kept} == want
    before = {r["doc_id"]: r["text"] for r in given}
    assert all(r["text"] == before[r["doc_id"]] or len(words(r["text"])) < len(words(before[r["doc_id"]])) for r in kept)


def test_mix_comes_near_its_targets(stages):
    given, kept, _ = stages[3]
    size, source, text = ({r["doc_id"]: f(r) for r in given} for f in (lambda r: len(words(r["text"])), lambda r: r["source"], lambda r: r["text"]))
    total, taken = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    for r in kept:
        taken[r["source"]] += len(words(r["text"]))
        assert r["text"] == text[r["doc_id"]] or words(r["text"]) == words(text[r["doc_id"]])[: len(words(r["text"]))]
    assert max(Counter(r["doc_id"] for r in kept).values()) <= 2
    order = sorted(total, key=lambda s: (s is None, s or ""))
    for s, goal in zip(order, targets([total[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])):
        assert abs(taken[s] - goal) <= 40


def test_encoding_like_the_library(stages):
    given, kept, _ = stages[4]
    library = Tokenizer.from_file(public_file())
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in given)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in kept) == want


def test_run_and_odd_rows(spark, tmp_path):
    prose = lambda k: " ".join(f"word{(k * 7919 + j * j) % 997}" for j in range(40))
    rows = [(i, prose(i), "en" if i % 2 else None, None if i % 3 else "s", 1) for i in range(30)]
    rows += [(None, prose(100), None, None, None), (None, prose(100), None, None, None), (40, None, "en", "s", 0), (41, "", "en", "s", 0), (5, prose(5), "en", None, 1), (50, prose(5), "en", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as kept", "1 as size")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r["doc_id"] for r in out} <= {*range(30), None} and all(r["n_tokens"] == len(r["ids"]) > 0 for r in out)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_rows_without_an_id_are_lost_for_no_other(spark):
    prose = lambda k: " ".join(f"word{(k * 7919 + j * j) % 9973}" for j in range(60))
    rows = [(None, prose(1), "en", "s", 1), (None, prose(2), "en", "s", 1), (None, prose(3), None, "s", 1), (4, prose(1) + " end", "en", "s", 1)]
    rows += [(7, prose(5), "en", "s", 1), (7, prose(5), "de", "t", 1), (7, prose(5), "de", "s", 1), (7, prose(6), "en", "s", 1), (None, prose(8), "en", "b", 1), (None, prose(8), "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert got == {rows[1], rows[2], rows[3], rows[6], rows[7], rows[9]}
