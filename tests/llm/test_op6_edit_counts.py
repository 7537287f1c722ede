import os
import random
import re

from tokenizers import Tokenizer

from hearthstat.llm.bpe import Bpe, PieceEncoder, piece_encoder
from hearthstat.llm.op3_bpe import public_file
from hearthstat.llm.op6_edit_counts import SegmentTree, build_trees, edit_trees, op6_edit_counts, plain_ends, redactions, tree_sums


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def opened(text, encoder, run=64):
    return SegmentTree(text, *next(tree_sums([text], encoder, run)), encoder)


def applied(text, edits):
    for start, length, put in edits:
        text = text[:start] + put + text[start + length :]
    return text


def test_random_edits_like_counting_the_whole_text_again():
    library, encoder, rnd = Tokenizer.from_file(public_file()), piece_encoder(public_file()), random.Random(3)
    word = lambda: "".join(rnd.choice("abcdehtE'é1! <|>") for _ in range(rnd.randint(1, 7)))
    for trial in range(60):
        text = rnd.choice(["", " \n", "\t"]) + "".join(word() + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(rnd.randint(0, 80)))
        run = rnd.choice([1, 2, 8])
        tree = opened(text, encoder, run)
        for _ in range(12):
            if rnd.random() < 0.3:  # written and opened again
                tree = SegmentTree(tree.text, *tree.sums, encoder)
            start, length = rnd.randint(-2, len(text) + 3), rnd.choice([0, 1, 3, 20, 400])
            put = rnd.choice(["", " ", word(), f"{word()} {word()}", "<|endoftext|>", f"\n{word()}"])
            tree.edit(start, length, put)
            low = max(0, min(start, len(text)))
            text = text[:low] + put + text[low + length :]
            assert tree.text == text and tree.tokens[1] == count(library, text) and tree.chars[1] == len(text)


def test_sums_of_many_texts_at_once():
    library, encoder = Tokenizer.from_file(public_file()), piece_encoder(public_file())
    texts = ["", " ", "a", "one two  three\n\n four", "\n\nx y", "é\x85ü z\u2003w", "w " * 300, "", "end"]
    for run in (1, 3, 64):
        for text, (chars, tokens) in zip(texts, tree_sums(texts, encoder, run)):
            assert sum(chars) == len(text) and sum(tokens) == count(library, text) and len(chars) == len(tokens) >= 1


def test_runs_of_all_texts_are_cut_at_once():
    encoder, rnd = PieceEncoder(Bpe(public_file())), random.Random(6)
    encoder._encode = None  # no piece goes through the way for single edits
    texts = ["", " ", " \n", "a", " a", "a ", "", "é\x85ü z\u2003w \x0b\x1cq"] + ["".join(rnd.choice("aé漢🙂 \n\t") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    for run in (1, 2, 5, 64):
        for text, (chars, tokens) in zip(texts, tree_sums(texts, encoder, run), strict=True):
            own = re.findall(rf"(?:[ \t-\r]*[^ \t-\r]+[ \t-\r]*){{1,{run}}}|[ \t-\r]+", text) or [""]
            assert chars == [*map(len, own)] and len(tokens) == len(own)
    plain = [f"{'abc'[i % 3]}{'xyz'[i // 3 % 3] * (i % 7 + 1)}" for i in range(100)]
    encoder.bpe.split_plainly = None  # nor do plain words go to the splitting pattern
    assert sum(next(tree_sums([" ".join(plain)], encoder))[1]) == count(Tokenizer.from_file(public_file()), " ".join(plain))


def test_an_edit_encodes_little():
    encoder = piece_encoder(public_file())
    tree = opened("some words here " * 20000, encoder)
    tree.edit(123456, 3, "XYZ")
    assert tree.encoded <= 130


def test_second_round_edits():
    for text in ("", "  ", "a\n\n\n\nb\n\n\nc \n\n\n\n", "plain", "\n\n\n", "a\n\n\nb"):
        assert applied(text, plain_ends(text)) == __import__("re").sub("\n{3,}", "\n\n", text.rstrip(" \t\n\x0b\f\r"))


def test_kept_trees_through_two_rounds_of_edits(spark):
    library = Tokenizer.from_file(public_file())
    kind = "doc_id long, text string, e array<struct<start:int,length:int,text:string>>, n_edits int"
    rows = [(1, "a b c", [(0, 1, "zz"), (2, 99, "")], 7), (2, None, [(5, 5, "new text")], 7), (3, "x", None, 7), (4, "y z", [None, (0, None, "q")], 7), (4, "y z", [], 7), (None, "many words " * 500, [(7, 1, "Q")], 7)]
    df = spark.createDataFrame(rows, kind).selectExpr("*", "'t' as tokens", "1 as row")
    trees = build_trees(df, public_file(), ["doc_id", "e", "n_edits"])
    once = edit_trees(trees, public_file(), "e")
    got = once.collect()
    assert sorted(r["text"] for r in got) == sorted(["new text", "x", "y z", "y z", "zz", "many woQds " + "many words " * 499])
    assert {r["row"]["n_edits"] for r in got} == {7} and {r["n_edits"] for r in got} == {0, 1, 2}
    assert all(r["n_tokens"] == count(library, r["text"]) == sum(r["tokens"]) and sum(r["chars"]) == len(r["text"]) for r in got)
    assert all(r["n_encoded"] <= 130 for r in got)
    twice = edit_trees(once, public_file(), lambda text: [(0, 0, "front ")] if len(text) > 9 else [], "more", "pieces").collect()
    assert {(r["more"], r["pieces"] > 0) for r in twice} == {(0, False), (1, True)} and max(r["pieces"] for r in twice) <= 130
    assert all(r["n_tokens"] == count(library, r["text"]) for r in twice)
    assert edit_trees(build_trees(df.limit(0), public_file(), ["doc_id"]), public_file(), redactions).count() == 0


def test_query_on_table(spark):
    library = Tokenizer.from_file(public_file())
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    edits = 0
    for r in op6_edit_counts(spark, sf).collect():
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == count(library, text)
        own = list(redactions(text))
        text = applied(text, own)
        assert (r["n_edits"], r["n_tokens_after"]) == (len(own), count(library, text))
        more = list(plain_ends(text))
        text = applied(text, more)
        assert (r["n_edits_second"], r["n_tokens_second"]) == (len(more), count(library, text))
        assert bool(own) == bool(r["n_encoded"]) or not own
        edits += len(own)
    assert edits
