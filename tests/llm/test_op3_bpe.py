import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hearthstat.llm.bpe import Bpe, PieceEncoder, cut_pieces
from hearthstat.llm.op3_bpe import digests, encode_and_decode, op3_bpe, public_file


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_file())


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


ODD = [None, "", "   ", "Hello World's don'T I'LL <|endoftext|>x<|ENDOFTEXT|> <|startoftext|><|endoftext|>", "ΑΣ σΣ ΟΔΟΣ İi ß ẞ ǅ", "é ́a á̧ 한글 한", "a b\u0085c d​e　f \x1c\x1dg \x00h",
       "1234 ½ ٣٤ Ⅷ²", "🙂👍🏽 — …!!!??", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "ﬁ Å Ω K", "'s's't 'S ''s", "漢字かなカナ ไทย العربية हिन्दी"]


def test_like_the_library_on_odd_texts(spark, library):
    rnd = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (5, "a b"), (5, "a b")]
    rows += [(100 + i, "".join(rnd.choice("abcdeilnorst hTHE'é.,<|>endoftx") for _ in range(rnd.randint(0, 200)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as ids")
    got = digests(encode_and_decode(df, public_file())).collect()
    assert sorted(map(tuple, got), key=str) == expected(library, rows)
    assert encode_and_decode(df.limit(0), public_file()).count() == 0


def test_speculation_agrees_with_exact_merging():
    bpe = Bpe(public_file())
    rnd = random.Random(9)
    tokens = [n.removesuffix(bpe.end) for n in bpe.vocab]
    words = ["".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 4))) for _ in range(20000)] + tokens
    assert bpe.encode_words(words) == bpe.merge(words) == [bpe._merge_long([bpe.vocab[x] for x in w[:-1]] + [bpe.vocab[w[-1] + bpe.end]]) for w in words]
    flat, owner, _ = bpe.propose(words[:2000])
    proposed = [[] for _ in range(2000)]
    for word, token in zip(owner.tolist(), flat.tolist()):
        proposed[word].append(token)
    kept = sum(own == exact for own, exact in zip(proposed, bpe.merge(words[:2000])))
    assert 200 < kept < 2000  # both ways are taken


def test_plain_words_are_split_like_all_others():
    bpe = Bpe(public_file())
    assert bpe.whole_letters and bpe.parted
    for text in ("Word", "WORD.", "grüße,", "ÿ", "é!", "É?", "Straße", "İx", "ǅ", "naïve;", "a.b", ".", "it's", "x" * 99, "Σας", "\u00e9\u0301", "e\u0301", "ª", "ﬁ"):
        own = bpe.split(text)
        bpe.whole_letters = False
        assert own == bpe.split(text), text
        bpe.whole_letters = True


def test_what_is_remembered_is_bounded():
    encoder = PieceEncoder(Bpe(public_file()), keep=100)
    whole = PieceEncoder(encoder.bpe)
    for n in range(0, 2000, 50):
        pieces = [f"w{i}x".encode() for i in range(n, n + 50)] * 2
        assert encoder(pieces) == whole(pieces)
    assert len(encoder.new) + len(encoder.old) <= 350


def cut(texts):
    raw = [(t or "").encode() for t in texts]
    pieces, starts, before = cut_pieces(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [b"".join(raw)[a : a + len(p)] for a, p in zip(starts.tolist(), pieces.to_pylist())] == pieces.to_pylist()
    return pieces, before


def test_pieces_of_many_texts_are_cut_at_once():
    for texts in ([], [""], ["", " ", ""], ODD, ["ab", "c", "", " d ", "e\x0bf\x85g\u3000h"], ["a "], [" a", "b"]):
        pieces, before = cut(texts)
        own = [(t or "").encode().split() for t in texts]
        assert [pieces.to_pylist()[a:b] for a, b in zip(before[:-1], before[1:])] == own


def test_columns_of_pieces_like_single_pieces():
    rnd = random.Random(8)
    letters = "abcXYZéÉßẞÿŸ÷×ªµΣσK·.,;:!?'<|>endoftx1²\u0301\u3000"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(4000)] + ["<|endoftext|>", "x<|endoftext|>", "É.", ".", "..", "don't"]
    pieces, _ = cut(" ".join([t or "", "Common", "word,", "straße!"]) for t in texts)
    single, encoder = PieceEncoder(Bpe(public_file())), PieceEncoder(Bpe(public_file()), keep=500)
    expect = single(pieces.to_pylist())
    for low, high in ((0, 0), (0, 1), (1, 1000), (1000, 3000), (500, 6000), (0, len(pieces))):  # most are met again, and forgotten
        flat, sizes = encoder.columns(pieces.slice(low, high - low))
        ends = np.cumsum([0, *sizes])
        assert [tuple(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])] == expect[low:high]
    encoder = PieceEncoder(encoder.bpe, keep=500)
    for low in range(0, len(pieces), 300):
        encoder.columns(pieces.slice(low, 300))
        assert len(encoder.held) <= 1600 and len(encoder.held_sizes) == len(encoder.met) == len(encoder.held) and len(encoder.held_flat) == encoder.held_sizes.sum()


def test_plain_pieces_are_not_split_one_by_one():
    bpe, seen = Bpe(public_file()), []
    own = bpe.split_plainly
    bpe.split_plainly = lambda text: [seen.append(text), own(text)][1]
    rnd = random.Random(2)
    plain = list({"".join(rnd.choice("abcdeXYéßÄ") for _ in range(rnd.randint(1, 12))) + rnd.choice(["", ".", ","]) for _ in range(5000)})
    PieceEncoder(bpe).columns(pa.array([p.encode() for p in [*plain, "it's", "a-b"]], pa.large_binary()))
    assert sorted(seen) == ["a-b", "it's"]


def test_query_on_table(spark, library):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op3_bpe(spark, sf).collect()), key=str) == expected(library, rows)
