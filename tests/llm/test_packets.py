import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from hearthstat.llm import packets
from hearthstat.llm.op1_quality import Facts, _places
from hearthstat.llm.op7_substrings import _Level
from hearthstat.llm.op10_near_duplicates import shingle_sets
from hearthstat.llm.words import Words

TYPES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])


def chunk(texts):
    rows = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts)}
    return packets.Chunk(pa.Table.from_pydict(rows, schema=TYPES), "text")


def sample(n, words):
    rnd = random.Random(5)
    return [" ".join(rnd.choice(["Ä", "b#c", "word", "x\ny", "Of"]) + str(rnd.randrange(50)) for _ in range(rnd.randrange(words))) for _ in range(n)]


@pytest.mark.parametrize("limit", [1, 300, 1 << 20])
@pytest.mark.parametrize("texts", [[], [None], ["", None, "a b " * 200, "", "c"], sample(40, 60)])
def test_blocks_are_the_documents_in_order(texts, limit):
    whole = chunk(texts)
    blocks = list(whole.blocks(limit))
    assert [b.text(i) for b in blocks for i in range(len(b))] == [(t or "").encode() for t in texts]
    assert [i for b in blocks for i in b.ids("doc_id").tolist()] == list(range(len(texts)))
    assert all(len(b.data) <= limit or len(b) == 1 for b in blocks)


def test_work_in_blocks_changes_nothing(monkeypatch):
    whole = chunk([*sample(60, 90), None, "", "one two", "a b c d e f g " * 300])
    found = []
    for limit in (1 << 20, 500):
        monkeypatch.setattr(packets.Chunk.blocks, "__defaults__", (limit,))
        places, (hashes, bounds) = _places(whole, 7, "lang"), shingle_sets(whole, 5)
        facts = Facts.unpack(places["facts"][len(places) - 1].as_py())
        found.append([places.drop_columns("facts").to_pydict(), *([x.tolist() for x in vars(facts).values()]), hashes.tolist(), bounds.tolist()])
    assert found[0] == found[1]


@pytest.mark.parametrize("length", [1, 5, 70_000])
def test_windows_across_blocks(length):
    # blocks of 65,536 words; the words come again every eight, so the windows do
    long, short = chunk(["a b c d e f g h " * 20_000]), chunk(["a b c d e f g h " * (length // 8 + 2)])
    hashes, valid = Words(long.data, long.offsets).windows(length)
    few, _ = Words(short.data, short.offsets).windows(length)
    assert np.array_equal(valid, np.arange(160_000) <= 160_000 - length)
    assert np.array_equal(hashes[valid], np.tile(few[:8], 20_000)[: valid.sum()]) and not hashes[~valid].any()


def test_level_is_what_unique_finds():
    hashes = np.random.default_rng(1).integers(0, 40, 500).astype(np.uint64) << np.uint64(16)
    for alive in (np.arange(500) % 3 > 0, np.zeros(500, bool)):
        level = _Level(hashes, alive, 4)
        keys, which, count = np.unique(hashes[alive] >> np.uint64(16), return_inverse=True, return_counts=True)
        assert np.array_equal(level.keys, keys) and np.array_equal(level.which, which) and np.array_equal(level.count, count)


@pytest.mark.parametrize("work", [lambda c: _places(c, 7, "lang"), lambda c: shingle_sets(c, 5)])
def test_room_for_a_block_not_for_the_chunk(work):
    whole = chunk(["the quick brown fox jumps over %d lazy dogs " % i * 40 for i in range(4000)])
    tracemalloc.start()
    try:
        work(whole)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * len(whole.data)  # over 15 times the text when the chunk was worked on at once


class Caught:
    """Stands for a DataFrame: gives the function that Spark would run on each group."""

    def groupBy(self, *names):
        return self

    def cogroup(self, other):
        return self

    def applyInArrow(self, run, schema):
        return run


def test_memory_is_given_back_after_each_group(monkeypatch):
    given = []
    monkeypatch.setattr(packets, "give_back", lambda: given.append(1))
    row = {"step": 0, "part": 0, "chunk": 1, "n": 1, "keys": packets.squeeze(np.array([5], np.uint64), rising=True), "a": None, "b": None, "c": None}
    asked = packets.rows_table([tuple(row.values())])
    told = packets.answers(Caught(), packets.merge_presence)(asked)
    assert told.num_rows == 1 and len(given) == 1
    assert packets.answers(Caught(), lambda rows: [])(asked).num_rows == 0 and len(given) == 2
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TYPES) as out:
        out.write_table(chunk(["a", None]).table)
    left = pa.table({"chunk": [1], "pack": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    use = lambda own, name, found: pa.table({"n": [len(own)], "parts": [len(found[0])]})
    assert packets.meet(Caught(), Caught(), "text", use, "n long, parts long")(left, told).to_pylist() == [{"n": 2, "parts": 1}]
    assert len(given) == 3
