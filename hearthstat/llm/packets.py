"""Key exchange in packets: what a chunk of documents asks of the whole corpus, and what it is told.

Counting every window or n-gram of a corpus as rows of its own would shuffle many times the corpus. Here a *chunk* (some
8 MB of whole documents of one scan task) sends every distinct key once, as sorted, delta-coded and compressed arrays cut into ranges of
the key space. A range meets its packets from all chunks in one group, merges them, and answers each packet with a
small array aligned with the keys sent. A key that fills a third of the corpus is one entry per chunk, so no range is hot.
The documents themselves follow as compressed packs, one per chunk, and meet their answers in a cogroup on the chunk.

A chunk is named by a hash of its content. If a table read twice gave other chunks the second time, answers and packs
would not meet; ``meet`` raises then, rather than lose a document.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.shared import give_back, shuffle_partitions, text_bytes

CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
RANGE_BYTES = 64 << 20
REQUEST = "step int, part int, chunk long, n int, keys binary, a binary, b binary, c binary"
ANSWER = "step int, part int, chunk long, n int, keys binary, a binary, b binary, c binary"
PACK = "chunk long, pack binary"


def ranges_for(docs: DataFrame, text_col: str, range_bytes: int = RANGE_BYTES) -> int:
    """Number of key ranges: grows with the text, so that a range stays small at every size."""
    return max(shuffle_partitions(docs.sparkSession), -(-text_bytes(docs, text_col) // range_bytes), 1)


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Compressed bytes of an array; ``rising`` unsigned values are kept as differences. Equal byte places lie together."""
    if rising and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(body: bytes, dtype, rising: bool = False) -> np.ndarray:
    """Inverse of ``squeeze``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 31), np.uint8)
    size = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if rising else values


def split_rising(keys: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Places where sorted keys of ``bits`` bits pass from one of ``parts`` equal ranges to the next; parts + 1 values."""
    edges = np.array([-(-(p << bits) // parts) for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


class Chunk:
    """Some whole documents of one scan task: ``table`` with all columns, and their texts as one buffer with offsets."""

    def __init__(self, table: pa.Table, text_col: str):
        self.table = table
        texts = pc.fill_null(table[text_col].cast(pa.large_string()), "")
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(self.offsets[0]), int(self.offsets[-1])) if len(texts) else (0, 0)
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = self.offsets - low if len(texts) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return self.table.num_rows

    def ids(self, id_col: str) -> np.ndarray:
        """Document ids; a null id counts as the largest there is."""
        return pc.fill_null(self.table[id_col].cast(pa.int64()), np.iinfo(np.int64).max).to_numpy().astype(np.int64)

    def blocks(self, limit: int = BLOCK_BYTES) -> Iterator[Chunk]:
        """The same documents some ``limit`` bytes at a time, as views: what is computed document by document needs room for a block only."""
        low = 0
        while low < len(self) or not low:
            high = min(max(int(np.searchsorted(self.offsets, self.offsets[low] + limit, side="right")) - 1, low + 1), len(self))
            block = copy.copy(self)
            block.table = self.table.slice(low, high - low)
            block.offsets = self.offsets[low : high + 1] - self.offsets[low]
            block.data = self.data[self.offsets[low] : self.offsets[high]]
            yield block
            low = max(high, 1)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def name(self, id_col: str) -> int:
        """Hash of ids and texts, as a signed 64-bit number."""
        state = xxhash.xxh3_64(self.ids(id_col).tobytes())
        state.update(self.offsets.tobytes())
        state.update(self.data)
        return int(np.uint64(state.intdigest()).astype(np.int64))


def chunks(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts the rows of a task into chunks; where to cut depends on the rows alone, not on how they are batched. Gives memory back after the last one."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text_col))), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, size in enumerate(sizes.tolist()):
            total += size + 64
            if total >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield Chunk(pa.Table.from_batches(held), text_col)
                held, total, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        last, held = Chunk(pa.Table.from_batches(held), text_col), []
        yield last
        del last
    give_back()


def to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of REQUEST, ANSWER or PACK as a record batch."""
    return pa.RecordBatch.from_arrays([pa.array(list(column), type=kind) for column, (_, kind) in zip(zip(*rows), _arrow(schema))], names=[name for name, _ in _arrow(schema)])


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [(field.split()[0], kinds[field.split()[1]]) for field in schema.split(",")]


def cut(step: int, chunk: int, keys: np.ndarray, places: np.ndarray, **values: np.ndarray) -> Iterator[tuple]:
    """Request rows of sorted keys, one for each range that has keys."""
    for part in np.flatnonzero(np.diff(places)).tolist():
        low, high = places[part], places[part + 1]
        yield (step, part, chunk, int(high - low), squeeze(keys[low:high], rising=True), *(squeeze(values[v][low:high]) if v in values else None for v in "abc"))


def requests(docs: DataFrame, id_col: str, text_col: str, ask: Callable[[Chunk, int], Iterable[tuple]], limit: int = CHUNK_BYTES) -> DataFrame:
    """Requests of all chunks; ``ask(chunk, name)`` gives rows of REQUEST."""

    def run(batches):
        for chunk in chunks(batches, text_col, limit):
            if rows := list(ask(chunk, chunk.name(id_col))):
                yield to_batch(rows, REQUEST)

    return docs.mapInArrow(run, REQUEST)


def packs(docs: DataFrame, id_col: str, text_col: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """All chunks as compressed packs, named as in ``requests`` over the same ``docs``."""

    def run(batches):
        for chunk in chunks(batches, text_col, limit):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, chunk.table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(chunk.table.combine_chunks())
            yield to_batch([(chunk.name(id_col), sink.getvalue().to_pybytes())], PACK)

    return docs.mapInArrow(run, PACK)


def unpacked(pack: bytes, text_col: str) -> Chunk:
    """The chunk in a pack."""
    return Chunk(pa.ipc.open_stream(pa.py_buffer(pack)).read_all(), text_col)


def requests_beside(docs: DataFrame, beside: DataFrame, id_col: str, text_col: str, ask: Callable[[Chunk, int, dict], Iterable[tuple]], limit: int = CHUNK_BYTES) -> DataFrame:
    """Requests of all chunks, each asked beside its row of ``beside`` (``chunk`` and others): ``ask(chunk, name, row)``.

    Packs and rows are joined on the chunk: Spark broadcasts ``beside`` if its size allows that, and shuffles both if not.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if not row["met"]:
                    raise RuntimeError("an unknown chunk: the input changed between two reads")
                if rows := list(ask(unpacked(row.pop("pack"), text_col), row["chunk"], row)):
                    yield to_batch(rows, REQUEST)
        give_back()

    return packs(docs, id_col, text_col, limit).join(beside.withColumn("met", F.lit(True)), "chunk", "left").mapInArrow(run, REQUEST)


def answers(asked: DataFrame, merge: Callable[[list[dict]], Iterable[tuple]]) -> DataFrame:
    """Answers to requests: ``merge(packets)`` gets all packets of one step and range, and gives rows of ANSWER. Gives memory back after each range."""

    def run(table: pa.Table) -> pa.Table:
        out = rows_table(merge(table.to_pylist()), ANSWER)
        give_back()
        return out

    return asked.groupBy("step", "part").applyInArrow(run, ANSWER)


def meet(packed: DataFrame, told: DataFrame, text_col: str, use: Callable[[Chunk, int, dict], pa.Table], schema: str | T.StructType) -> DataFrame:
    """Every chunk with its answers, as {step: {part: answer row}}; ``use(chunk, name, answers)`` gives the result's rows. Gives memory back after each chunk."""

    def run(left: pa.Table, right: pa.Table):
        if not left.num_rows:
            raise RuntimeError("answers for an unknown chunk: the input changed between two reads")
        name = left["chunk"][0].as_py()
        found: dict = {}
        for row in right.to_pylist():
            found.setdefault(row["step"], {})[row["part"]] = row
        out = []
        for pack in left["pack"]:
            out.append(use(unpacked(pack.as_py(), text_col), name, found))
        del found
        give_back()
        return pa.concat_tables(out)

    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def flags_of(found: dict, step: int, places: np.ndarray) -> np.ndarray:
    """The bits that were answered for all keys of a chunk, in key order."""
    out = np.zeros(places[-1], bool)
    for part in np.flatnonzero(np.diff(places)).tolist():
        row = found.get(step, {}).get(part)
        if row is None or row["n"] != places[part + 1] - places[part]:
            raise RuntimeError("no answer for a packet: the input changed between two reads")
        out[places[part] : places[part + 1]] = np.unpackbits(np.frombuffer(row["a"], np.uint8))[: row["n"]].astype(bool)
    return out


def values_of(found: dict, step: int, places: np.ndarray, dtype, column: str = "a") -> np.ndarray:
    """The numbers that were answered for all keys of a chunk, in key order."""
    out = np.zeros(places[-1], dtype)
    for part in np.flatnonzero(np.diff(places)).tolist():
        row = found.get(step, {}).get(part)
        if row is None or row["n"] != places[part + 1] - places[part]:
            raise RuntimeError("no answer for a packet: the input changed between two reads")
        out[places[part] : places[part + 1]] = expand(row[column], dtype)
    return out


def merge_presence(packets: list[dict]) -> Iterator[tuple]:
    """For each key sent: whether another chunk has sent it too, or the bit in ``a`` is set already; one bit."""
    keys = [expand(p["keys"], np.uint64, rising=True) for p in packets]
    distinct, count = np.unique(np.concatenate(keys), return_counts=True)
    distinct = distinct[count > 1]
    for p, own in zip(packets, keys):
        bits = np.isin(own, distinct, assume_unique=True) if len(distinct) else np.zeros(len(own), bool)
        if p["a"] is not None:
            bits |= expand(p["a"], np.uint8).astype(bool)
        yield (p["step"], p["part"], p["chunk"], p["n"], None, np.packbits(bits).tobytes(), None, None)


def merge_earliest(packets: list[dict]) -> Iterator[tuple]:
    """For each key sent with document id (a) and place (b): whether no other chunk has it at a smaller id and place, one bit."""
    keys = [expand(p["keys"], np.uint64, rising=True) for p in packets]
    whole, ids, places = np.concatenate(keys), np.concatenate([expand(p["a"], np.int64) for p in packets]), np.concatenate([expand(p["b"], np.int64) for p in packets])
    order = np.lexsort((places, ids, whole))
    whole, ids, places = whole[order], ids[order], places[order]
    new = np.concatenate(([True], whole[1:] != whole[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(whole)), 0))
    bits = np.empty(len(whole), bool)
    bits[order] = (ids == ids[head]) & (places == places[head])
    at = 0
    for p, own in zip(packets, keys):
        yield (p["step"], p["part"], p["chunk"], p["n"], None, np.packbits(bits[at : at + len(own)]).tobytes(), None, None)
        at += len(own)


class Earliest:
    """Items of a chunk by key, each key with its earliest document id and place in the chunk; asks if others have it earlier."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, places: np.ndarray, parts: int):
        self.order = np.lexsort((places, ids, keys))
        keys, self.ids, self.at = keys[self.order], ids[self.order], places[self.order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.heads, self.which = np.flatnonzero(new), np.cumsum(new) - 1
        self.keys = keys[self.heads]
        self.places = split_rising(self.keys, parts)

    def ask(self, step: int, name: int) -> Iterator[tuple]:
        """Requests for ``merge_earliest``."""
        return cut(step, name, self.keys, self.places, a=self.ids[self.heads].astype(np.int64), b=self.at[self.heads].astype(np.int64))

    def later(self, found: dict, step: int) -> np.ndarray:
        """Indices of the items whose key also stands at a smaller id or place, here or in another chunk."""
        if not len(self.order):
            return self.order
        head = self.heads[self.which]
        here = flags_of(found, step, self.places)[self.which]
        return self.order[(self.ids != self.ids[head]) | (self.at != self.at[head]) | ~here]


def whole_rows(table: pa.Table) -> pa.Array:
    """The columns of a table as one struct column, so that no name can clash with a result's."""
    merged = table.combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in merged.columns]
    columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.StructArray.from_arrays(columns, fields=list(merged.schema))


def with_row(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with only the named columns, in that order."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def rows_table(rows: Iterable[tuple], schema: str = REQUEST) -> pa.Table:
    """Rows of a packet schema as a table, empty ones too."""
    rows = list(rows)
    return pa.Table.from_batches([to_batch(rows, schema)]) if rows else pa.schema(_arrow(schema)).empty_table()
