"""Near-duplicate groups: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm.graph import components
from hearthstat.llm.packets import Chunk, chunks
from hearthstat.llm.shared import save
from hearthstat.llm.words import Words, lower_ascii, mix

SHINGLE = 5
PERCENT = 75
BINS = 128
BANDS = 32
_DOC_BLOCK = 2048


def shingle_sets(chunk: Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, sorted by document and hash, and each document's bounds in them.

    A document of fewer words than a shingle has its whole word sequence as its one shingle; one without words has none.
    """
    sets, sizes = zip(*(_block_sets(block, shingle) for block in chunk.blocks()))
    return np.concatenate(sets), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def _block_sets(chunk: Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a block, one after the other, and their sizes."""
    words = Words(lower_ascii(chunk.data), chunk.offsets)
    hashes, valid = words.windows(shingle)
    at = np.flatnonzero(valid)
    docs, hashes = words.docs[at], hashes[at]
    for n in range(1, shingle):
        if len(short := np.flatnonzero(words.counts == n)):
            whole, _ = words.windows(n)
            docs = np.concatenate((docs, short))
            hashes = np.concatenate((hashes, mix(whole[words.firsts[short]] ^ np.uint64(n))))
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    docs, hashes = docs[new], hashes[new]
    return hashes, np.bincount(docs, minlength=len(chunk))


def band_keys(hashes: np.ndarray, bounds: np.ndarray, bins: int, bands: int) -> np.ndarray:
    """Band keys of documents whose sets are not empty, (documents, bands).

    The top bits of a hash name its bin and its other bits are its value, so a sorted set gives each bin's least value as
    the first of a run. An empty bin takes the value of the bin that its own sequence of random tries first finds filled.
    """
    n, shift = len(bounds) - 1, np.uint64(64 - (bins - 1).bit_length())
    low, high = bounds[0], bounds[-1]
    values = hashes[low:high]
    docs = np.repeat(np.arange(n), np.diff(bounds))
    cell = docs * bins + (values >> shift).astype(np.int64)
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    least = np.zeros(n * bins, np.uint64)
    full = np.zeros(n * bins, bool)
    least[cell[new]], full[cell[new]] = values[new], True
    todo = np.flatnonzero(~full)
    found, tries = least.copy(), 0
    while len(todo):
        tries += 1
        hop = mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tries)) % np.uint64(bins)
        source = todo - todo % bins + hop.astype(np.int64)[todo % bins]
        hit = full[source]
        found[todo[hit]] = least[source[hit]]
        todo = todo[~hit]
    rows = found.reshape(n, bands, bins // bands)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for r in range(bins // bands):
        keys = mix(keys ^ rows[:, :, r])
    return keys.view(np.int64)


def _signatures(docs: DataFrame, shingle: int, bins: int, bands: int) -> DataFrame:
    """For each row its number, id, text key, set size, digest of the set and band keys."""
    schema = "id long, doc long, text_key long, n_shingles long, digest binary, bands array<long>"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            hashes, bounds = shingle_sets(chunk, shingle)
            named = chunk.table.select(["id", "doc", "text_key"]).combine_chunks()
            for at in range(0, len(chunk), _DOC_BLOCK):
                sizes = np.diff(bounds[at : at + _DOC_BLOCK + 1])
                some = np.flatnonzero(sizes)
                keys = np.zeros((len(sizes), bands), np.int64)
                if len(some):
                    keys[some] = band_keys(hashes, np.append(bounds[at + some], bounds[at + some[-1] + 1]), bins, bands)
                digests = [xxhash.xxh3_128_digest(hashes[bounds[at + i] : bounds[at + i + 1]].tobytes()) if size else None for i, size in enumerate(sizes.tolist())]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                own = pa.Table.from_arrays([*named.slice(at, len(sizes)).columns, pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), listed], names=["id", "doc", "text_key", "n_shingles", "digest", "bands"])
                yield from own.combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """The full set of each row number. Rows that repeat an id and its text come one after the other, and count once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        last = None
        for chunk in chunks(batches, "text", limit=4 << 20):
            hashes, bounds = shingle_sets(chunk, shingle)
            ids = chunk.ids("id")
            new = np.ones(len(ids), bool)
            new[1:] = ids[1:] != ids[:-1]
            new[0] = ids[0] != last
            last = ids[-1]
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), listed], names=["id", "shingles"]).filter(pa.array(new))

    return texts.mapInArrow(run, "id long, shingles array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The many-to-one side is joined last, where AQE can split it."""
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(right, "b").join(left, "a")
        .where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both))
        .select("a", "b").distinct()
    )


def _prefix_mates(open_ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents of different components that can be similar: their rarest shingles meet.

    Of two sets with a similarity of p / 100 or more, ordered from the rarest shingle on, the first
    n - ceil(p n / 100) + 1 shingles of either hold a common one. What stands from their first common shingle on must be
    enough for the intersection. Copies that were each edited on their own have rare shingles of their own in front, and are no pair.
    """
    each = open_ids.join(sets.dropDuplicates(["id"]), "id").select("id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    rare = each.join(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shingle", "left")
    listed = rare.groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "shingle"))).alias("ranked"))
    front = F.slice("ranked", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    placed = listed.select("id", "component", "n", F.posexplode(front).alias("i", "x")).where("x.held > 1")
    fronts = placed.select("id", "component", "n", (F.col("n") - F.col("i")).alias("rest"), F.col("x.shingle").alias("shingle"))
    mixed = fronts.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    fronts = save(fronts.join(mixed, "shingle", "left_semi"), "op10-fronts")
    other = fronts.select("shingle", F.col("id").alias("b"), F.col("component").alias("component_b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
    near = (100 + percent) * F.least("rest", "rest_b") >= percent * (F.col("n") + F.col("n_b"))
    met = fronts.join(other, "shingle").where((F.col("id") < F.col("b")) & (F.col("component") != F.col("component_b")) & near)
    return met.select(F.col("id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, bands: int = BANDS, keyed: bool = False) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``percent`` / 100 or more of their sets of word shingles.

    Returns one row per input row: the id column, ``n_shingles``, ``component_id`` (the smallest id of its group), ``kept``; with ``keyed`` also
    ``text_key``, Spark's 64-bit hash of the text, which tells rows of one id apart.

    1. Documents with equal sets form a class, which takes part as one of its rows. Rows have numbers of their own, so neither
       null nor repeated ids join what is not similar.
    2. Each bucket of a band makes a star: its centre is the member that has the most bucket mates over all bands, as the original
       of a group of copies has. That is one pair per row, however large a bucket is, and mostly the same pairs in all bands.
    3. Pairs that differ too much in size go; all others are checked on the full sets. Links make components.
    4. A star may part two documents that are similar to each other but not to its centre. So all documents of buckets that hold several components
       yet are joined again, exactly, on the rarest shingles of their sets, across components: no link between bucket mates is lost.

    With bands of 4 bins a pair of similarity 0.75 misses all 32 bands with a chance of 5 in a million.

    A null or empty text, or one without words, has no shingles and links with nothing. A null id is no smallest id: ``component_id`` is null only if no
    row of the group has an id, and of those rows the one of least ``text_key`` is kept. Rows that repeat an id and its text stay or
    go together; rows that repeat an id with other texts are documents of their own. Other columns are not read. Empty in, empty out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    signed = save(_signatures(docs.withColumn("id", F.monotonically_increasing_id()), shingle, bins, bands), "op10-signatures")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.min("doc").alias("least"), F.min(F.when(F.col("doc").isNull(), F.col("text_key"))).alias("least_key"))
    classes = save(classes, "op10-classes")
    nodes = signed.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"]).select("id", "n_shingles", "bands")
    rows = nodes.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    mates = save(rows.join(shared, "key"), "op10-buckets")
    weights = mates.groupBy("id").agg(F.sum("members").alias("weight"))
    buckets = save(mates.join(weights, "id").select("key", "id", "n_shingles", "weight"), "op10-buckets")
    centres = buckets.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("order"), "id", "n_shingles")).alias("m")).select("key", F.col("m.id").alias("a"), F.col("m.n_shingles").alias("n_a"))

    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    star = buckets.join(centres, "key").select("key", "a", "n_a", F.col("id").alias("b"), F.col("n_shingles").alias("n_b"))
    pairs = star.where((F.col("a") != F.col("b")) & near).select("a", "b").distinct()
    wanted = signed.select("id", F.col("doc").alias("wanted_doc"), F.col("text_key").alias("wanted_key")).join(buckets.select("id").distinct(), "id", "left_semi")
    # the same plan at every size: texts are shuffled once, though a few ids could be broadcast; merged rows lie in the order of their ids
    texts = docs.join(wanted.hint("merge"), docs["doc"].eqNullSafe(F.col("wanted_doc")) & (docs["text_key"] == F.col("wanted_key"))).select("id", "text")
    sets = save(_sets(texts, shingle), "op10-sets")
    links = save(_similar(pairs, sets, percent), "op10-links")
    label = components(links)

    placed = buckets.select("key", "id").join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_ids = save(placed.join(mixed, "key", "left_semi").select("id", "component").distinct(), "op10-open")
    more = save(_similar(_prefix_mates(open_ids, sets, percent), sets, percent), "op10-links")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    group = save(classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "op10-groups")
    first = group.groupBy("component").agg(F.min("least").alias("component_id"), F.min("least_key").alias("least_key"))
    found = signed.select("doc", "text_key", "n_shingles", "digest").join(group.select("digest", "component").join(first, "component"), "digest", "left")
    alone = F.col("digest").isNull()
    nameless = F.col("component_id").isNull() & (F.col("text_key") == F.col("least_key"))
    kept = F.when(alone, True).when(F.col("doc").isNull(), nameless).otherwise(F.col("doc") == F.col("component_id"))
    shown = [F.col("doc").alias(id_col), "n_shingles", F.when(alone, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept")]
    return found.select(*shown, *(["text_key"] if keyed else []))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: DuckDB SQL of op10_near_duplicates, for tables whose ids do not repeat: all pairs that share a shingle, and their transitive closure.
OP10_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) AS x
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
    SELECT p.a AS a, p.b AS b FROM p JOIN n AS x ON p.a = x.doc_id JOIN n AS y ON p.b = y.doc_id WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)
), e AS (
    SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
    SELECT doc_id, doc_id AS reached FROM d
    UNION
    SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a
), g AS (
    SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, g.component_id AS component_id, d.doc_id = g.component_id AS kept
FROM d JOIN g ON d.doc_id = g.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
