"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Quality rules drop documents, near-dedup keeps one document of each group, substring dedup cuts repeated passages out of texts, mixing repeats
and cuts documents to the sources' target weights, and the encoder gives token ids. All stages but the last return the columns of documents.
Null texts and texts without words fail the quality rules; a null id, language or source is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthstat.llm.op1_quality import quality_rules
from hearthstat.llm.op3_bpe import digests, encode_and_decode, public_file
from hearthstat.llm.op4_mixing import WORD, mix
from hearthstat.llm.op7_substrings import dedup_substrings
from hearthstat.llm.op10_near_duplicates import near_duplicates
from hearthstat.llm.shared import save
from hearthstat.llm.stages import DOCUMENT


def _with_text(found: DataFrame, text) -> DataFrame:
    """The documents in ``row`` with another text, and their length in characters."""
    return found.select("row.*", text.alias("_text")).withColumn("text", F.col("_text")).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return quality_rules(docs, DOCUMENT).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group. Rows that repeat an id and its text are one document, the first by its other columns.

    A row is named by its id and a hash of its text. What goes is joined, not what stays: it is little, and texts need not move where Spark
    finds it small enough to broadcast.
    """
    found = save(near_duplicates(docs.select("doc_id", "text"), keyed=True), "near-duplicates")
    rows = found.groupBy(F.col("doc_id").alias("id"), "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    named = docs.select(*DOCUMENT)
    row = named["doc_id"].eqNullSafe(F.col("id")) & (F.xxhash64(named["text"]) == F.col("text_key"))
    left = named.join(rows.where("not kept or n > 1"), row, "left_anti")
    first = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")
    repeated = named.join(rows.where("kept and n > 1"), row, "left_semi").withColumn("_number", F.row_number().over(first)).where("_number = 1").drop("_number")
    return left.unionByName(repeated)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages; a text that has none stays as it is, white space included."""
    found = dedup_substrings(docs.select(*DOCUMENT))
    return _with_text(found, F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document; the last time it may take its first words only."""
    mixed = mix(docs, DOCUMENT)
    times = F.concat(F.array_repeat("size", F.col("passes").cast("int")), F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.array().cast("array<bigint>")))
    taken = mixed.where("taken > 0").select("row", "size", F.explode(times).alias("words"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    return _with_text(taken, F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(first))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix, and digests of the ids and of the text that they decode to."""
    return digests(encode_and_decode(docs.select("doc_id", "text"), public_file()), "ids")


STAGES = [
    ("quality rules", filter_quality),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express a language model, near-duplicate links or byte-pair encoding; tests hold every stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
