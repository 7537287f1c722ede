"""Encoding of whole texts to token ids and back, with the vocabulary of a tokenizer file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.bpe import borders_of, cut_pieces, piece_encoder
from hearthstat.llm.packets import chunks, whole_rows

BLOCK_BYTES = 1 << 20


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all input columns), ``ids`` (the text's tokens) and ``decoded`` (the text that the ids give back).

    ``path`` is a tokenizer file that every executor can read at that place. One pass without a shuffle: texts are cut at white space, which no token spans; of each
    distinct piece that is not remembered, longest matches are proposed, all adjacent pairs are tested together, and only words
    that fail are merged exactly. What is remembered is bounded, whatever the corpus holds.

    A null or empty text has no tokens and decodes to an empty text. Special tokens that a text spells out are encoded as such.
    Rows stand for themselves: repeats and ties change nothing, and other columns travel in ``row``.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for chunk in chunks(batches, text_col, BLOCK_BYTES):
            pieces, _, texts = cut_pieces(chunk.data, chunk.offsets)
            flat, sizes = encoder.columns(pieces)
            borders = borders_of(sizes)[texts]
            decoded = encoder.bpe.decode_all(flat, borders)
            ids = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([whole_rows(chunk.table), ids, decoded], names=["row", "ids", "decoded"])

    return docs.mapInArrow(run, T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL("ids array<int>, decoded string").fields]))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded text; then the columns in ``more``."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), *more)


def public_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode_and_decode(docs, public_file()))
