"""Tables that cut lineage, written as Parquet in the folder that every executor sees; and what a worker does with memory it has done with."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session whose executors are threads of the driver may do without."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def save(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder and read again: computed once, and safe from the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column, one aggregate over a scan of that column."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: a worker waits for its next task with some 100 MB less."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
