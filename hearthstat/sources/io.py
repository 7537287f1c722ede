"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_table(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """A catalog table ``schema.table``, or with ``root`` the Parquet data ``root/name.parquet``."""
    if root is None:
        return spark.table(name)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def jdbc_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options of a JDBC read of a query result.

    With a partition column the read is split into that many range queries, so no single task pulls the
    whole result; Spark accepts this only for ``dbtable``, hence the query goes in as a derived table.
    """
    options = {"url": url, "fetchsize": str(fetch_size), **extra}
    if partition_column is None:
        return {**options, "query": query}
    if lower is None or upper is None or not partitions:
        raise ValueError("a partitioned read needs lower, upper and partitions")
    return {
        **options,
        "dbtable": f"({query}) AS source_query",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_query(spark: SparkSession, query: str, jdbc: Mapping[str, object] | None = None) -> DataFrame:
    """Result of a SQL text: on catalog tables, or with ``jdbc`` (arguments of :func:`jdbc_options`) on a database."""
    if jdbc is None:
        return spark.sql(query)
    return spark.read.format("jdbc").options(**jdbc_options(query=query, **jdbc)).load()


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, header: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """CSV files with an explicit schema; nothing is inferred, so codes keep their zeros.

    All files must have the same header, with the schema's names in its order (unnamed columns may have any name in the schema). Of the first file it is
    checked at once, with a ``ValueError`` that tells the difference; a job over a file with another header fails, before it gives a value of a wrong column.
    ``mode`` is Spark's: with FAILFAST a value that does not fit its type fails the job instead of becoming NULL.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.schema(schema).option("header", header).option("mode", mode)
    if not header:
        return reader.csv(paths)
    names = schema.names
    first = spark.read.option("header", False).csv(paths).limit(1).collect()
    found = [name or "" for name in first[0]] if first else []
    _check_header(found, names)
    if all(found):
        return reader.option("enforceSchema", False).csv(paths)  # the reader checks the header of each file that it opens
    other = _headers(spark, paths, len(names)).where(F.col("header") != F.array(*map(F.lit, found))).first()
    if other is not None:
        raise ValueError(f"the headers {found} and {other['header']} do not fit each other")
    return reader.option("enforceSchema", True).csv(paths)


def _check_header(found: Sequence[str], names: Sequence[str]) -> None:
    if len(found) != len(names) or any(name and name != wanted for name, wanted in zip(found, names)):
        raise ValueError(f"the header {list(found)} does not fit the schema {list(names)}")


def _headers(spark: SparkSession, paths: Sequence[str], columns: int) -> DataFrame:
    """The header of each file: the first row of its first block. A longer one shows one name more than wanted; a shorter one ends in empty names."""
    text = StructType([StructField(f"_h{i}", StringType()) for i in range(columns + 1)])
    rows = spark.read.schema(text).option("header", False).csv(list(paths))
    row = F.array(*[F.coalesce(name, F.lit("")) for name in text.names])
    header = F.when(F.col(f"_h{columns}").isNull(), F.slice(row, 1, columns)).otherwise(row)
    starts = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), header.alias("header"))
    firsts = starts.where("block = 0").groupBy("file").agg(F.min(F.struct("row", "header")).alias("first"))
    return firsts.select("file", F.col("first.header").alias("header"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and no index column, one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Parquet, the default form for results that are read again."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: Sequence[str], buckets: int, mode: str = "errorifexists") -> None:
    """A catalog table in ``buckets`` files by a hash of the key, each sorted by it.

    Tables with as many buckets by the same key meet on it without a shuffle: a roll-up of households and persons, say.
    """
    key = list(key)
    laid = df.repartition(buckets, *key)
    laid.write.mode(mode).format("parquet").bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)


def literal_frame(spark: SparkSession, rows: Sequence[Sequence[object]], schema: StructType | str) -> DataFrame:
    """A small frame from values in the program text."""
    return spark.createDataFrame([tuple(row) for row in rows], schema)


def period_grid(spark: SparkSession, first: int, last: int, name: str = "months") -> DataFrame:
    """Consecutive integer periods, one row each."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def peek(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first few rows, for a look at the data."""
    return df.limit(rows)


def shape(df: DataFrame) -> tuple[int, int]:
    """Row and column count; runs one counting job."""
    return df.count(), len(df.columns)
