"""The join forms that need care at scale: many rows per key against one row per key, and tables that must hold a key once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows, and more than so many rows at all.
SHARES = 64
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, on: Sequence[str], shares: int = SHARES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys that hold more than ``hot_rows`` rows and more than one in ``shares`` of all: ``on`` and ``pieces``, at most ``shares`` each.

    There are fewer than ``shares`` of them, whatever the table. One aggregation with map-side combine over the key columns alone.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.select(F.sum("_rows")).scalar()
    pieces = F.ceil(F.col("_rows") * shares / total).cast("int").alias("pieces")
    return counts.where((F.col("_rows") > hot_rows) & (F.col("_rows") * shares > total)).select(*on, pieces)


def _same(on: Sequence[str], prefix: str, null_safe: bool) -> Column:
    out = F.lit(True)
    for name in on:
        other = F.col(f"{prefix}{name}")
        out = out & (F.col(name).eqNullSafe(other) if null_safe else F.col(name) == other)
    return out


def salted_join(
    many: DataFrame, one: DataFrame, on: Sequence[str], how: str = "inner", shares: int = SHARES, hot_rows: int = HOT_ROWS,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``many`` (any number of distinct rows per key) with ``one`` (few rows per key, mostly one).

    The keys of ``many`` are counted first. Rows of a hot key (see :func:`hot_keys`) are dealt over as many pieces as its share asks for, and only its
    rows of ``one`` are copied, once per piece; all other rows join as they are. The hot keys are fewer than ``shares`` and are broadcast. The piece
    is a hash of the row, so a recomputed task deals the same rows; equal rows share a piece, so sum repeated rows up before. A key that
    ``one`` holds twice doubles the rows of ``many``: :func:`one_per_key` fails on such tables. ``how`` is ``inner`` or ``left``; ``null_safe`` lets NULL keys meet.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join: {how}")
    hot = hot_keys(many, on, shares, hot_rows)
    hot = F.broadcast(hot.withColumnsRenamed({name: f"_hot_{name}" for name in on}))
    gone = [f"_hot_{name}" for name in on]
    pieces = F.coalesce("pieces", F.lit(1))
    dealt = many.join(hot, _same(on, "_hot_", null_safe), "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), pieces).cast("int"))
    copies = one.join(hot, _same(on, "_hot_", null_safe), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    dealt, copies = dealt.drop("pieces", *gone), copies.drop("pieces", *gone)
    if not null_safe:
        return dealt.join(copies, [*on, "_salt"], how).drop("_salt")
    keyed = copies.withColumnsRenamed({name: f"_one_{name}" for name in (*on, "_salt")})
    same = (F.col("_salt") == F.col("_one__salt")) & _same(on, "_one_", True)
    return dealt.join(keyed, same, how).drop("_salt", "_one__salt", *[f"_one_{name}" for name in on])


def one_per_key(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of a table that must hold a key once; a job over a key that stands twice fails.

    Without this, a key that stands twice would silently double totals. Rows without a key meet nothing and are left out. The rows are counted in a
    window over the key, on which the join partitions and sorts anyway.
    """
    rows = F.count(F.lit(1)).over(Window.partitionBy(*on))
    keys = F.concat_ws(", ", *[F.col(name).cast("string") for name in on])
    repeated = F.raise_error(F.concat(F.lit(f"{', '.join(on)} must be unique; repeated: "), keys)).cast("boolean")
    return df.dropna(how="any", subset=list(on)).withColumn("_rows", rows).where(F.when(F.col("_rows") == 1, True).otherwise(repeated)).drop("_rows")
