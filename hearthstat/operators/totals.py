"""Weighted totals, shares and the tables made from them.

Every function is a grouped aggregation with map-side combine, so neither a large group nor a large table
meets in one task before it has been reduced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.curves import ratio
from hearthstat.functions.predicates import as_column


def total_where(value, condition: Column | None = None, empty: str = "zero") -> Column:
    """Sum of a value over the rows that meet a condition.

    ``empty`` says what a group without such a row gets: ``zero`` (a sum of CASE ... ELSE 0) or ``null``
    (a sum with FILTER).
    """
    if empty not in ("zero", "null"):
        raise ValueError(f"unknown rule for empty groups: {empty}")
    x = as_column(value)
    if condition is None:
        return F.sum(x)
    chosen = F.when(condition, x)
    return F.sum(chosen.otherwise(F.lit(0)) if empty == "zero" else chosen)


def weighted_totals(
    df: DataFrame,
    weight: str,
    measures: Mapping[str, Column | None],
    by: Sequence[str] = (),
    empty: str = "zero",
) -> DataFrame:
    """Total weight per condition, for the whole table or per group."""
    sums = [total_where(weight, condition, empty).alias(name) for name, condition in measures.items()]
    return df.groupBy(*by).agg(*sums) if by else df.agg(*sums)


def plain_totals(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums of columns under their own names."""
    sums = [F.sum(name).alias(name) for name in columns]
    return df.groupBy(*by).agg(*sums) if by else df.agg(*sums)


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = (), name: str = "weighted_mean") -> DataFrame:
    """``sum(w x) / sum(w)`` over the rows where both are present."""
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    mean = ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(name)
    return rows.groupBy(*by).agg(mean) if by else rows.agg(mean)


def threshold_share(
    df: DataFrame,
    weight,
    inside: Column,
    by: Sequence[str] = (),
    digits: int = 2,
) -> DataFrame:
    """Total weight, weight inside a threshold band, and their ratio rounded half-even."""
    out = df.groupBy(*by) if by else df.groupBy()
    return out.agg(
        F.coalesce(F.sum(as_column(weight)), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(inside, as_column(weight))), F.lit(0)).alias("inside"),
    ).withColumn("share", F.bround(ratio("inside", "total"), digits))


def subgroup_change(totals: DataFrame, groups: Mapping[str, tuple[str, str]], digits: int = 2) -> DataFrame:
    """Long table of subgroups from one wide row: total, lost, and change in percent (negative for a loss).

    ``groups`` maps a label to the names of its total column and its lost column.
    """
    entries = [
        F.struct(
            F.lit(label).alias("subgroup"),
            F.col(total).cast("double").alias("total"),
            F.col(lost).cast("double").alias("lost"),
        )
        for label, (total, lost) in groups.items()
    ]
    return totals.select(F.inline(F.array(*entries))).withColumn(
        "percent_change", F.bround(-ratio("lost", "total") * 100, digits)
    )


def latest_period(df: DataFrame, period: str, reference: DataFrame | None = None) -> DataFrame:
    """Rows of the latest period, as found in the table itself or in a reference table, which is read once more for it.

    :func:`latest_rows` and :func:`latest_totals` read a table once.
    """
    newest = (df if reference is None else reference).select(F.max(period)).scalar()
    return df.where(F.col(period) == newest)


def latest_rows(df: DataFrame, period: str, key: Sequence[str]) -> DataFrame:
    """Rows of the latest period of the whole table, for a table with some periods per key.

    The rows of a key are listed in one aggregation, so a key should hold periods, not records; its newest period rides along, and the newest of
    all is found over the same exchange, which Spark makes once.
    """
    others = [name for name in df.columns if name not in key]
    listed = df.groupBy(*key).agg(F.collect_list(F.struct(period, *[name for name in others if name != period])).alias("_rows"))
    newest = listed.select(F.max(F.array_max("_rows")[period])).scalar()
    rows = listed.select(*key, F.explode("_rows").alias("_row")).select(*key, "_row.*")
    return rows.where(F.col(period) == newest).select(*df.columns)


def latest_totals(df: DataFrame, period: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row with the measures (sums and other aggregates) of the latest period: all periods in one pass, then the newest of them."""
    per_period = df.groupBy(period).agg(*[value.alias(name) for name, value in measures.items()])
    return per_period.agg(*[F.max_by(name, period).alias(name) for name in measures])


def order_nulls_last(df: DataFrame, *keys: str) -> DataFrame:
    """Ascending order with NULL at the end."""
    return df.orderBy(*[F.col(key).asc_nulls_last() for key in keys])


def top_k(df: DataFrame, value: str, k: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest value; rows without a value are no candidates."""
    return (
        df.where(F.col(value).isNotNull())
        .orderBy(F.col(value).desc(), *[F.col(name).asc() for name in tie_break])
        .limit(k)
    )


def summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum, maximum, mean and exact median (:func:`exact_median`) of a column."""
    x = F.col(column)
    reductions = [F.sum(x).alias("sum"), F.max(x).alias("max"), F.avg(x).alias("mean")]
    median = exact_median(df, column, by)
    if not by:
        return df.agg(*reductions).withColumn("median", median.select("median").scalar())
    keyed = median.withColumnsRenamed({name: f"_of_{name}" for name in by})
    return df.groupBy(*by).agg(*reductions).join(keyed, _same_group(by), "left").select(*by, "sum", "max", "mean", "median")


def _same_group(by: Sequence[str]) -> Column:
    return reduce(and_, [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in by])


_CELLS = 1 << 16
_POWERS = 64


def _power_cell(x: Column) -> Column:
    """Cell of a number by its sign and the logarithm of its size: ``_POWERS`` cells per power of two, in the order of the numbers."""
    size = F.floor(F.log2(F.abs(x)) * _POWERS).cast("int") + F.lit(1200 * _POWERS)
    last = F.lit(4000 * _POWERS)
    return F.when(F.isnan(x), last + 1).when(F.abs(x) == float("inf"), F.signum(x).cast("int") * last).when(x == 0, 0).otherwise(F.signum(x).cast("int") * size)


def _even_cell(x: Column) -> Column:
    """One of ``_CELLS`` equal cells between ``_low`` and ``_high``."""
    return F.when(F.col("_low") == F.col("_high"), 0).otherwise(F.floor((x - F.col("_low")) / (F.col("_high") - F.col("_low")) * (_CELLS - 1)).cast("int"))


def _middle_cell(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the counted cells of each group the one that holds the row of rank ``_rank``: its range, the rank in it, and the least value after it."""
    order = Window.partitionBy(*by).orderBy("_cell")
    before = F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cells.withColumns({"_before": before, "_after": F.coalesce(F.lead("_low").over(order), F.col("_after"))})
    here = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_rows"))
    return ranked.where(here).select(*by, "_n", (F.col("_rank") - F.col("_before")).alias("_rank"), "_rows", "_low", "_high", "_after")


def exact_median(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact median of a column, equal to ``F.median``: one row per group, or one row, if there is a value.

    By selection. Values are counted per cell of their size; the cell that holds the middle is cut into 65,536 equal ones, of which the one that holds it is cut
    again, and what is left are at most some ten thousand distinct numbers. Each of the four steps scans the values and sends counts, so no task
    holds the values of a group. NULL is left out, NaN is the largest value.
    """
    values = df.select(*by, F.col(column).cast("double").alias("_x")).where("_x IS NOT NULL")
    counted = [F.count(F.lit(1)).alias("_rows"), F.min("_x").alias("_low"), F.max("_x").alias("_high")]
    first = values.groupBy(*by, _power_cell(F.col("_x")).alias("_cell")).agg(*counted)
    total = F.sum("_rows").over(Window.partitionBy(*by))
    cells = first.withColumn("_n", total).withColumns({"_rank": F.floor((F.col("_n") - 1) / 2), "_after": F.lit(None).cast("double")})
    state = _middle_cell(cells, by)
    for cell in (_even_cell(F.col("_x")), _even_cell(F.col("_x")), F.col("_x")):
        kept = [F.max(c).alias(c) for c in ("_n", "_rank", "_after")]
        known = state.select(*by, "_n", "_rank", "_low", "_high", "_after")
        if by:  # one row per group on the right; adaptive execution splits a group that is too large for a task
            beside = values.join(known.withColumnsRenamed({c: f"_of_{c}" for c in by}), _same_group(by), "inner")
        else:
            beside = values.withColumn("_known", known.select(F.struct("*")).scalar()).select("_x", "_known.*")
        inside = beside.where((F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high")))
        state = _middle_cell(inside.withColumn("_cell", cell).groupBy(*by, "_cell").agg(*counted, *kept), by)
    one = (F.col("_n") % 2 == 1) | (F.col("_rank") + 1 < F.col("_rows"))
    return state.select(*by, F.when(one, F.col("_low")).otherwise(0.5 * F.col("_low") + 0.5 * F.col("_after")).alias(name))
