"""Operations on panels: one row per (series, period), as :func:`panel_totals` makes them from records.

The ordered operations use a window per series. Its size is the number of periods of the calendar, not the
number of records, because records are summed per period (with map-side combine) before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.curves import ratio


def panel_totals(
    records: DataFrame, by: Sequence[str], sums: Mapping[str, str], since: tuple[str, object] | None = None
) -> DataFrame:
    """Sums per series and period; rows with a NULL key are left out, ``since`` is a period column and its first value."""
    rows = records.dropna(how="any", subset=list(by))
    if since is not None:
        column, first = since
        rows = rows.where(F.col(column) >= first)
    return rows.groupBy(*by).agg(*[F.sum(source).alias(name) for name, source in sums.items()])


def panel_reduce(panel: DataFrame, by: Sequence[str], how: Mapping[str, str]) -> DataFrame:
    """Group a panel with one named reduction per column (sum, max, min, avg, count)."""
    functions = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}
    return panel.groupBy(*by).agg(*[functions[reduction](name).alias(name) for name, reduction in how.items()])


def with_parsed_date(df: DataFrame, column: str, pattern: str, name: str) -> DataFrame:
    """Date parsed from text; NULL where the text does not fit the pattern."""
    return df.withColumn(name, F.try_to_timestamp(F.col(column), F.lit(pattern)).cast("date"))


def _ordered(by: Sequence[str] | None, period: str) -> Window:
    """Window over the periods of a series. One series alone is one task, so the caller has to say so with ``by=()``."""
    if by is None:
        raise ValueError("name the columns of the series, or pass by=() if the whole table is one series of periods")
    return Window.partitionBy(*by).orderBy(period)


def _over_series(panel: DataFrame, by: Sequence[str], aggregate: Column) -> Column:
    """An aggregate over each series; over the whole table without a window."""
    return aggregate.over(Window.partitionBy(*by)) if by else panel.agg(aggregate.alias("_all")).scalar()


def period_diff(panel: DataFrame, value: str, period: str, by: Sequence[str] | None = None, name: str = "difference") -> DataFrame:
    """Change against the previous period of the series; 0 for the first period and next to a NULL."""
    change = F.col(value) - F.lag(value, 1).over(_ordered(by, period))
    return panel.withColumn(name, F.coalesce(change, F.lit(0)))


def running_total(panel: DataFrame, value: str, period: str, by: Sequence[str] | None = None, name: str = "running") -> DataFrame:
    """Sum of the series up to and including the period."""
    window = _ordered(by, period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return panel.withColumn(name, F.sum(value).over(window))


def share_of_total(panel: DataFrame, value: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Part of the series total; NULL when the total is zero."""
    return panel.withColumn(name, ratio(F.col(value), _over_series(panel, by, F.sum(value))))


def first_value(panel: DataFrame, value: str, period: str, by: Sequence[str] | None = None, name: str = "first") -> DataFrame:
    """Value of the first period of the series, on every row."""
    return panel.withColumn(name, F.first(value).over(_ordered(by, period)))


def set_value(panel: DataFrame, column: str, where: Column, value) -> DataFrame:
    """The column with another value on the rows that meet a condition."""
    return panel.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))


def spread_in_proportion(
    panel: DataFrame, value: str, amount: Column, by: Sequence[str] = (), name: str = "spread"
) -> DataFrame:
    """The value plus an amount handed out in proportion to the value itself."""
    shared = share_of_total(panel, value, by, "_part")
    return shared.withColumn(name, F.col(value) + F.col("_part") * amount).drop("_part")


def align(
    panel: DataFrame, series: DataFrame, period: str, series_period: str, offset: int, by: Sequence[str] = ()
) -> DataFrame:
    """A second series beside the panel, its period shifted by ``offset``; NULL where it has no period."""
    shifted = series.withColumn(period, F.col(series_period) + offset).drop(
        *([series_period] if series_period != period else [])
    )
    return panel.join(shifted, [*by, period], "left")


def mean_after_first(panel: DataFrame, value: str, period: str, by: Sequence[str] = (), name: str = "mean") -> DataFrame:
    """Mean of the series without its first period."""
    later = F.col(period) > _over_series(panel, by, F.min(period))
    kept = panel.withColumn("_later", later)
    mean = F.avg(F.when(F.col("_later"), F.col(value))).alias(name)
    return kept.groupBy(*by).agg(mean) if by else kept.agg(mean)


def first_periods(panel: DataFrame, period: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first n periods of each series (ranked per task before the shuffle)."""
    if not by:
        return panel.orderBy(period).limit(n)
    ranked = panel.withColumn("_rank", F.row_number().over(_ordered(by, period)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")
