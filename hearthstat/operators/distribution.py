"""Weighted histograms, cumulative distributions and threshold classes.

Rows are summed per bin with map-side combine, where the range has to be found after a first scan for it; after that a group has at
most ``bins`` rows, which is the only size the collected arrays and the running-total window ever see.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.curves import ratio
from hearthstat.operators.joins import salted_join


@dataclass(frozen=True)
class Population:
    """A sub-population: who belongs to it, its value column and its weight."""

    where: Column
    value: Column
    weight: Column


def stack_populations(df: DataFrame, populations: Mapping[str, Population]) -> DataFrame:
    """Long form ``population, value, weight`` of several, possibly overlapping populations in one pass."""
    entries = [
        F.when(
            spec.where,
            F.struct(
                F.lit(label).alias("population"),
                spec.value.cast("double").alias("value"),
                spec.weight.alias("weight"),
            ),
        )
        for label, spec in populations.items()
    ]
    return df.select(F.inline(F.array_compact(F.array(*entries))))


def _known(x: str) -> Column:
    """The value, NULL where it is NaN."""
    return F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))


def _finite(x: str) -> Column:
    """The value, NULL where it is NaN or infinite: an infinite value is outside every range that is found in the data."""
    return F.when(F.abs(_known(x)) < float("inf"), F.col(x).cast("double"))


def _bin_index(x: Column, lo: Column, width: Column, bins: Column) -> Column:
    """Left-closed bin of a value at or above ``lo``, corrected against the bin edges; the last bin is closed."""
    rough = F.floor((x - lo) / width)
    settled = (
        F.when(x < lo + rough * width, rough - 1).when(x >= lo + (rough + 1) * width, rough + 1).otherwise(rough)
    )
    return F.greatest(F.least(settled, bins - 1), F.lit(0)).cast("int")


def _complete(binned: DataFrame, by: Sequence[str], bins: int, edges: tuple[Column, Column] | None = None) -> DataFrame:
    """One row per group and bin, empty bins included.

    Input: by columns, ``_bin`` (NULL outside the range), ``_w``, ``_lo``, ``_width``; ``edges`` are a known first edge and
    width, which hold for a table without rows, too.
    """
    per_bin = binned.groupBy(*by, "_bin").agg(
        F.sum("_w").alias("_w"), F.max("_lo").alias("_lo"), F.max("_width").alias("_width")
    )
    filled = per_bin.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_w")))).alias("_bins"),
        F.sum("_w").alias("total"),
        F.max("_lo").alias("_lo"),
        F.max("_width").alias("_width"),
    )
    if edges is not None:
        filled = filled.withColumns({"_lo": edges[0], "_width": edges[1]})
    left = F.col("_lo") + F.col("bin") * F.col("_width")
    return (
        filled.select(*by, "_bins", "total", "_lo", "_width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .select(
            *by,
            "bin",
            left.alias("bin_left"),
            (left + F.col("_width")).alias("bin_right"),
            F.coalesce(F.try_element_at("_bins", F.col("bin")), F.lit(0)).alias("weight"),
            F.coalesce("total", F.lit(0)).alias("total"),
        )
    )


def weighted_hist(
    df: DataFrame, x: str, weight: str, lo: float, hi: float, step: float, by: Sequence[str] = (),
    groups: Sequence[str] = (),
) -> DataFrame:
    """Weight per bin of fixed width, for as many whole bins as ``lo..hi`` holds.

    Values outside the bins are in none; the last bin includes its right edge. NaN counts as NULL. ``groups`` lists the
    values of a single ``by`` column, so that a group without a row has its (empty) bins, too; without ``by``, an empty table has them.
    Columns: by columns, bin (0-based), bin_left, bin_right, weight, total (all rows, NULL values included).
    """
    bins = floor((hi - lo) / step + 1e-9)
    if bins < 1:
        raise ValueError("the range is shorter than one bin")
    low, width = F.lit(float(lo)), F.lit(float(step))
    value = _known(x)
    inside = (value >= lo) & (value <= lo + bins * step)
    binned = df.select(
        *by,
        F.when(inside, _bin_index(value, low, width, F.lit(bins))).alias("_bin"),
        F.col(weight).alias("_w"),
    )
    return _complete(_with_groups(binned, by, groups).withColumns({"_lo": low, "_width": width}), by, bins, (low, width))


def _with_groups(binned: DataFrame, by: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """``binned`` and one row without bin and weight for each listed group."""
    if not groups:
        return binned
    if len(by) != 1:
        raise ValueError("groups are the values of one column")
    listed = binned.sparkSession.createDataFrame([(group,) for group in groups], f"`{by[0]}` string")
    return binned.unionByName(listed, allowMissingColumns=True)


def weighted_hist_auto(
    df: DataFrame, x: str, weight: str, bins: int, by: Sequence[str] = (), groups: Sequence[str] = ()
) -> DataFrame:
    """Weight per bin for equal bins between the smallest and largest value of each group.

    A group with a single value gets a range of one around it; one without a value has bins without edges. NaN counts as NULL;
    infinite values are in no bin. Columns as in :func:`weighted_hist`.

    Two scans: one finds the range, the next adds up weights per bin, so a task sends at most ``bins`` rows per group. ``groups`` lists the values
    of a single ``by`` column, as the names given to :func:`stack_populations`: rows of other groups are left out, and the range table, which has at
    most as many rows as the list, is broadcast. With ``by`` alone the number of groups is not known; there, rows are added up per distinct value
    before they meet their range.
    """
    if groups and len(by) != 1:
        raise ValueError("groups are the values of one column")
    if groups:
        df = df.where(F.col(by[0]).isin(*groups))
    values = df.select(*by, _finite(x).alias("_x"), F.col(weight).alias("_w"))
    # both scans read the weight, so that Spark finds the same exchange below them and makes it once
    found = values.groupBy(*by).agg(F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.count("_w").alias("_weights"))
    ranges = found.where("_weights >= 0").drop("_weights")
    single = F.col("_min") == F.col("_max")
    if groups:
        ranged = values.join(F.broadcast(ranges), list(by))
    elif by:
        ranged = salted_join(values.groupBy(*by, "_x").agg(F.sum("_w").alias("_w")), ranges, by, null_safe=True)
    else:
        ranged = values.withColumns({name: ranges.select(name).scalar() for name in ("_min", "_max")})
    low = F.when(single, F.col("_min") - 0.5).otherwise(F.col("_min"))
    high = F.when(single, F.col("_max") + 0.5).otherwise(F.col("_max"))
    binned = (
        ranged.withColumns({"_lo": low, "_width": (high - low) / bins})
        .withColumn(
            "_bin",
            F.when(F.col("_x").isNotNull(), _bin_index(F.col("_x"), F.col("_lo"), F.col("_width"), F.lit(bins))),
        )
    )
    return _complete(_with_groups(binned, by, groups), by, bins)


def cumulative(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running weight over the bins and its share of the total.

    The share is of all rows of the group; when NULL values carry weight the last share stays below one.
    """
    window = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumn("cumulative", F.sum("weight").over(window)).withColumn(
        "cumulative_share", ratio("cumulative", "total")
    )


def threshold_class(histogram: DataFrame, threshold: float, name: str = "above_threshold") -> DataFrame:
    """0 for bins whose left edge is at or below the threshold, else 1."""
    return histogram.withColumn(name, F.when(F.col("bin_left") <= threshold, 0).otherwise(1))
