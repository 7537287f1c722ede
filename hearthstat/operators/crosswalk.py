"""Moving weighted totals between area systems through allocation factors.

``sum(w * f)`` is linear, so totals are made per source area first and only area rows meet the crosswalk;
household rows are never multiplied by their target areas. No join here carries a broadcast hint: Catalyst
and adaptive execution choose by measured size. Where one area may hold a large part of the links its key is counted and, if hot,
salted, so its links are spread over several tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.curves import ratio
from hearthstat.functions.predicates import as_column, lookup
from hearthstat.operators.joins import one_per_key, salted_join
from hearthstat.operators.totals import plain_totals


def link_table(
    crosswalk: DataFrame, source: str, target: str, factor: str, unique: bool = False
) -> DataFrame:
    """Links ``source, target, factor`` with one row per pair (the largest factor of repeated pairs).

    ``unique=True`` promises that pairs do not repeat and saves the shuffle.
    """
    if unique:
        return crosswalk.select(source, target, factor)
    return crosswalk.groupBy(source, target).agg(F.max(factor).alias(factor))


def area_measures(
    df: DataFrame, measures: Mapping[str, Column], area: Sequence[str]
) -> DataFrame:
    """Measure sums per source area: the reduction that comes before any crosswalk join."""
    return df.groupBy(*area).agg(*[F.sum(value).alias(name) for name, value in measures.items()])


def _renamed(links: DataFrame, source: str, area: str) -> DataFrame:
    return links.withColumnRenamed(source, area) if source != area else links


def allocate(
    totals: DataFrame,
    links: DataFrame,
    area: str,
    source: str,
    target: str,
    factor: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Area totals moved to target areas; areas without a link drop out (see :func:`unmatched`).

    Totals that come in several rows per area (one per ``by`` value) are joined as they are.
    """
    moved = [F.sum(F.col(name) * F.col(factor)).alias(name) for name in measures]
    return _spread_links(totals, links, area, source).groupBy(*by, target).agg(*moved)


def _spread_links(totals: DataFrame, links: DataFrame, area: str, source: str) -> DataFrame:
    """Every link beside the totals of its source area."""
    return salted_join(_renamed(links, source, area), totals, [area])


def overlap(
    totals: DataFrame, links: DataFrame, area: str, source: str
) -> DataFrame:
    """Area totals beside every link of the area; areas without a link stay, with NULL link columns."""
    return totals.join(_renamed(links, source, area), area, "left")


def unmatched(totals: DataFrame, links: DataFrame, area: str, source: str) -> DataFrame:
    """Area totals of the areas that have no link."""
    known = links.select(F.col(source).alias(area)).distinct()
    return totals.join(known, area, "left_anti")


def match_rate(totals: DataFrame, links: DataFrame, area: str, source: str, weight: str) -> DataFrame:
    """How much of the weight, and how many areas, find a link: areas, matched_areas, weight, matched_weight, rate."""
    known = links.groupBy(source).agg(F.lit(1).alias("_known"))
    matched = F.col("_known").isNotNull()
    return (
        totals.join(_renamed(known, source, area), area, "left")
        .agg(
            F.count(F.lit(1)).alias("areas"),
            F.sum(matched.cast("bigint")).alias("matched_areas"),
            F.sum(weight).alias("weight"),
            F.sum(F.when(matched, F.col(weight)).otherwise(0)).alias("matched_weight"),
        )
        .withColumn("rate", ratio("matched_weight", "weight"))
    )


def compose(
    first: DataFrame,
    second: DataFrame,
    source: str,
    via: tuple[str, str],
    factors: tuple[str, str],
    target: str | None = None,
    factor_as: str = "allocation_factor",
) -> DataFrame:
    """Two crosswalks as one: the sum of factor products per source area (and target, when one is named).

    The second crosswalk is summed per middle area first, so the join is many-to-one unless targets are kept.
    """
    first_via, second_via = via
    first_factor, second_factor = factors
    kept = [target] if target else []
    reduced = second.groupBy(F.col(second_via).alias("_via"), *kept).agg(F.sum(second_factor).alias("_second_factor"))
    links = first.select(F.col(source), F.col(first_via).alias("_via"), F.col(first_factor).alias("_first_factor"))
    return (
        salted_join(links, reduced, ["_via"])
        .groupBy(source, *kept)
        .agg(F.sum(F.col("_first_factor") * F.col("_second_factor")).alias(factor_as))
    )


def apply_share(
    totals: DataFrame,
    shares: DataFrame,
    area: str,
    source: str,
    share: str,
    measures: Mapping[str, str],
) -> DataFrame:
    """Area totals with ``new = old * share`` columns; an area without a share gets NULL there."""
    joined = totals.join(_renamed(one_per_key(shares.select(source, share), [source]), source, area), area, "left")
    return joined.withColumns({new: F.col(old) * F.col(share) for new, old in measures.items()})


def redistribute(
    allocated: DataFrame,
    remainder: DataFrame,
    region: str,
    target: str,
    basis: str,
    measures: Sequence[str],
    unallocated_label: str = "unallocated",
) -> DataFrame:
    """Remainder of a region spread over its targets in proportion to a measure.

    ``remainder`` holds rows per region (any number; they are summed). A region whose targets carry no basis, or
    that has no target, keeps its remainder in one row with the label as target, so the grand totals never
    change. ``allocated`` is read twice.
    """
    left_over = plain_totals(remainder, measures, [region]).select(
        region, *[F.coalesce(F.col(name), F.lit(0)).cast("double").alias(f"_rest_{name}") for name in measures]
    )
    base = allocated.groupBy(region).agg(F.sum(F.col(basis).cast("double")).alias("_basis_total"))
    per_region = left_over.join(base, region, "left")
    spreadable = F.coalesce(F.col("_basis_total"), F.lit(0.0)) > 0
    part = F.coalesce(F.col(basis).cast("double"), F.lit(0.0)) / F.col("_basis_total")
    spread = salted_join(allocated, per_region.where(spreadable), [region], "left").select(
        region,
        target,
        *[
            (F.col(name).cast("double") + F.coalesce(F.col(f"_rest_{name}") * part, F.lit(0.0))).alias(name)
            for name in measures
        ],
    )
    kept = per_region.where(~spreadable).select(
        region, F.lit(unallocated_label).alias(target), *[F.col(f"_rest_{name}").alias(name) for name in measures]
    )
    return spread.unionByName(kept)


def allocate_all(
    totals: DataFrame,
    links: DataFrame,
    area: str,
    source: str,
    region: str,
    target: str,
    factor: str,
    basis: str,
    measures: Sequence[str],
    unallocated_label: str = "unallocated",
) -> DataFrame:
    """:func:`allocate` and :func:`redistribute` in one pass over the totals and the links.

    Areas without a link meet in one row per region; a window over the rows of a region, one per target, spreads it over the others
    in proportion to ``basis``. It stays, under the label, where no target carries any. A link counts as one even if its factor is NULL, which moves
    nothing, or its target is NULL, which is a target of its own.
    """
    linked = F.col("_linked").isNotNull()
    part = F.when(linked, F.col(factor).cast("double")).otherwise(1.0)
    summed = totals.join(_renamed(links, source, area).withColumn("_linked", F.lit(True)), area, "left").groupBy(region, target, linked.alias("_allocated")).agg(
        *[F.sum(F.col(name) * part).alias(name) for name in measures]
    )
    rows = Window.partitionBy(region)
    allocated = F.col("_allocated")
    base = F.coalesce(F.sum(F.when(allocated, F.col(basis))).over(rows), F.lit(0.0))
    rest = {name: F.sum(F.when(~allocated, F.col(name))).over(rows) for name in measures}
    spread = summed.withColumns({"_base": base, **{f"_rest_{name}": value for name, value in rest.items()}})
    share = F.coalesce(F.col(basis), F.lit(0.0)) / F.nullif(F.col("_base"), F.lit(0.0))
    return spread.where(allocated | (F.col("_base") <= 0)).select(
        region,
        F.when(allocated, F.col(target)).otherwise(F.lit(unallocated_label)).alias(target),
        *[
            F.when(allocated, F.col(name) + F.coalesce(F.col(f"_rest_{name}") * share, F.lit(0.0)))
            .otherwise(F.coalesce(F.col(name), F.lit(0.0))).alias(name)
            for name in measures
        ],
    )


def entity_means(
    entities: DataFrame, area: Column, area_as: str, flags: Sequence[str], entity: str, mean_as: str
) -> DataFrame:
    """Mean number of set flags per entity and area: sum of the flags over the count of entity ids."""
    per_row = reduce(lambda a, b: a + b, [as_column(name) for name in flags])
    return entities.groupBy(area.alias(area_as)).agg(ratio(F.sum(per_row), F.count(entity)).alias(mean_as))


def attach_means(allocated: DataFrame, means: DataFrame, area: str) -> DataFrame:
    """Allocated weights beside the mean of their area; areas known on one side only drop out, and an area with two means fails the job."""
    return allocated.join(one_per_key(means, [area]), area, "inner")


def share_times_total(
    shares: DataFrame, totals: DataFrame, on: str, share: str, total: str, product_as: str
) -> DataFrame:
    """A share known per area times a total known per area; an area that stands twice on either side fails the job."""
    return one_per_key(shares, [on]).join(one_per_key(totals, [on]), on, "inner").withColumn(product_as, F.col(share) * F.col(total))


def decorate(
    totals: DataFrame,
    names: DataFrame,
    on: str,
    name: str,
    codes: Mapping[str, str] | None = None,
    code_as: str = "code",
    rates: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Area totals with the columns of a name table, a code from a fixed map, and rate columns. An area with two names fails the job."""
    out = totals.join(one_per_key(names, [on]), on, "left")
    if codes is not None:
        out = out.withColumn(code_as, lookup(name, codes))
    return out.withColumns({new: ratio(top, bottom) for new, (top, bottom) in (rates or {}).items()})
