"""Projections, scenario grids, budget and fund tables.

Scenarios, benefit rules and period grids are short lists in the program text; they are unfolded from array
literals inside the row, so a grid over any number of universes needs neither a join nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.functions.curves import logistic, period_bucket, ratio, rescale
from hearthstat.functions.predicates import as_column
from hearthstat.operators.panel import align, first_value, period_diff, spread_in_proportion


@dataclass(frozen=True)
class Scenario:
    """A logistic adoption curve; ``drawn_to`` rescales it to another asymptote."""

    name: str
    asymptote: float
    rate: float
    midpoint: float
    drawn_to: float | None = None


@dataclass(frozen=True)
class Benefit:
    """Cost per enrolled household and period."""

    name: str
    amount: float
    loading: float = 1.0


def with_periods(df: DataFrame, first: int, last: int, name: str = "months") -> DataFrame:
    """Every row once per period."""
    return df.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias(name))


def project(df: DataFrame, universe, benefit, loading=1.0, rate: str = "adoption_rate") -> DataFrame:
    """Enrolment and cost from an adoption rate in percent."""
    return df.withColumn("enrolled_hh", F.col(rate) / 100 * as_column(universe)).withColumn(
        "cost", F.col("enrolled_hh") * benefit * loading
    )


def evaluate_curves(
    parameters: DataFrame, first: int, last: int, period: str = "months", value: str = "adoption_rate"
) -> DataFrame:
    """Parameter rows (columns L, k, x0) evaluated on a period grid."""
    return with_periods(parameters, first, last, period).withColumn(value, logistic(period, "L", "k", "x0"))


def scenario_grid(
    universes: DataFrame,
    universe: str,
    scenarios: Sequence[Scenario],
    benefits: Sequence[Benefit],
    first: int = 1,
    last: int = 72,
    period: str = "months",
) -> DataFrame:
    """Every universe row under every scenario, benefit rule and period: rate, enrolment, cost."""
    curves = F.array(*[
        F.struct(
            F.lit(s.name).alias("scenario"),
            F.lit(float(s.asymptote)).alias("_asymptote"),
            F.lit(float(s.rate)).alias("_rate"),
            F.lit(float(s.midpoint)).alias("_midpoint"),
            F.lit(float(s.asymptote if s.drawn_to is None else s.drawn_to)).alias("_drawn_to"),
        )
        for s in scenarios
    ])
    rules = F.array(*[
        F.struct(
            F.lit(b.name).alias("benefit"), F.lit(float(b.amount)).alias("_amount"), F.lit(float(b.loading)).alias("_loading")
        )
        for b in benefits
    ])
    grid = with_periods(
        universes.select("*", F.inline(curves)).select("*", F.inline(rules)), first, last, period
    )
    curve = logistic(period, "_asymptote", "_rate", "_midpoint")
    rated = grid.withColumn("adoption_rate", rescale(curve, "_asymptote", "_drawn_to"))
    return project(rated, universe, F.col("_amount"), F.col("_loading")).drop(
        "_asymptote", "_rate", "_midpoint", "_drawn_to", "_amount", "_loading"
    )


def match_observed(df: DataFrame, rate: str, observed, by: Sequence[str] = (), name: str = "matched_rate") -> DataFrame:
    """The curve scaled so that its largest value on the grid equals an observed rate."""
    peak = F.max(rate).over(Window.partitionBy(*by)) if by else df.agg(F.max(rate).alias("_peak")).scalar()
    target = F.lit(float(observed)) if isinstance(observed, (int, float)) else as_column(observed)
    return df.withColumn(name, F.col(rate) * F.try_divide(target, peak))


def compare_scenarios(
    df: DataFrame, keys: Sequence[str], scenarios: Sequence[str], measures: Sequence[str], scenario: str = "scenario"
) -> DataFrame:
    """Scenarios side by side: one row per key, columns ``<scenario>_<measure>``."""
    columns = [
        F.max(F.when(F.col(scenario) == label, F.col(measure))).alias(f"{label}_{measure}")
        for label in scenarios
        for measure in measures
    ]
    return df.groupBy(*keys).agg(*columns)


def yearly_rollup(
    df: DataFrame,
    by: Sequence[str],
    period: str = "months",
    sums: Sequence[str] = ("cost",),
    maxima: Sequence[str] = ("adoption_rate", "enrolled_hh"),
    size: int = 12,
    name: str = "year",
) -> DataFrame:
    """Program years from periods: costs add up, rate and enrolment take their largest value."""
    return (
        df.withColumn(name, period_bucket(period, size))
        .groupBy(*by, name)
        .agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
    )


def ledger_headroom(
    ledger: DataFrame,
    costs: DataFrame,
    available: str,
    committed: str,
    cost: str = "cost",
    year: str = "year",
    program_year: str = "program_year",
    offset: int = 2025,
    by: Sequence[str] = (),
) -> DataFrame:
    """Ledger years beside projected costs: stacked total and what is left of the available funds."""
    return align(ledger, costs, year, program_year, offset, by).withColumns({
        "stacked": F.col(committed) + F.col(available),
        "headroom": F.col(available) - F.col(cost),
    })


def capacity(
    ledger: DataFrame, available: str, benefit: float, loading: float, universe, periods: int = 12
) -> DataFrame:
    """Households that the available funds can serve for a year, and their part of the universe."""
    size = F.lit(float(universe)) if isinstance(universe, (int, float)) else as_column(universe)
    return ledger.withColumn("households", F.col(available) / (loading * periods * benefit)).withColumn(
        "adoption_rate", ratio("households", size)
    )


def fund_income(
    panel: DataFrame,
    households: str,
    period: str,
    shares: Sequence[float],
    fee: float,
    by: Sequence[str] | None = None,
    increase_as: str = "increase_hh",
    income_as: str = "fund_income",
) -> DataFrame:
    """Income from a fee per new household, after the given shares. ``by`` names the series; ``()`` says that the table is one."""
    out = period_diff(panel, households, period, by, increase_as)
    return out.withColumn(income_as, _fee(F.col(increase_as), shares, fee))


def fund_income_spread(
    panel: DataFrame,
    households: str,
    period: str,
    shares: Sequence[float],
    fee: float,
    by: Sequence[str] | None = None,
    increase_as: str = "new_households",
    income_as: str = "fund_income",
) -> DataFrame:
    """The same income, with the enrolment of the first period handed out over the later increases."""
    out = period_diff(panel, households, period, by, "_increase")
    out = first_value(out, households, period, by, "_first")
    out = spread_in_proportion(out, "_increase", F.col("_first"), by, increase_as)
    return out.withColumn(income_as, _fee(F.col(increase_as), shares, fee)).drop("_increase", "_first")


def _fee(increase: Column, shares: Sequence[float], fee: float) -> Column:
    for share in shares:
        increase = increase * share
    return increase * fee


def market_size(df: DataFrame, households: str, amount: float, periods: int = 12, name: str = "market_opp") -> DataFrame:
    """Yearly revenue of the households at a flat amount per period."""
    return df.withColumn(name, F.col(households) * periods * amount)
