"""Curve and rate arithmetic as Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthstat.functions.predicates import as_column


def _number(value) -> Column:
    return F.lit(float(value)) if isinstance(value, (int, float)) else as_column(value)


def logistic(x, asymptote, rate, midpoint) -> Column:
    """``L / (1 + exp(-k (x - x0)))``; each argument is a number, a column name or a Column."""
    return _number(asymptote) / (1 + F.exp(-_number(rate) * (as_column(x) - _number(midpoint))))


def rescale(value, old, new) -> Column:
    """The same curve drawn to another asymptote."""
    return as_column(value) * F.try_divide(_number(new), _number(old))


def ratio(numerator, denominator) -> Column:
    """Fractional division; NULL instead of an error on a zero denominator."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def period_bucket(period, size: int = 12) -> Column:
    """1-based bucket of a 1-based period: months 1..12 are year 1."""
    return (F.floor((as_column(period) - 1) / size) + 1).cast("int")


def blended_benefit(mix: Iterable[tuple[float, float]]) -> float:
    """Mean benefit over (share, amount) pairs."""
    return sum(amount * share for share, amount in mix)


def peak_rate(budget, universe, benefit: float, loading: float = 1.0, periods: int = 12) -> Column:
    """Adoption rate in percent at which the yearly cost equals the budget; NULL for an empty universe."""
    return F.try_divide(_number(budget) / (benefit * loading * periods), _number(universe)) * 100
