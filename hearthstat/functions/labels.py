"""Number labels for result tables. Rounding is half-even on the decimal reading of the number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthstat.functions.predicates import as_column


def _fixed(value: Column, digits: int) -> Column:
    rounded = F.bround(value.cast("double"), digits)
    # format_string rounds half-up on the shortest decimal form, which bround has already made exact.
    return F.format_string(f"%.{digits}f", rounded)


def money(value) -> Column:
    """``$1.2B`` from a billion up, else ``$350M``."""
    x = as_column(value)
    return F.when(x >= 1e9, F.concat(F.lit("$"), _fixed(x / 1e9, 1), F.lit("B"))).when(
        x.isNotNull(), F.concat(F.lit("$"), _fixed(x / 1e6, 0), F.lit("M"))
    )


def money_small(value) -> Column:
    """``$42M`` from a million up, else whole dollars."""
    x = as_column(value)
    return F.when(x >= 1e6, F.concat(F.lit("$"), _fixed(x / 1e6, 0), F.lit("M"))).when(
        x.isNotNull(), F.concat(F.lit("$"), _fixed(x, 0))
    )


def billions(value) -> Column:
    """``$1.2B`` at every size."""
    x = as_column(value)
    return F.when(x.isNotNull(), F.concat(F.lit("$"), _fixed(x / 1e9, 1), F.lit("B")))


def count(value) -> Column:
    """``1.2M`` from a million up, else ``350K``."""
    x = as_column(value)
    return F.when(x >= 1e6, F.concat(_fixed(x / 1e6, 1), F.lit("M"))).when(
        x.isNotNull(), F.concat(_fixed(x / 1e3, 0), F.lit("K"))
    )


def percent(value, digits: int = 1) -> Column:
    """``12.5%`` from the fraction 0.125."""
    x = as_column(value)
    return F.when(x.isNotNull(), F.concat(_fixed(x * 100, digits), F.lit("%")))


def thousands(value) -> Column:
    """``1,234``: the integer part with group separators."""
    x = as_column(value)
    return F.when(x.isNotNull(), F.format_number(x.cast("bigint"), 0))
