"""Predicates and flags as Columns.

Conditions keep SQL's three-valued logic: nothing here replaces NULL inside a condition. Only
:func:`flag` turns "not true" (false or NULL) into 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthstat.functions import codes


def as_column(value) -> Column:
    """A column name or a Column as a Column."""
    return F.col(value) if isinstance(value, str) else value


def any_of(*conditions: Column) -> Column:
    """True when at least one condition is true."""
    return reduce(or_, conditions)


def all_of(*conditions: Column) -> Column:
    """True only when every condition is true; a NULL operand keeps the result from being true."""
    return reduce(and_, conditions)


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def masked(condition: Column, value) -> Column:
    """The value where the condition is true, else NULL."""
    return F.when(condition, as_column(value))


def code_in(column, code_list: Iterable[str]) -> Column:
    """Membership in a code list."""
    return as_column(column).isin(list(code_list))


def within(column, lo=None, hi=None, closed: str = "both") -> Column:
    """Interval test; ``closed`` is ``both``, ``left``, ``right`` or ``neither``; a missing end is open."""
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError(f"unknown closed side: {closed}")
    if lo is None and hi is None:
        raise ValueError("an interval needs at least one end")
    x = as_column(column)
    tests = []
    if lo is not None:
        tests.append(x >= lo if closed in ("both", "left") else x > lo)
    if hi is not None:
        tests.append(x <= hi if closed in ("both", "right") else x < hi)
    return all_of(*tests)


@dataclass(frozen=True)
class Band:
    """One arm of a banding: a code for an interval with explicit ends."""

    code: int
    lo: float | None = None
    hi: float | None = None
    closed: str = "both"


def band(column, bands: Iterable[Band], default: int = 0) -> Column:
    """Code of the first band that holds the value; ``default`` for NULL and for values in no band."""
    arms = list(bands)
    out = F.when(within(column, arms[0].lo, arms[0].hi, arms[0].closed), F.lit(arms[0].code))
    for arm in arms[1:]:
        out = out.when(within(column, arm.lo, arm.hi, arm.closed), F.lit(arm.code))
    return out.otherwise(F.lit(default))


def lookup(column, mapping: Mapping[str, str]) -> Column:
    """Value of a small fixed map; NULL for a key that is not in it."""
    pairs = F.create_map(*[F.lit(item) for item in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, as_column(column))


def amount_paid(column) -> Column:
    return as_column(column) > 0


def member_qualifies(threshold: int, *, medical="hins4", assistance="pap", supplement="ssip", poverty="povpip") -> Column:
    """Person-level programme tests: medical aid, public assistance, supplemental income, poverty level."""
    return any_of(
        as_column(medical) == codes.YES,
        amount_paid(assistance),
        amount_paid(supplement),
        as_column(poverty) <= threshold,
    )


def member_only_by_income(
    lo: int, hi: int, *, medical="hins4", assistance="pap", supplement="ssip", poverty="povpip"
) -> Column:
    """Person-level gap test: inside the income band and in no other programme.

    A NULL amount makes the test NULL, so such a person never sets the gap flag.
    """
    return all_of(
        as_column(medical) != codes.YES,
        as_column(assistance) == 0,
        as_column(supplement) == 0,
        within(poverty, lo, hi, "both"),
    )


def household_qualifies(food_support="fs") -> Column:
    """Household-level programme test."""
    return as_column(food_support) == codes.YES


def household_without_food_support(food_support="fs") -> Column:
    """Household-level half of the gap test; NULL stays NULL."""
    return as_column(food_support) != codes.YES


def _access_but(dialup_codes: list[str], access, broadband, other, dialup, satellite) -> Column:
    return all_of(
        as_column(access) == codes.YES,
        as_column(broadband) == codes.NO,
        as_column(other) == codes.NO,
        as_column(dialup).isin(dialup_codes),
        as_column(satellite) == codes.NO,
    )


def no_internet(access="accessinet") -> Column:
    return as_column(access) == codes.NO_ACCESS


def cellular_only(
    access="accessinet", broadband="hispeed", other="othsvcex", dialup="dialup", satellite="satellite"
) -> Column:
    return _access_but([codes.NO], access, broadband, other, dialup, satellite)


def dialup_only(
    access="accessinet", broadband="hispeed", other="othsvcex", dialup="dialup", satellite="satellite"
) -> Column:
    return _access_but([codes.YES], access, broadband, other, dialup, satellite)


def unconnected(
    access="accessinet", broadband="hispeed", other="othsvcex", dialup="dialup", satellite="satellite"
) -> Column:
    """No access at all, or access through none of the fixed services (with or without dial-up)."""
    return any_of(
        no_internet(access),
        _access_but([codes.YES, codes.NO], access, broadband, other, dialup, satellite),
    )


def connectivity_class(**columns) -> Column:
    """``none`` / ``cellular_only`` / ``dialup_only``; NULL for every other household."""
    access = columns.get("access", "accessinet")
    return (
        F.when(no_internet(access), F.lit("none"))
        .when(cellular_only(**columns), F.lit("cellular_only"))
        .when(dialup_only(**columns), F.lit("dialup_only"))
    )


def income_at_most(limit: float, income="hincp", positive: bool = False) -> Column:
    """Income test, with or without the lower bound at zero."""
    x = as_column(income)
    return all_of(x > 0, x <= limit) if positive else x <= limit
