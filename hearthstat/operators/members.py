"""Household roll-up: any-member flags, de-duplicated household weight, member aggregates.

The plain form joins persons to households and groups afterwards, which fans every household out to its
members. Because a flag is ``household term OR any(person term)`` or ``household term AND any(person
term)``, both sides can be aggregated on their own key instead:

* without carried columns, household and person rows meet in a single aggregation (one shuffle, no join,
  no sort; partial aggregation folds a hot key before the shuffle);
* with carried columns (a state or area next to the key), persons are aggregated first and joined 1:1. This is also the form for tables
  that are stored in buckets by the key: there, neither side is shuffled.

All condition results of a row travel in one 64-bit mask that is combined with ``bit_or``; beyond 61 conditions, in several.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthstat.functions.curves import ratio

_BITS = "_bits"
_WEIGHT = "_weight"
_HOUSEHOLD_SEEN = 1 << 0
_MEMBER_SEEN = 1 << 1
_FIRST_FREE_BIT = 2
_MASK_BITS = 63


@dataclass(frozen=True)
class Flag:
    """A household flag from a household condition, a person condition, or both."""

    household: Column | None = None
    member: Column | None = None
    need_both: bool = False


def household_flag(condition: Column) -> Flag:
    return Flag(household=condition)


def member_flag(condition: Column) -> Flag:
    """1 when any member meets the condition."""
    return Flag(member=condition)


def either_flag(household: Column, member: Column) -> Flag:
    """1 when the household, or any member, meets its condition."""
    return Flag(household=household, member=member)


def both_flag(household: Column, member: Column) -> Flag:
    """1 when the household condition holds and any member meets the person condition."""
    return Flag(household=household, member=member, need_both=True)


@dataclass(frozen=True)
class MemberValue:
    """An aggregate over the members of a household: ``min``, ``max`` or ``sum`` of a numeric column."""

    how: str
    value: Column

    def aggregate(self, name: str) -> Column:
        functions = {"min": F.min, "max": F.max, "sum": F.sum}
        return functions[self.how](name).alias(name)


class _Terms:
    """Places of conditions in the masks, and the masks of a row."""

    def __init__(self) -> None:
        self.next = _FIRST_FREE_BIT
        self.places: dict[str, tuple[int, int, Column]] = {}

    def add(self, name: str, condition: Column | None) -> None:
        if condition is not None:
            self.places[name] = (*divmod(self.next, _MASK_BITS), condition)
            self.next += 1

    @property
    def words(self) -> list[str]:
        return [f"{_BITS}_{word}" for word in range(-(-self.next // _MASK_BITS))]

    def masks(self, seen: int, side: str) -> list[Column]:
        out = [F.expr(f"{seen if word == 0 else 0}L") for word in range(len(self.words))]
        for name, (word, bit, condition) in self.places.items():
            if name.startswith(side):
                out[word] = out[word].bitwiseOR(F.when(condition, F.expr(f"{1 << bit}L")).otherwise(F.expr("0L")))
        return [mask.alias(name) for mask, name in zip(out, self.words)]

    def met(self, names: Sequence[str], need_all: bool) -> str:
        masks: dict[int, int] = {}
        tests = []
        for word, bit, _ in (self.places[name] for name in names if name in self.places):
            masks[word] = masks.get(word, 0) | 1 << bit
            tests.append(_is_set(1 << bit, word))
        return " AND ".join(tests) if need_all else " OR ".join(_is_set(mask, word) for word, mask in masks.items())


def _is_set(mask: int, word: int = 0) -> str:
    return f"({_BITS}_{word} & {mask}L) != 0"


def rollup_members(
    households: DataFrame,
    persons: DataFrame,
    key: Sequence[str],
    weight: str,
    flags: Mapping[str, Flag],
    values: Mapping[str, MemberValue] | None = None,
    carry: Sequence[str] = (),
    require_member: bool = False,
    unique_key: bool = False,
    weight_as: str = "hh_weight",
    bucketed: bool = False,
) -> DataFrame:
    """One row per household: key, carried columns, weight, 0/1 flags, member aggregates.

    A household without persons stays, with its person terms not met and its member aggregates NULL, unless
    ``require_member`` is set. Household rows that share key and carried columns become one row with the
    largest weight; NULL equals NULL there, so all rows whose key is NULL are one household without persons.
    ``unique_key=True`` promises that no two rows share a key, NULL keys included, and saves a shuffle when columns
    are carried; :func:`key_profile` checks both (``repeated_keys`` is 0, ``null_key_rows`` at most 1). ``bucketed=True`` says that both tables are
    stored in as many buckets by the key (:func:`hearthstat.sources.io.write_bucketed`): each side is then aggregated where it lies, and they meet without a shuffle.
    """
    key, carry, values = list(key), list(carry), dict(values or {})
    terms = _Terms()
    for name, spec in flags.items():
        terms.add(f"household {name}", spec.household)
        terms.add(f"member {name}", spec.member)
    words = terms.words
    any_bits = [F.bit_or(word).alias(word) for word in words]

    household_rows = households.select(*key, *carry, F.col(weight).alias(_WEIGHT), *terms.masks(_HOUSEHOLD_SEEN, "household "))
    member_columns = [spec.value.alias(name) for name, spec in values.items()]
    member_aggregates = [spec.aggregate(name) for name, spec in values.items()]
    person_rows = persons.dropna(how="any", subset=key).select(*key, *terms.masks(_MEMBER_SEEN, "member "), *member_columns)

    if carry or bucketed:
        if not unique_key:
            household_rows = household_rows.groupBy(*key, *carry).agg(F.max(_WEIGHT).alias(_WEIGHT), *any_bits)
        member_bits = [F.bit_or(word).alias(f"_member{word}") for word in words]
        per_household = person_rows.groupBy(*key).agg(*member_bits, *member_aggregates)
        merged = household_rows.join(per_household, key, "left").withColumns(
            {word: F.expr(f"{word} | coalesce(_member{word}, 0L)") for word in words}
        )
    else:
        merged = (
            household_rows.unionByName(person_rows, allowMissingColumns=True)
            .groupBy(*key)
            .agg(F.max(_WEIGHT).alias(_WEIGHT), *any_bits, *member_aggregates)
            .where(_is_set(_HOUSEHOLD_SEEN))
        )
    if require_member:
        merged = merged.where(_is_set(_MEMBER_SEEN))

    def flag_column(name: str, spec: Flag) -> Column:
        met = terms.met([f"household {name}", f"member {name}"], spec.need_both)
        return F.expr(f"CAST(({met}) AS INT)").alias(name)

    return merged.select(
        *key,
        *carry,
        F.col(_WEIGHT).alias(weight_as),
        *[flag_column(name, spec) for name, spec in flags.items()],
        *values,
    )


def key_profile(households: DataFrame, persons: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row that tells whether the key is unique and how many households have members.

    Columns: household_rows, household_keys, repeated_keys, null_key_rows, keys_with_members,
    orphan_person_keys, match_rate.
    """
    key = list(key)
    null_key = F.lit(False)
    for name in key:
        null_key = null_key | F.col(name).isNull()
    rows = households.select(*key, F.lit(1).alias("_h"), F.lit(0).alias("_p")).unionByName(
        persons.dropna(how="any", subset=key).select(*key, F.lit(0).alias("_h"), F.lit(1).alias("_p"))
    )
    per_key = rows.groupBy(*key).agg(F.sum("_h").alias("h"), F.max("_p").alias("p")).withColumn("null_key", null_key)
    usable = (F.col("h") > 0) & ~F.col("null_key")
    return per_key.agg(
        F.sum("h").alias("household_rows"),
        F.sum(usable.cast("bigint")).alias("household_keys"),
        F.sum(((F.col("h") > 1) & ~F.col("null_key")).cast("bigint")).alias("repeated_keys"),
        F.sum(F.when(F.col("null_key"), F.col("h")).otherwise(0)).alias("null_key_rows"),
        F.sum((usable & (F.col("p") == 1)).cast("bigint")).alias("keys_with_members"),
        F.sum(((F.col("h") == 0) & (F.col("p") == 1)).cast("bigint")).alias("orphan_person_keys"),
    ).withColumn("match_rate", ratio("keys_with_members", "household_keys"))
