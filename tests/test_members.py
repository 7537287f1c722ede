import random

import pytest
from pyspark.sql import functions as F

from hearthstat.functions import predicates as P
from hearthstat.operators import members
from hearthstat.operators.members import (
    MemberValue, both_flag, either_flag, household_flag, key_profile, member_flag, rollup_members,
)
from hearthstat.sources import io

HH = "area string, serialno string, state string, wgtp long, fs string, accessinet string"
PP = "area string, serialno string, pwgtp long, povpip int, hins4 string, pap double, ssip double, vps string"


def flags():
    return {
        "eligible": either_flag(P.household_qualifies(), P.member_qualifies(200)),
        "gap": both_flag(P.household_without_food_support(), P.member_only_by_income(136, 200)),
        "offline": household_flag(P.no_internet()),
        "veteran": member_flag(P.code_in("vps", ["01", "02"])),
    }


def values():
    return {
        "lowest": MemberValue("min", F.col("povpip")),
        "highest": MemberValue("max", F.col("povpip")),
        "population": MemberValue("sum", F.col("pwgtp")),
    }


def random_tables(spark, seed, households=300, hot=0):
    rng = random.Random(seed)
    pick = rng.choice
    hh = [
        (f"a{rng.randrange(4)}", f"s{i}", f"st{rng.randrange(3)}", pick([0, 1, 5, 20]), pick(["1", "2", "2", None]), pick(["1", "2", "3", None]))
        for i in range(households)
    ]
    hh.append((None, "s0", "st0", 3, "2", "3"))
    hh.append(("a0", None, "st1", 4, "1", "3"))

    def person(area, serial):
        return (
            area, serial, rng.randrange(1, 9), pick([None, 20, 135, 136, 150, 200, 201, 400]),
            pick(["1", "2", "2", "2", None]), pick([0.0, 0.0, 0.0, 50.0, None]), pick([0.0, 0.0, 10.0]), pick(["01", "15", None]),
        )

    pp = [person(h[0], h[1]) for h in hh for _ in range(rng.randrange(4))]
    pp += [person("a9", "nobody"), person(None, "s0")]
    pp += [person(hh[7][0], hh[7][1]) for _ in range(hot)]
    return spark.createDataFrame(hh, HH), spark.createDataFrame(pp, PP)


def joined_then_grouped(hh, pp, carry=()):
    """The plain form: one row per household and person, MAX over the group."""
    h, p = hh.alias("h"), pp.alias("p")
    rows = h.join(p, (F.col("h.area") == F.col("p.area")) & (F.col("h.serialno") == F.col("p.serialno")), "left").select(
        F.col("h.area").alias("area"), F.col("h.serialno").alias("serialno"), F.col("h.state").alias("state"),
        "wgtp", "fs", "accessinet", "pwgtp", "povpip", "hins4", "pap", "ssip", "vps",
    )
    eligible = (F.col("fs") == "1") | (F.col("hins4") == "1") | (F.col("pap") > 0) | (F.col("ssip") > 0) | (F.col("povpip") <= 200)
    gap = (
        (F.col("fs") != "1") & (F.col("hins4") != "1") & (F.col("pap") == 0) & (F.col("ssip") == 0)
        & F.col("povpip").between(136, 200)
    )

    def top(condition):
        return F.max(F.when(condition, 1).otherwise(0))

    return rows.groupBy("area", "serialno", *carry).agg(
        F.max("wgtp").alias("hh_weight"), top(eligible).alias("eligible"), top(gap).alias("gap"),
        top(F.col("accessinet") == "3").alias("offline"), top(F.col("vps").isin("01", "02")).alias("veteran"),
        F.min("povpip").alias("lowest"), F.max("povpip").alias("highest"), F.sum("pwgtp").alias("population"),
    )


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    a = sorted(map(tuple, left.select(columns).collect()), key=key)
    b = sorted(map(tuple, right.select(columns).collect()), key=key)
    assert a == b


@pytest.mark.parametrize("seed", [1, 2])
def test_single_aggregation_equals_join_then_group(spark, seed):
    hh, pp = random_tables(spark, seed)
    same(rollup_members(hh, pp, ["area", "serialno"], "wgtp", flags(), values()), joined_then_grouped(hh, pp))


@pytest.mark.parametrize("unique", [True, False])
def test_carried_columns_equal_join_then_group(spark, unique):
    hh, pp = random_tables(spark, 3)
    rolled = rollup_members(hh, pp, ["area", "serialno"], "wgtp", flags(), values(), ["state"], unique_key=unique)
    same(rolled, joined_then_grouped(hh, pp, ["state"]))


def test_one_household_with_a_third_of_all_persons(spark):
    hh, pp = random_tables(spark, 4, hot=2000)
    same(rollup_members(hh, pp, ["area", "serialno"], "wgtp", flags(), values()), joined_then_grouped(hh, pp))


def test_repeated_household_rows_become_one(spark):
    hh = spark.createDataFrame([("a", "1", "x", 2, "2", "1"), ("a", "1", "x", 7, "1", "2")], HH)
    pp = spark.createDataFrame([("a", "1", 1, 300, "2", 0.0, 0.0, "15")], PP)
    for carry in ((), ("state",)):
        row = rollup_members(hh, pp, ["area", "serialno"], "wgtp", flags(), carry=carry).collect()
        assert [(r.hh_weight, r.eligible) for r in row] == [(7, 1)]


def test_null_keys_are_one_household_with_and_without_carried_columns(spark):
    hh = spark.createDataFrame([(None, "1", "x", 5, "2", "1"), (None, "1", "x", 7, "1", "2")], HH)
    pp = spark.createDataFrame([(None, "1", 1, 300, "2", 0.0, 0.0, "01")], PP)
    for carry in ((), ("state",)):
        row = rollup_members(hh, pp, ["area", "serialno"], "wgtp", flags(), carry=carry).collect()
        assert [(r.hh_weight, r.eligible, r.veteran) for r in row] == [(7, 1, 0)]
    assert key_profile(hh, pp, ["area", "serialno"]).first().null_key_rows == 2


def test_household_without_persons_stays(spark):
    hh = spark.createDataFrame([("a", "1", "x", 2, "1", "3"), ("a", "2", "x", 5, "2", "1")], HH)
    pp = spark.createDataFrame([], PP)
    rows = {r.serialno: r for r in rollup_members(hh, pp, ["area", "serialno"], "wgtp", flags(), values()).collect()}
    assert (rows["1"].eligible, rows["1"].offline, rows["1"].population) == (1, 1, None)
    assert (rows["2"].eligible, rows["2"].veteran, rows["2"].lowest) == (0, 0, None)
    assert rollup_members(hh, pp, ["area", "serialno"], "wgtp", flags(), require_member=True).count() == 0


def test_gap_needs_every_amount_known(spark):
    hh = spark.createDataFrame([("a", str(i), "x", 1, "2", "1") for i in range(4)] + [("a", "4", "x", 1, None, "1")], HH)
    pp = spark.createDataFrame([
        ("a", "0", 1, 150, "2", 0.0, 0.0, "15"),
        ("a", "1", 1, 150, "2", None, 0.0, "15"),
        ("a", "2", 1, 150, "1", 0.0, 0.0, "15"), ("a", "2", 1, 180, "2", 0.0, 0.0, "15"),
        ("a", "3", 1, 135, "2", 0.0, 0.0, "15"),
        ("a", "4", 1, 150, "2", 0.0, 0.0, "15"),
    ], PP)
    gap = {r.serialno: r.gap for r in rollup_members(hh, pp, ["area", "serialno"], "wgtp", flags()).collect()}
    # 1: unknown amount; 2: another member has medical aid, yet any member counts; 3: below the band; 4: unknown food support
    assert gap == {"0": 1, "1": 0, "2": 1, "3": 0, "4": 0}


def test_key_profile(spark):
    hh, pp = random_tables(spark, 5, households=10)
    again = hh.union(hh.limit(1))
    row = key_profile(again, pp, ["area", "serialno"]).first()
    assert (row.household_rows, row.household_keys, row.repeated_keys, row.null_key_rows) == (13, 10, 1, 2)
    assert row.orphan_person_keys == 1


def test_a_hundred_flags(spark):
    rng = random.Random(9)
    households = spark.createDataFrame([(i, 1, rng.randrange(1 << 50)) for i in range(40)], "id int, w int, h long")
    persons = spark.createDataFrame([(rng.randrange(45), rng.randrange(1 << 50)) for _ in range(120)], "id int, m long")
    bit = lambda name, k: F.expr(f"shiftright({name}, {k}) % 2 = 1")
    flags = {f"h{k}": members.household_flag(bit("h", k)) for k in range(50)} | {f"m{k}": members.member_flag(bit("m", k)) for k in range(50)}
    flags |= {f"e{k}": members.either_flag(bit("h", k), bit("m", k)) for k in range(0, 50, 7)} | {f"b{k}": members.both_flag(bit("h", k), bit("m", k)) for k in range(0, 50, 7)}
    own = {}
    for r in persons.collect():
        own.setdefault(r.id, []).append(r.m)
    for options in ({}, {"bucketed": True}, {"carry": ["h"]}):
        out = members.rollup_members(households, persons, ["id"], "w", flags, **options).collect()
        assert len(out) == 40
        for r, (h,) in ((r, [x.h for x in households.collect() if x.id == r.id]) for r in out):
            for k in range(50):
                any_member = any(m >> k & 1 for m in own.get(r.id, []))
                assert (r[f"h{k}"], r[f"m{k}"]) == (h >> k & 1, int(any_member))
                if k % 7 == 0:
                    assert (r[f"e{k}"], r[f"b{k}"]) == (int(h >> k & 1 or any_member), int(bool(h >> k & 1 and any_member)))


def test_bucketed_tables_meet_without_an_exchange(spark, tmp_path):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}/bucketed'")
    try:
        rng = random.Random(10)
        households = spark.createDataFrame([("a", i, i % 3, rng.randrange(5)) for i in range(300)] + [("a", None, 4, 1), ("b", 7, 2, 2)], "area string, id int, w int, x int")
        persons = spark.createDataFrame([(rng.choice("ab"), rng.randrange(320), rng.randrange(5)) for _ in range(900)] + [("a", None, 1)], "area string, id int, y int")
        io.write_bucketed(households, "bucketed.households", ["area", "id"], 4)
        io.write_bucketed(persons, "bucketed.persons", ["area", "id"], 4)
        flags = {"any": members.either_flag(F.col("x") == 1, F.col("y") == 1), "both": members.both_flag(F.col("x") == 1, F.col("y") == 1)}
        values = {"most": members.MemberValue("max", F.col("y"))}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for carry in ([], ["x"]):
            laid = members.rollup_members(spark.table("bucketed.households"), spark.table("bucketed.persons"), ["area", "id"], "w", flags, values, carry, bucketed=True)
            plain = members.rollup_members(households, persons, ["area", "id"], "w", flags, values, carry)
            assert sorted(map(str, laid.collect())) == sorted(map(str, plain.select(*laid.columns).collect()))
            assert "Exchange" not in laid._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucketed CASCADE")
