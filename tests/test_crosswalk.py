import random

import pytest
from pyspark.sql import functions as F

from hearthstat.operators import crosswalk as X
from hearthstat.operators import joins
from hearthstat.operators.joins import salted_join


def area_tables(spark, seed=1, areas=12, hot=400):
    """Areas with totals, links whose factors sum to one, one area with most of the links, one without any."""
    rng = random.Random(seed)
    totals = [(f"s{i % 3}", f"a{i}", rng.randrange(1, 1000), rng.randrange(1, 500)) for i in range(areas)]
    totals.append(("s0", "a-0009", 77, 33))
    links = []
    for i in range(areas):
        n = hot if i == 0 else rng.randrange(1, 6)
        parts = [rng.random() for _ in range(n)]
        links += [(f"a{i}", f"d{j}", p / sum(parts)) for j, p in enumerate(parts)]
    return (
        spark.createDataFrame(totals, "state string, area string, m long, n long"),
        spark.createDataFrame(links, "src string, dst string, f double"),
    )


def test_allocate_keeps_totals_and_equals_plain_sums(spark):
    totals, links = area_tables(spark)
    out = X.allocate(totals, X.link_table(links, "src", "dst", "f"), "area", "src", "dst", "f", ["m", "n"], ["state"])
    got = {(r.state, r.dst): (r.m, r.n) for r in out.collect()}
    want = {}
    factors = links.collect()
    for t in totals.collect():
        for x in factors:
            if x.src == t.area:
                m, n = want.get((t.state, x.dst), (0.0, 0.0))
                want[t.state, x.dst] = (m + t.m * x.f, n + t.n * x.f)
    assert got.keys() == want.keys()
    for key, pair in want.items():
        assert got[key] == pytest.approx(pair)
    linked = totals.where("area <> 'a-0009'").agg(F.sum("m")).first()[0]
    assert sum(m for m, _ in got.values()) == pytest.approx(linked)


def test_repeated_links_count_once(spark):
    links = spark.createDataFrame([("a", "d", 0.5), ("a", "d", 0.25)], "src string, dst string, f double")
    totals = spark.createDataFrame([("a", 10)], "area string, m long")
    out = X.allocate(totals, X.link_table(links, "src", "dst", "f"), "area", "src", "dst", "f", ["m"])
    assert [(r.dst, r.m) for r in out.collect()] == [("d", 5.0)]


def test_overlap_and_unmatched(spark):
    totals, links = area_tables(spark)
    out = X.overlap(totals, links, "area", "src")
    assert out.count() == links.count() + 1
    assert [(r.area, r.dst, r.f, r.m) for r in out.where("dst IS NULL").collect()] == [("a-0009", None, None, 77)]
    assert [r.area for r in X.unmatched(totals, links, "area", "src").collect()] == ["a-0009"]
    rate = X.match_rate(totals, links, "area", "src", "m").first()
    assert (rate.areas, rate.matched_areas, rate.weight - rate.matched_weight) == (13, 12, 77)


def test_compose_two_hops(spark):
    first = spark.createDataFrame([("a", "z1", 0.4), ("a", "z2", 0.6), ("b", "z2", 1.0), ("c", "z9", 1.0)], "p string, z string, f double")
    second = spark.createDataFrame([("z1", "R", 0.5), ("z1", "U", 0.5), ("z2", "R", 1.0)], "zip string, code string, g double")
    rural = X.compose(first, second.where("code = 'R'"), "p", ("z", "zip"), ("f", "g"), factor_as="share")
    assert {r.p: pytest.approx(r.share) for r in rural.collect()} == {"a": 0.8, "b": 1.0}
    both = X.compose(first, second, "p", ("z", "zip"), ("f", "g"), target="code")
    assert {(r.p, r.code): pytest.approx(r.allocation_factor) for r in both.collect()} == {
        ("a", "R"): 0.8, ("a", "U"): 0.2, ("b", "R"): 1.0,
    }


def test_missing_share_gives_null_and_drops_from_the_sum(spark):
    totals = spark.createDataFrame([("a", 10), ("b", 20)], "area string, m long")
    shares = spark.createDataFrame([("a", 0.5)], "p string, share double")
    out = X.apply_share(totals, shares, "area", "p", "share", {"part": "m"})
    assert {r.area: r.part for r in out.collect()} == {"a": 5.0, "b": None}
    assert out.agg(F.sum("part")).first()[0] == 5.0


def test_redistribute_keeps_grand_totals(spark):
    moved = spark.createDataFrame(
        [("s0", "d1", 30.0, 3.0), ("s0", "d2", 10.0, 9.0), ("s1", "d1", 0.0, 0.0)], "state string, dst string, m double, n double"
    )
    rest = spark.createDataFrame([("s0", 5, 2), ("s0", 3, 2), ("s1", 4, 1), ("s2", 6, 0)], "state string, m long, n long")
    out = X.redistribute(moved, rest, "state", "dst", "m", ["m", "n"])
    got = {(r.state, r.dst): (r.m, r.n) for r in out.collect()}
    assert got["s0", "d1"] == pytest.approx((36.0, 6.0)) and got["s0", "d2"] == pytest.approx((12.0, 10.0))
    assert got["s1", "unallocated"] == (4.0, 1.0) and got["s2", "unallocated"] == (6.0, 0.0)
    assert got["s1", "d1"] == (0.0, 0.0)
    assert sum(m for m, _ in got.values()) == pytest.approx(30 + 10 + 5 + 3 + 4 + 6)


def test_entity_means_count_known_ids_and_divide_fractionally(spark):
    rows = [("1", "000000000010001", 1, 1, 0), ("2", "000000000010002", 0, 0, 1), ("3", "000000000020001", 1, None, 1), (None, "000000000010003", 1, 0, 0)]
    df = spark.createDataFrame(rows, "id string, block string, a int, b int, c int")
    out = X.entity_means(df, F.left(F.col("block"), F.lit(11)), "tract", ["a", "b", "c"], "id", "mean")
    assert {r.tract: r["mean"] for r in out.collect()} == {"00000000001": 2.0, "00000000002": None}


def test_decorate_keeps_unknown_names(spark):
    totals = spark.createDataFrame([("1", 5), ("2", 6)], "id string, m long")
    names = spark.createDataFrame([("1", "Ohio", 10)], "id string, name string, t long")
    out = X.decorate(totals, names, "id", "name", {"Ohio": "OH"}, rates={"rate": ("m", "t")})
    assert {r.id: (r.code, r.rate) for r in out.collect()} == {"1": ("OH", 0.5), "2": (None, None)}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_join(spark, how, null_safe):
    rng = random.Random(3)
    many = spark.createDataFrame([("hot" if i % 3 == 0 else rng.choice(["a", "b", "x", None]), i) for i in range(600)], "k string, v int")
    one = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), (None, 4), ("y", 5)], "k string, w int")
    got = salted_join(many, one, ["k"], how, null_safe=null_safe)
    if null_safe:
        right = one.withColumnRenamed("k", "k2")
        want = many.join(right, F.col("k").eqNullSafe(F.col("k2")), how).drop("k2")
    else:
        want = many.join(one, "k", how)
    order = lambda df: sorted(map(tuple, df.select("k", "v", "w").collect()), key=str)
    assert order(got) == order(want)
    with pytest.raises(ValueError):
        salted_join(many, one, ["k"], "full")


def test_one_pass_allocation_equals_allocate_and_redistribute(spark):
    totals = spark.createDataFrame([("s1", "a", 10.0, 4), ("s1", "b", 6.0, 2), ("s1", "x", 8.0, 1), ("s2", "x", 5.0, 3), ("s2", "y", 1.0, 1), ("s3", "a", 2.0, 0), ("s3", "x", 7.0, 7)], "state string, area string, m double, e int")
    links = spark.createDataFrame([("a", "d1", 0.25), ("a", "d2", 0.75), ("b", "d2", 1.0)], "src string, district string, f double")
    moved = X.allocate(totals, links, "area", "src", "district", "f", ["m", "e"], ["state"])
    want = X.redistribute(moved, X.unmatched(totals, links, "area", "src"), "state", "district", "e", ["m", "e"])
    got = X.allocate_all(totals, links, "area", "src", "state", "district", "f", "e", ["m", "e"])
    show = lambda df: sorted((r["state"], r["district"], round(r["m"], 9), round(r["e"], 9)) for r in df.collect())
    assert show(got) == show(want) and sum(r[2] for r in show(got)) == pytest.approx(39.0)


def test_a_share_that_stands_twice_fails(spark):
    totals = spark.createDataFrame([("a", 10.0)], "area string, m double")
    shares = spark.createDataFrame([("a", 0.5), ("a", 0.7)], "src string, share double")
    with pytest.raises(Exception, match="must be unique"):
        X.apply_share(totals, shares, "area", "src", "share", {"part": "m"}).collect()


def test_links_without_factor_or_target_are_links(spark):
    totals = spark.createDataFrame([("r", "a", 10.0), ("r", "b", 4.0), ("q", "c", 3.0)], "region string, area string, m double")
    links = spark.createDataFrame([("a", "t1", None), ("a", "t2", 0.5), ("a", None, 0.25), ("d", "t9", 1.0)], "area string, t string, f double")
    got = X.allocate_all(totals, links, "area", "area", "region", "t", "f", "m", ["m"])
    moved = X.allocate(totals, links, "area", "area", "t", "f", ["m"], ["region"])
    want = X.redistribute(moved, X.unmatched(totals, links, "area", "area"), "region", "t", "m", ["m"])
    rows = {(r.region, r.t): r.m for r in got.collect()}
    assert rows == {(r.region, r.t): r.m for r in want.collect()}
    assert rows == {("r", "t1"): None, ("r", "t2"): pytest.approx(5 + 4 * 5 / 7.5), ("r", None): pytest.approx(2.5 + 4 * 2.5 / 7.5), ("q", "unallocated"): 3.0}


def test_keys_that_stand_twice_fail(spark):
    totals = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, m double")
    twice = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "z", 3.0)], "id string, name string, s double")
    once = twice.where("name <> 'y'").union(spark.createDataFrame([(None, "n", 1.0), (None, "n", 1.0)], "id string, name string, s double"))
    for made in (lambda right: X.decorate(totals, right, "id", "name"), lambda right: X.attach_means(totals, right, "id"), lambda right: X.share_times_total(right.select("id", "s"), totals, "id", "s", "m", "p"),
                 lambda right: X.share_times_total(totals, right.select("id", "s"), "id", "m", "s", "p"), lambda right: X.apply_share(totals, right, "id", "id", "s", {"new": "m"})):
        assert made(once).count() == 2
        with pytest.raises(Exception, match="must be unique; repeated: a"):
            made(twice).collect()


def test_only_hot_keys_are_salted(spark):
    many = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("k"), F.col("id"))
    one = spark.createDataFrame([("hot", 1), ("k0", 2), ("k10", 3), ("none", 4)], "k string, v int")
    hot = joins.hot_keys(many, ["k"], hot_rows=1000).collect()
    assert [tuple(r) for r in hot] == [("hot", 58)]
    assert joins.hot_keys(many, ["k"]).count() == 0
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(one, "k", how).select("k", "id", "v").collect()))
        for null_safe in (False, True):
            got = joins.salted_join(many, one, ["k"], how, hot_rows=1000, null_safe=null_safe)
            assert sorted(map(str, got.select("k", "id", "v").collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = joins.salted_join(many, one, ["k"], hot_rows=1000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert max(sizes) < 0.25 * sum(sizes) and "BroadcastHashJoin" in text and "SortMergeJoin" in text
