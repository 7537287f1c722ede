import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthstat.operators import distribution as D


def levels(spark, seed=1, n=2000, whole=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 else f"g{i % 5}"
        x = None if rng.random() < 0.1 else (rng.randrange(0, 502) if whole else rng.uniform(-3, 7))
        rows.append((group, None if x is None else float(x), rng.randrange(0, 50)))
    return spark.createDataFrame(rows, "g string, x double, w long"), rows


def arrays(rows, group=None):
    kept = [(x, w) for g, x, w in rows if x is not None and (group is None or g == group)]
    return np.array([x for x, _ in kept]), np.array([w for _, w in kept])


def test_fixed_bins_equal_numpy(spark):
    df, rows = levels(spark)
    got = [r.weight for r in D.weighted_hist(df, "x", "w", 0, 200, 5).orderBy("bin").collect()]
    x, w = arrays(rows)
    want, _ = np.histogram(x, bins=np.arange(0, 201, 5), weights=w)
    assert len(got) == 40 and got == want.tolist()


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("bins", [50, 100, 7])
def test_observed_range_equals_numpy(spark, whole, bins):
    df, rows = levels(spark, seed=2, whole=whole)
    out = D.weighted_hist_auto(df, "x", "w", bins, ["g"]).collect()
    for group in {g for g, _, _ in rows}:
        x, w = arrays(rows, group)
        want, edges = np.histogram(x, bins=bins, weights=w)
        mine = sorted((r for r in out if r.g == group), key=lambda r: r.bin)
        assert [r.weight for r in mine] == want.tolist()
        assert [r.bin_left for r in mine] == pytest.approx(edges[:-1].tolist())
        assert mine[0].total == sum(w_ for g, _, w_ in rows if g == group)


def test_whole_table_and_listed_groups_agree(spark):
    df, _ = levels(spark, seed=3)
    whole = D.weighted_hist_auto(df.withColumn("g", F.lit("all")), "x", "w", 20, ["g"], ["all"]).drop("g")
    assert sorted(whole.collect()) == sorted(D.weighted_hist_auto(df, "x", "w", 20).collect())


def test_last_bin_is_closed_and_empty_bins_stay(spark):
    df = spark.createDataFrame([(200.0, 4), (0.0, 1), (201.0, 9), (None, 2)], "x double, w long")
    out = {r.bin: r for r in D.weighted_hist(df, "x", "w", 0, 200, 5).collect()}
    assert len(out) == 40 and out[39].weight == 4 and out[0].weight == 1 and out[20].weight == 0
    assert out[0].total == 16


def test_single_value_range(spark):
    df = spark.createDataFrame([("a", 7.0, 3), ("a", 7.0, 2), ("b", None, 5)], "g string, x double, w long")
    out = D.weighted_hist_auto(df, "x", "w", 4, ["g"]).collect()
    a = {r.bin: (r.bin_left, r.weight) for r in out if r.g == "a"}
    assert a[0][0] == 6.5 and a[2] == (7.0, 5)
    assert all(r.weight == 0 and r.total == 5 for r in out if r.g == "b")


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0, 3), (None, 2.0, 2), ("b", 1.0, 5)], "g string, x double, w long")
    out = D.weighted_hist_auto(df, "x", "w", 2, ["g"]).collect()
    assert sorted(r.weight for r in out if r.g is None) == [2, 3]


def test_cumulative_share(spark):
    df = spark.createDataFrame([(1.0, 6), (2.0, 2), (None, 2)], "x double, w long")
    out = D.cumulative(D.weighted_hist_auto(df, "x", "w", 5)).orderBy("bin").collect()
    assert [r.cumulative for r in out] == [6, 6, 6, 6, 8]
    assert out[-1].cumulative_share == pytest.approx(0.8)
    full = D.cumulative(D.weighted_hist_auto(df.where("x IS NOT NULL"), "x", "w", 5)).agg(F.max("cumulative_share"))
    assert full.first()[0] == 1.0


def test_threshold_class(spark):
    df = spark.createDataFrame([(135.0, 1), (140.0, 1)], "x double, w long")
    out = D.threshold_class(D.weighted_hist(df, "x", "w", 0, 200, 5), 135)
    assert {r.bin_left: r.above_threshold for r in out.collect() if r.bin_left in (130.0, 135.0, 140.0)} == {130.0: 0, 135.0: 0, 140.0: 1}


def test_populations_overlap(spark):
    df = spark.createDataFrame([(1, 10.0, 2), (0, 20.0, 3)], "f int, x double, w long")
    out = D.stack_populations(df, {
        "all": D.Population(F.lit(True), F.col("x"), F.col("w")),
        "some": D.Population(F.col("f") == 1, F.col("x"), F.col("w")),
    })
    assert sorted((r.population, r.value, r.weight) for r in out.collect()) == [("all", 10.0, 2), ("all", 20.0, 3), ("some", 10.0, 2)]


def test_range_that_is_no_multiple_of_the_step_is_like_numpy(spark):
    values = [0.0, 2.9, 3.0, 8.9, 9.0, 9.5, 10.0, -1.0]
    df = spark.createDataFrame([(v, 2) for v in values], "x double, w int")
    got = [r["weight"] for r in D.weighted_hist(df, "x", "w", 0, 10, 3).orderBy("bin").collect()]
    assert got == np.histogram(values, bins=np.arange(0, 11, 3), weights=[2] * len(values))[0].tolist()
    with pytest.raises(ValueError):
        D.weighted_hist(df, "x", "w", 0, 2, 3)


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 1), (float("nan"), 5), (None, 2)], "x double, w int")
    fixed, auto = D.weighted_hist(df, "x", "w", 0, 4, 2).collect(), D.weighted_hist_auto(df, "x", "w", 2).collect()
    for rows in (fixed, auto):
        assert [r["weight"] for r in sorted(rows, key=lambda r: r["bin"])] == [1, 1] and {r["total"] for r in rows} == {9}
    assert sorted((r["bin_left"], r["bin_right"]) for r in auto) == [(1.0, 2.0), (2.0, 3.0)]


def test_empty_tables_and_groups_without_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("c", 1.0, 4)], "g string, x double, w int")
    rows = D.weighted_hist(df.limit(0), "x", "w", 0, 4, 2).collect()
    assert sorted((r["bin_left"], r["bin_right"], r["weight"], r["total"]) for r in rows) == [(0.0, 2.0, 0, 0), (2.0, 4.0, 0, 0)]
    rows = D.weighted_hist(df.where("g = 'a'"), "x", "w", 0, 4, 2, ["g"], ["a", "b"]).collect()
    assert sorted((r["g"], r["bin"], r["weight"], r["bin_left"]) for r in rows) == [("a", 0, 1, 0.0), ("a", 1, 0, 2.0), ("b", 0, 0, 0.0), ("b", 1, 0, 2.0)]
    rows = D.weighted_hist_auto(df, "x", "w", 2, ["g"], ["a", "b"]).collect()
    assert sorted((r["g"], r["bin"], r["weight"], r["bin_left"]) for r in rows) == [("a", 0, 0, 0.5), ("a", 1, 1, 1.0), ("b", 0, 0, None), ("b", 1, 0, None)]


def test_infinite_values_are_outside_an_observed_range(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 1), ("a", float("inf"), 5), ("a", float("-inf"), 7), ("b", float("inf"), 2)], "g string, x double, w long")
    for groups in ((), ("a", "b")):
        out = {(r.g, r.bin): (r.bin_left, r.bin_right, r.weight, r.total) for r in D.weighted_hist_auto(df, "x", "w", 2, ["g"], groups).collect()}
        assert out["a", 0] == (1.0, 2.0, 1, 14) and out["a", 1] == (2.0, 3.0, 1, 14)
        assert out["b", 0] == (None, None, 0, 2)
    assert [r.weight for r in D.weighted_hist_auto(df.where("g = 'a'"), "x", "w", 2).orderBy("bin").collect()] == [1, 1]


def test_observed_range_sends_bins_and_no_values(spark):
    df = spark.range(20_000).select(F.concat(F.lit("g"), F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).alias("w"))
    out = D.weighted_hist_auto(df, "x", "w", 10, ["g"], ["g0", "g1"])
    assert {r.weight for r in out.collect()} == {1000}
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    keys = [k for k in __import__("re").findall(r"HashAggregate\(keys=\[([^]]*)\]", text)]
    assert keys and not any("_x#" in k for k in keys)
    written = [line for line in text.split("\n") if "partial_" in line]
    assert all("_bin#" in line or "partial_min" in line or "collect_list" in line for line in written)
