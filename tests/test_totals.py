import pytest
from pyspark.sql import functions as F

from hearthstat.operators import totals as T

ROWS = [("a", 1, 10.0), ("a", 0, 20.0), ("b", 0, 5.0), (None, 1, 7.0)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "g string, f int, w double")


def test_empty_groups(table):
    out = {r.g: r for r in T.weighted_totals(table, "w", {"n": F.col("f") == 1, "t": None}, ["g"]).collect()}
    assert (out["b"].n, out["b"].t, out["a"].n) == (0.0, 5.0, 10.0)
    out = {r.g: r for r in T.weighted_totals(table, "w", {"n": F.col("f") == 1}, ["g"], empty="null").collect()}
    assert out["b"].n is None
    with pytest.raises(ValueError):
        T.total_where("w", F.col("f") == 1, "none")


def test_nulls_sort_last(table):
    assert [r.g for r in T.order_nulls_last(table.select("g").distinct(), "g").collect()] == ["a", "b", None]


def test_weighted_mean_skips_missing_values(spark):
    df = spark.createDataFrame([(2.0, 10), (1.0, 30), (None, 50), (9.0, None)], "x double, w int")
    assert T.weighted_mean(df, "x", "w").first()[0] == pytest.approx(1.25)


def test_threshold_share_rounds_half_even(spark):
    df = spark.createDataFrame([(1, 150), (7, 300)], "w int, p int")
    row = T.threshold_share(df, "w", F.col("p").between(135, 200)).first()
    assert (row.total, row.inside, row.share) == (8, 1, 0.12)
    empty = T.threshold_share(df.where("false"), "w", F.col("p") > 0).first()
    assert (empty.total, empty.inside, empty.share) == (0, 0, None)


def test_subgroup_change(spark):
    wide = spark.createDataFrame([(200, 50, 80, 0)], "t int, l int, vt int, vl int")
    out = {r.subgroup: (r.total, r.lost, r.percent_change) for r in T.subgroup_change(wide, {"all": ("t", "l"), "vet": ("vt", "vl")}).collect()}
    assert out["all"] == (200.0, 50.0, -25.0) and out["vet"][2] == 0.0


def test_latest_period_from_another_table(spark):
    df = spark.createDataFrame([(2020, 1), (2021, 2), (2022, 3)], "year int, x int")
    ref = spark.createDataFrame([(2021,), (2019,)], "year int")
    assert [r.x for r in T.latest_period(df, "year").collect()] == [3]
    assert [r.x for r in T.latest_period(df, "year", ref).collect()] == [2]


def test_top_k_leaves_out_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 3.0)], "k string, v double")
    assert [r.k for r in T.top_k(df, "v", 2, ["k"]).collect()] == ["c", "d"]


def test_summary(spark):
    row = T.summary(spark.createDataFrame([(2024,), (2025,), (2040,)], "x int"), "x").first()
    assert (row.sum, row.max, row.median) == (6089, 2040, 2025.0)


def medians(df, by=()):
    """Groups, exact medians and Spark's own, as text so that NaN equals NaN."""
    return sorted(map(str, T.exact_median(df, "x", by).collect())), sorted(map(str, df.groupBy(*by).agg(F.median("x").alias("median")).where("median IS NOT NULL").collect()))


def test_exact_median_of_a_million_distinct_values(spark):
    df = spark.range(1_000_001).select((F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / 1024.0 - 2.0**40).alias("x"), F.col("id"))
    got, want = medians(df)
    assert got == want and len(got) == 1
    got, want = medians(df.withColumn("g", F.when(F.col("id") % 10 > 0, "hot").otherwise((F.col("id") % 7).cast("string"))), ["g"])
    assert got == want and len(got) == 8


def test_exact_median_of_ties_and_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    groups = {
        "even": [1.0, 2.0, 3.0, 10.0], "odd": [5.0, -1.0, 2.0], "tie": [4.0] * 7 + [1.0, 9.0], "half": [1.0, 1.0, 2.0, 2.0], "one": [3.5], "null": [None, None], "some": [None, 7.0, None, 8.0],
        "nan": [nan, nan, 1.0], "last": [1.0, nan], "inf": [-inf, inf, inf], "ends": [-1e308, 1e308], "both": [-inf, 1.0], "tiny": [5e-324, 1e-323, -5e-324, 0.0], "near": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0 + 3 * 2**-52], "sign": [-2.0, -1.0, -3.0, 0.0, -0.0, 1e-9],
    }
    rows = [(g, x) for g, own in groups.items() for x in own] + [(None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got, want = medians(df, ["g"])
    assert got == want and len(got) == len(groups)
    for own in groups.values():
        got, want = medians(df.sparkSession.createDataFrame([(x,) for x in own], "x double"))
        assert got == want
    assert T.exact_median(df.limit(0), "x").count() == 0
    assert tuple(T.summary(df.limit(0), "x").first()) == (None, None, None, None)
    found = {r.g: (r["sum"], r.median) for r in T.summary(df, "x", ["g"]).collect()}
    assert found[None] == (5.0, 2.5) and found["null"] == (None, None) and len(found) == len(groups) + 1


def test_no_aggregate_of_the_median_buffers_values(spark):
    text = T.summary(spark.range(9).select((F.col("id") % 3).alias("g"), F.col("id").alias("x")), "x", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "median" not in text.split("Project")[0] and "percentile" not in text and "ObjectHashAggregate" not in text


def test_latest_rows_and_totals(spark):
    rows = [("a", 2020, 1), ("a", 2022, 2), ("a", 2022, 3), ("b", 2021, 4), (None, 2022, 5), ("c", None, 6)]
    df = spark.createDataFrame(rows, "k string, year int, x int")
    assert sorted(map(str, T.latest_rows(df, "year", ["k"]).collect())) == sorted(map(str, T.latest_period(df, "year").collect()))
    assert T.latest_rows(df.limit(0), "year", ["k"]).count() == 0
    totals = T.latest_totals(df, "year", {"s": F.sum("x"), "n": F.count("k")})
    assert tuple(totals.first()) == (10, 2)
    assert tuple(T.latest_totals(df.limit(0), "year", {"s": F.sum("x")}).first()) == (None,)
