import math

import pytest
from pyspark.sql import functions as F

from hearthstat.functions import codes, labels
from hearthstat.functions import predicates as P
from hearthstat.functions.curves import blended_benefit, logistic, peak_rate, period_bucket, ratio, rescale


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def test_band_edges(spark):
    df = spark.createDataFrame([(134,), (135,), (200,), (201,), (None,)], "x int").coalesce(1)
    bands = [P.Band(1, hi=135, closed="neither"), P.Band(2, 135, 200), P.Band(3, lo=200, closed="neither")]
    assert values(df, P.band("x", bands)) == [1, 2, 2, 3, 0]
    assert values(df, P.flag(P.within("x", 135, 200, "left"))) == [0, 1, 0, 0, 0]
    assert values(df, P.flag(P.within("x", 135, 200, "right"))) == [0, 0, 1, 0, 0]
    assert values(df, P.flag(P.within("x", 135, 200, "neither"))) == [0, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        P.within("x", 1, 2, "open")
    with pytest.raises(ValueError):
        P.within("x")


def test_three_valued_logic(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "fs string").coalesce(1)
    assert values(df, P.household_without_food_support()) == [False, True, None]
    assert values(df, P.any_of(F.col("fs") == "1", F.lit(True))) == [True, True, True]
    assert values(df, P.all_of(F.col("fs") == "1", F.lit(False))) == [False, False, False]
    assert values(df, P.flag(F.col("fs") == "1")) == [1, 0, 0]
    assert values(df, P.masked(F.col("fs") == "1", F.lit(9))) == [9, None, None]


def test_connection_classes(spark):
    rows = [
        ("3", "2", "2", "2", "2"), ("1", "2", "2", "2", "2"), ("1", "2", "2", "1", "2"),
        ("1", "2", "2", None, "2"), ("1", "1", "2", "2", "2"), ("2", "2", "2", "2", "2"), (None, "2", "2", "2", "2"),
    ]
    df = spark.createDataFrame(rows, "accessinet string, hispeed string, othsvcex string, dialup string, satellite string").coalesce(1)
    assert values(df, P.connectivity_class()) == ["none", "cellular_only", "dialup_only", None, None, None, None]
    assert values(df, P.flag(P.unconnected())) == [1, 1, 1, 0, 0, 0, 0]
    classes = P.any_of(P.no_internet(), P.cellular_only(), P.dialup_only())
    assert values(df, P.flag(classes)) == [1, 1, 1, 0, 0, 0, 0]


def test_income_tests(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (1.0,), (50000.0,), (50001.0,), (None,)], "hincp double").coalesce(1)
    assert values(df, P.flag(P.income_at_most(50000, positive=True))) == [0, 0, 1, 1, 0, 0]
    assert values(df, P.flag(P.income_at_most(50000))) == [1, 1, 1, 1, 0, 0]


def test_codes_keep_zeros():
    assert codes.VETERAN_PERIODS[0] == "01" and codes.VETERAN_PERIODS[-1] == "14"
    assert codes.HISPANIC_ORIGINS[0] == "02" and codes.HISPANIC_ORIGINS[-1] == "24"
    assert codes.SCHOOL_GRADES_K12[0] == "02" and codes.SCHOOL_GRADES_K12[-1] == "14"
    assert len(codes.STATE_POSTAL_CODES) == 50


def test_code_lists_literally():
    # written out, so that a wrong list cannot pass on both sides of a query test
    assert codes.VETERAN_PERIODS == "01 02 03 04 05 06 07 08 09 10 11 12 13 14".split()
    assert codes.HISPANIC_ORIGINS == "02 03 04 05 06 07 08 09 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24".split()
    assert codes.SCHOOL_GRADES_K12 == "02 03 04 05 06 07 08 09 10 11 12 13 14".split()
    assert (codes.SENIOR_PRESENT, codes.YES, codes.NO, codes.NO_ACCESS) == (["1", "2"], "1", "2", "3")
    assert {codes.STATE_POSTAL_CODES[n] for n in ("Alabama", "Iowa", "Maine", "Wyoming")} == {"AL", "IA", "ME", "WY"}
    assert len(set(codes.STATE_POSTAL_CODES.values())) == 50


def test_query_thresholds_literally():
    from hearthstat.plans import queries as Q

    assert (Q.THRESHOLD, Q.GAP_BAND, Q.LOW_INCOME, Q.VULNERABLE_PART, Q.OBSERVED_RATE) == (200, (136, 200), 50_000, 0.43, 19.52)
    assert Q.BENEFIT_MIX == ((0.0685, 75.0), (0.9315, 30.0)) and Q.PORTAL_SHARES == (0.84, 0.9315, 0.6)


def test_lookup_of_unknown_is_null(spark):
    df = spark.createDataFrame([("Ohio",), ("Puerto Rico",), (None,)], "name string").coalesce(1)
    assert values(df, P.lookup("name", codes.STATE_POSTAL_CODES)) == ["OH", None, None]


def test_curve_arithmetic(spark):
    df = spark.createDataFrame([(1,), (12,), (13,), (72,)], "m int").coalesce(1)
    assert values(df, period_bucket("m")) == [1, 1, 2, 6]
    curve = values(df, logistic("m", 44, 0.126121, 26.28838))
    assert curve[0] == pytest.approx(44 / (1 + math.exp(-0.126121 * (1 - 26.28838))))
    assert values(df, rescale(logistic("m", 44, 0.126121, 26.28838), 44, 22.39))[0] == pytest.approx(curve[0] * 22.39 / 44)
    assert values(df, ratio(F.col("m"), F.lit(0))) == [None] * 4
    assert blended_benefit([(0.0685, 75), (0.9315, 30)]) == pytest.approx(33.0825)


def test_peak_rate_from_budget(spark):
    df = spark.createDataFrame([(2458751880.50, 19323551), (1819605874.50, 19323551)], "budget double, universe long").coalesce(1)
    benefit = blended_benefit([(0.0685, 75), (0.9315, 30)])
    assert values(df, peak_rate("budget", "universe", benefit))[0] == pytest.approx(32.0515, abs=1e-4)
    assert values(df, peak_rate("budget", "universe", benefit, 1.02))[1] == pytest.approx(23.2547, abs=1e-4)


def test_labels(spark):
    df = spark.createDataFrame([(1.25e9,), (350e6,), (2406460.06,), (12345.0,), (None,)], "x double").coalesce(1)
    assert values(df, labels.money("x")) == ["$1.2B", "$350M", "$2M", "$0M", None]
    assert values(df, labels.money_small("x")) == ["$1250M", "$350M", "$2M", "$12345", None]
    assert values(df, labels.billions("x")) == ["$1.2B", "$0.4B", "$0.0B", "$0.0B", None]
    assert values(df, labels.count("x")) == ["1250.0M", "350.0M", "2.4M", "12K", None]
    assert values(df, labels.percent(F.col("x") / 1e10)) == ["12.5%", "3.5%", "0.0%", "0.0%", None]
    assert values(df, labels.thousands("x")) == ["1,250,000,000", "350,000,000", "2,406,460", "12,345", None]


def test_empty_universe_has_no_rate(spark):
    df = spark.createDataFrame([(5.0, 0)], "budget double, universe long")
    assert values(df, peak_rate("budget", "universe", 33.0)) == [None]
    assert values(df, rescale("budget", "universe", 3)) == [None]
