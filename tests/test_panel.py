import datetime

import pytest
from pyspark.sql import functions as F

from hearthstat.operators import panel

ROWS = [("a", 2024, 0.0), ("a", 2025, 10.0), ("a", 2026, 30.0), ("b", 2024, 5.0), ("b", 2025, None), ("b", 2026, 7.0)]


@pytest.fixture
def series(spark):
    return spark.createDataFrame(ROWS, "s string, year int, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("s", "year").collect()]


def test_difference_starts_at_zero(series):
    assert column(panel.period_diff(series, "v", "year", ["s"]), "difference") == [0, 10.0, 20.0, 0, 0, 0]


def test_share_spread_and_running_total(series):
    out = panel.share_of_total(series, "v", ["s"])
    assert column(out, "share")[:3] == [0.0, 0.25, 0.75]
    out = panel.first_value(series, "v", "year", ["s"])
    assert column(out, "first") == [0.0] * 3 + [5.0] * 3
    out = panel.spread_in_proportion(series, "v", F.lit(8.0), ["s"])
    assert column(out, "spread")[:3] == [0.0, 12.0, 36.0]
    assert column(panel.running_total(series, "v", "year", ["s"]), "running") == [0.0, 10.0, 40.0, 5.0, 5.0, 12.0]


def test_zero_total_gives_no_share(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0)], "s string, year int, v double")
    assert column(panel.share_of_total(df, "v", ["s"]), "share") == [None, None]


def test_offset_alignment(spark, series):
    costs = spark.createDataFrame([("a", 1, 3.0), ("b", 1, 4.0)], "s string, p int, cost double")
    out = panel.align(series, costs, "year", "p", 2025, ["s"])
    assert column(out, "cost") == [None, None, 3.0, None, None, 4.0]


def test_mean_without_first_and_first_periods(series):
    assert {r.s: r["mean"] for r in panel.mean_after_first(series, "v", "year", ["s"]).collect()} == {"a": 20.0, "b": 7.0}
    assert panel.mean_after_first(series.where("s = 'a'"), "v", "year").first()[0] == 20.0
    assert sorted(r.year for r in panel.first_periods(series.where("s = 'a'"), "year", 2).collect()) == [2024, 2025]


def test_one_series_without_columns_has_to_be_said(series):
    alone = series.where("s = 'a'")
    for operation in (panel.period_diff, panel.running_total, panel.first_value):
        with pytest.raises(ValueError):
            operation(alone, "v", "year")
        assert operation(alone, "v", "year", ()).count() == alone.count()
    parts = [r["share"] for r in panel.share_of_total(alone, "v").collect()]
    assert sum(x for x in parts if x is not None) == pytest.approx(1.0)
    assert sorted(r.year for r in panel.first_periods(series, "year", 2, ["s"]).collect()) == [2024, 2024, 2025, 2025]


def test_records_to_panel(spark):
    rows = [(2018, "1", "01/2018", 5), (2018, "1", "01/2018", 6), (2017, "12", "12/2017", 9), (None, "1", "x", 100), (2019, "2", "bad", 1)]
    df = spark.createDataFrame(rows, "y int, m string, text string, n long")
    out = panel.panel_totals(df, ["y", "m", "text"], {"n": "n"}, since=("y", 2018))
    dated = {(r.y, r.n): r.day for r in panel.with_parsed_date(out, "text", "MM/yyyy", "day").collect()}
    assert dated == {(2018, 11): datetime.date(2018, 1, 1), (2019, 1): None}


def test_reduce_and_set_value(series):
    out = panel.panel_reduce(series, ["s"], {"v": "sum", "year": "max"})
    assert {r.s: (r.v, r.year) for r in out.collect()} == {"a": (40.0, 2026), "b": (12.0, 2026)}
    assert column(panel.set_value(series, "v", F.col("year") == 2025, 0.0), "v") == [0.0, 0.0, 30.0, 5.0, 0.0, 7.0]
