"""Published results as literals: fitted curves, costs, capacities and fund tables."""

import pytest
from pyspark.sql import functions as F

from hearthstat.functions.curves import blended_benefit
from hearthstat.operators import fitting, panel, scenario

BENEFIT = blended_benefit([(0.0685, 75.0), (0.9315, 30.0)])
UNIVERSE = 19323551
HIGH_POINTS = [(1, 0.0), (19, 13.6), (27, 22.39)]
LOW_POINTS = [(1, 0.0), (5, 2.0), (10, 4.0), (20, 12.5), (30, 18.0)]
AVAILABLE = (
    [0] + [974447391] * 2 + [1676521171] * 2 + [1819605875] * 2 + [2458751880] * 8 + [3718053788] * 2
)


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame([("us", 2024 + i, v) for i, v in enumerate(AVAILABLE)], "s string, year int, available long")


@pytest.fixture(scope="module")
def served(ledger):
    return scenario.capacity(ledger, "available", BENEFIT, 1.02, UNIVERSE)


def series(spark, named):
    rows = [(name, x, y) for name, points in named.items() for x, y in points]
    return spark.createDataFrame(rows, "s string, x int, y double")


@pytest.fixture(scope="module")
def published_fits(spark):
    """Three scenarios with their own asymptotes, fitted in one job."""
    asymptotes = spark.createDataFrame([("S1", 44.0), ("S2", 63.0), ("S3", 20.22)], "s string, top double")
    points = series(spark, {"S1": HIGH_POINTS, "S2": HIGH_POINTS, "S3": LOW_POINTS}).join(asymptotes, "s")
    return fitting.fit_logistic(points, ["s"], "x", "y", "top")


def test_fixed_asymptote_fits(published_fits):
    rows = {r.s: r for r in published_fits.collect()}
    want = {"S1": (44.0, 0.126121, 26.28838, 3), "S2": (63.0, 0.108905, 32.0643, 3), "S3": (20.22, 0.186289, 17.60684, 5)}
    assert set(rows) == set(want)
    for name, (asymptote, k, x0, n) in want.items():
        row = rows[name]
        assert row.converged and row.L == asymptote and row.points == n
        assert row.k == pytest.approx(k, rel=2e-5) and row.x0 == pytest.approx(x0, rel=2e-5)
    assert rows["S1"].sse == pytest.approx(4.4995, abs=1e-4)


def test_monthly_projection_and_yearly_cost(published_fits):
    grid = scenario.project(scenario.evaluate_curves(published_fits, 1, 72), F.lit(UNIVERSE), BENEFIT)
    months = {(r.s, r.months): r for r in grid.collect()}
    # Published values of months 1 and 72.
    assert months["S1", 1].adoption_rate == pytest.approx(1.7409340550194665, rel=2e-5)
    assert months["S1", 1].enrolled_hh == pytest.approx(336410.27999805467, rel=2e-5)
    assert months["S1", 72].cost == pytest.approx(280400413.2143644, rel=2e-5)
    assert months["S2", 72].cost == pytest.approx(397605032.05791306, rel=2e-5)
    assert months["S3", 1].cost == pytest.approx(5605940.885156713, rel=2e-5)
    years = {(r.s, r.year): r for r in scenario.yearly_rollup(grid, ["s"]).collect()}
    high = [276.213, 947.354, 2107.229, 2963.696, 3273.548, 3352.303]
    low = [198.359, 834.045, 1401.915, 1533.098, 1549.172, 1550.919]
    assert [years["S1", y].cost / 1e6 for y in range(1, 7)] == pytest.approx(high, rel=2e-5)
    assert [years["S3", y].cost / 1e6 for y in range(1, 7)] == pytest.approx(low, rel=2e-5)
    assert years["S1", 6].adoption_rate == pytest.approx(43.862500928401644, rel=2e-5)


def test_rescaled_scenarios(spark):
    universes = spark.createDataFrame([("us", UNIVERSE)], "s string, u long")
    grid = scenario.scenario_grid(
        universes, "u",
        [scenario.Scenario("S1", 44.0, 0.126121, 26.28838), scenario.Scenario("low", 44.0, 0.126121, 26.28838, 22.39)],
        [scenario.Benefit("mixed", BENEFIT), scenario.Benefit("flat", 30.0)],
    )
    years = scenario.yearly_rollup(grid, ["s", "scenario", "benefit"])
    cost = {(r.scenario, r.benefit, r.year): r.cost / 1e6 for r in years.collect()}
    published = [140.555, 482.074, 1072.292, 1508.117, 1665.790, 1705.865]
    assert [cost["low", "mixed", y] for y in range(1, 7)] == pytest.approx(published, rel=5e-5)
    assert cost["S1", "flat", 6] == pytest.approx(cost["S1", "mixed", 6] * 30 / BENEFIT)
    wide = scenario.compare_scenarios(grid.where("benefit = 'mixed'"), ["s", "months"], ["S1", "low"], ["adoption_rate"])
    assert all(r.low_adoption_rate == pytest.approx(r.S1_adoption_rate * 22.39 / 44) for r in wide.collect())


def test_curve_drawn_at_another_asymptote(spark):
    parameters = spark.createDataFrame([(63.0, 0.126121, 25.28838)], "L double, k double, x0 double")
    rows = {r.months: r.adoption_rate for r in scenario.evaluate_curves(parameters, 0, 72).collect()}
    assert len(rows) == 73
    assert rows[0] == pytest.approx(2.4926997478891444, rel=2e-5) and rows[72] == pytest.approx(62.82639016945302, rel=2e-5)


def test_curve_matched_to_observed_rate(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 40.0)], "s string, m int, r double")
    assert [r.matched_rate for r in scenario.match_observed(df, "r", 19.52, ["s"]).orderBy("m").collect()] == pytest.approx([4.88, 19.52])


def test_capacity_equals_published(served):
    rows = {r.year: r for r in served.collect()}
    assert rows[2024].households == 0.0
    assert rows[2025].households == pytest.approx(2406460.060484558, rel=1e-12)
    assert rows[2040].households == pytest.approx(9181971.265142746, rel=1e-12)
    assert rows[2025].adoption_rate == pytest.approx(0.12453508469973029, rel=1e-12)
    assert rows[2039].adoption_rate == pytest.approx(0.47516997601231503, rel=1e-12)


def test_headroom(spark, ledger):
    costs = spark.createDataFrame([("us", 1, 1e9)], "s string, program_year int, cost double")
    out = scenario.ledger_headroom(ledger.withColumn("committed", F.lit(5)), costs, "available", "committed", by=["s"])
    rows = {r.year: r for r in out.collect()}
    assert rows[2024].headroom is None and rows[2025].cost is None
    assert rows[2026].headroom == 974447391 - 1e9 and rows[2026].stacked == 974447396


def test_free_fit_and_fund_tables(spark, served):
    zeroed = panel.set_value(served, "households", F.col("year") == 2025, 0.0).withColumn("s", F.lit("zeroed"))
    points = served.withColumn("s", F.lit("raw")).unionByName(zeroed)
    fits = fitting.fit_logistic(points, ["s"], "year", "households")
    found = {r.s: r for r in fits.collect()}
    assert found["raw"].converged and found["zeroed"].converged
    assert (found["raw"].L, found["raw"].k, found["raw"].x0) == pytest.approx((7.949e6, 0.27106, 2028.54), rel=1e-4)
    assert (found["zeroed"].L, found["zeroed"].k, found["zeroed"].x0) == pytest.approx((7.196e6, 0.43403, 2028.049), rel=1e-4)
    curve = scenario.evaluate_curves(fits.where("s = 'raw'"), 2024, 2040, "year", "fitted").collect()
    by_year = {r.year: r.fitted for r in curve}
    assert by_year[2024] == pytest.approx(1795746.263095003, rel=7e-5)
    assert by_year[2040] == pytest.approx(7608326.720991596, rel=7e-5)

    fitted = scenario.evaluate_curves(fits.where("s = 'zeroed'"), 2024, 2040, "year", "fitted")
    shares = (16323551 / 19323551, 0.9315, 0.6)
    spread = scenario.fund_income_spread(fitted, "fitted", "year", shares, 100.0, ["s"])
    income = {r.year: r.fund_income for r in spread.collect()}
    assert income[2024] == 0.0
    assert income[2025] / 1e6 == pytest.approx(25.18, abs=0.01) and income[2029] / 1e6 == pytest.approx(42.69, abs=0.01)
    mean = panel.mean_after_first(spread, "fund_income", "year", ["s"]).first()["mean"]
    assert mean / 1e6 == pytest.approx(21.116, abs=0.002)


def test_published_fund_income_and_market(served):
    rate = 113616255.12887815 / 2406460.060484558
    out = {r.year: r for r in scenario.fund_income(served, "households", "year", (rate / 100,), 100.0, ["s"]).collect()}
    assert out[2024].fund_income == 0.0 and out[2026].fund_income == 0.0
    assert out[2025].fund_income == pytest.approx(113616255.12887815)
    assert out[2039].fund_income == pytest.approx(146829031.70050254)
    market = {r.year: r.market_opp for r in scenario.market_size(served, "households", 30.0).collect()}
    assert market[2040] == pytest.approx(3305509655.451389)


def test_quadratic_trend_equals_published(served):
    fit = fitting.fit_quadratic(served, ["s"], "year", "households", 2032)
    out = served.join(fit, "s").withColumn("smoothed", fitting.quadratic("year", 2032))
    rows = {r.year: r.smoothed for r in out.collect()}
    assert rows[2024] == pytest.approx(1384165.451019287, rel=1e-9)
    assert rows[2025] == pytest.approx(2004509.4888076782, rel=1e-9)
    assert rows[2040] == pytest.approx(7978511.901062012, rel=1e-9)


def test_fits_of_poor_groups_do_not_raise(spark):
    df = series(spark, {"one": [(3, 5.0)], "same": [(3, 5.0), (3, 7.0)], "good": HIGH_POINTS}).union(
        spark.createDataFrame([("none", None, 1.0)], "s string, x int, y double")
    )
    rows = {r.s: r for r in fitting.fit_logistic(df, ["s"], "x", "y", 44.0).collect()}
    assert set(rows) == {"one", "same", "good"}
    assert rows["good"].converged and not rows["one"].converged and rows["same"].k is None
    quad = {r.s: r.c0 for r in fitting.fit_quadratic(df, ["s"], "x", "y", 0).collect()}
    assert quad["one"] is None and quad["good"] is not None


def test_repeated_points_weigh_in_and_whole_table_fit(spark):
    points = HIGH_POINTS + [(27, 24.0), (27, 23.0), (40, 36.0)]
    row = fitting.fit_logistic(series(spark, {"p": points}).drop("s"), [], "x", "y", 44.0).first()

    def sse(k, x0):
        import math
        return sum((y - 44.0 / (1 + math.exp(-k * (x - x0)))) ** 2 for x, y in points)

    assert row.sse == pytest.approx(sse(row.k, row.x0))
    for dk, dx in ((1e-4, 0), (-1e-4, 0), (0, 1e-2), (0, -1e-2)):
        assert sse(row.k + dk, row.x0 + dx) > row.sse


def test_large_group_is_cut_into_parts(spark):
    curve = scenario.evaluate_curves(
        spark.createDataFrame([("big", 30.0, 0.05, 90.0), ("small", 30.0, 0.2, 10.0)], "s string, L double, k double, x0 double"), 1, 200, "x", "y"
    ).where("s = 'big' OR x <= 9")
    noisy = curve.select("s", "x", F.expr("y + x % 3").alias("y"))
    for asymptote in (30.0, None):
        cut = {r.s: r for r in fitting.fit_logistic(noisy, ["s"], "x", "y", asymptote, fitting.Solver(row_points=10)).collect()}
        whole = {r.s: r for r in fitting.fit_logistic(noisy, ["s"], "x", "y", asymptote).collect()}
        assert set(cut) == set(whole) == {"big", "small"}
        for name, row in whole.items():
            assert row.converged and tuple(cut[name])[1:5] == pytest.approx(tuple(row)[1:5])
            assert (cut[name].points, cut[name].passes) == (row.points, row.passes)
    rows = {r.s: r for r in fitting.fit_logistic(curve.select("s", "x", "y"), ["s"], "x", "y", 30.0, fitting.Solver(row_points=10)).collect()}
    assert (rows["big"].k, rows["big"].x0) == pytest.approx((0.05, 90.0))
    assert (rows["small"].k, rows["small"].x0) == pytest.approx((0.2, 10.0))


def test_logit_line(spark):
    curve = scenario.evaluate_curves(
        spark.createDataFrame([("a", 30.0, 0.2, 12.0)], "s string, L double, k double, x0 double"), 1, 24, "x", "y"
    )
    row = fitting.logit_line(curve.select("s", "x", "y"), ["s"], "x", "y", 30.0).first()
    assert (row.k, row.x0, row.points) == (pytest.approx(0.2), pytest.approx(12.0), 24)


def test_groups_still_open_after_the_last_pass_have_no_parameters(spark):
    points = spark.createDataFrame([("a", float(x), 80 / (1 + 2.718281828 ** (-0.2 * (x - 20))) + (x % 3)) for x in range(40)], "s string, x double, y double")
    row = fitting.fit_logistic(points, ["s"], "x", "y", 80.0, fitting.Solver(passes=1)).first()
    assert (row.L, row.k, row.x0, row.sse, row.converged, row.passes) == (None, None, None, None, False, 1)
    assert fitting.fit_logistic(points, ["s"], "x", "y", 80.0).first().converged


def test_logit_line_counts_moved_points(spark):
    points = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 50.0), ("a", 3.0, 500.0)], "s string, x double, y double")
    assert fitting.logit_line(points, ["s"], "x", "y", 100.0).first().clamped == 1


def test_a_fit_runs_few_jobs(spark):
    points = spark.createDataFrame([(g, float(x), 80 / (1 + 2.718281828 ** (-0.2 * (x - 20)))) for g in "abc" for x in range(40)], "s string, x double, y double")
    spark.sparkContext.setJobGroup("few-jobs", "a fit")
    row = fitting.fit_logistic(points, ["s"], "x", "y", 80.0).first()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert row.converged
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 10  # three actions, and their shuffles


def test_income_needs_its_series_named(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("b", 2, 50.0)], "s string, year int, h double")
    for made in (scenario.fund_income, scenario.fund_income_spread):
        with pytest.raises(ValueError, match="series"):
            made(df, "h", "year", (0.5,), 1.0)
        assert made(df.where("s = 'a'"), "h", "year", (0.5,), 1.0, by=()).count() == 1
