"""The registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame over whole tables.

Floating-point results are rounded at the end, so that they can be compared with the SQL twins in
:mod:`hearthstat.plans.twins`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.functions import codes, labels
from hearthstat.functions import predicates as P
from hearthstat.functions.curves import blended_benefit, logistic, peak_rate, ratio, rescale
from hearthstat.operators import crosswalk as X
from hearthstat.operators import distribution as D
from hearthstat.operators import fitting, panel, scenario
from hearthstat.operators import totals as T
from hearthstat.operators.members import (
    Flag,
    MemberValue,
    both_flag,
    either_flag,
    household_flag,
    key_profile,
    member_flag,
    rollup_members,
)
from hearthstat.plans.binding import role

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries (the library itself has no domain constants).
# Thresholds, rates, mixes, shares and scenario parameters of the queries.
THRESHOLD = 200
GAP_BAND = (136, 200)
LOW_INCOME = 50_000
VULNERABLE_PART = 0.43
BENEFIT_MIX = ((0.0685, 75.0), (0.9315, 30.0))
FLAT_BENEFIT = 30.0
LOADING = 1.02
PORTAL_SHARES = (0.84, 0.9315, 0.6)
FEE = 100.0
PROGRAM_START = 1996
TERRITORY = "24"
SCENARIOS = (
    scenario.Scenario("S1", 44.0, 0.1261215, 26.28837),
    scenario.Scenario("S3", 20.22, 0.1862888, 17.60684),
    scenario.Scenario("S1_low", 44.0, 0.1261215, 26.28837, drawn_to=22.39),
)
OBSERVED_RATE = 19.52
NAME_CODES = {
    "ALGERIA": "DZ", "ARGENTINA": "AR", "BRAZIL": "BR", "CANADA": "CA", "CHINA": "CN", "EGYPT": "EG",
    "FRANCE": "FR", "GERMANY": "DE", "INDIA": "IN", "JAPAN": "JP", "KENYA": "KE", "PERU": "PE",
}

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name).cast("double"), n) for name, n in digits.items()})


# --- flags -----------------------------------------------------------------------------------------


def eligible(threshold: int = THRESHOLD) -> Flag:
    return either_flag(P.household_qualifies(), P.member_qualifies(threshold))


def gap() -> Flag:
    return both_flag(P.household_without_food_support(), P.member_only_by_income(*GAP_BAND))


def unconnected() -> Flag:
    return household_flag(P.unconnected())


def subgroups() -> dict[str, Flag]:
    return {
        "veteran": member_flag(P.code_in("vps", codes.VETERAN_PERIODS)),
        "senior": household_flag(P.code_in("r65", codes.SENIOR_PRESENT)),
        "black": member_flag(F.col("racblk") == codes.YES),
        "latinx": member_flag(P.code_in("hisp", codes.HISPANIC_ORIGINS)),
    }


def weighted() -> Column:
    return F.col("wgtp") > 0


def on(name: str) -> Column:
    return F.col(name) == 1


def by_area(
    spark: SparkSession, sf_dir: str, flags: dict[str, Flag], carry: Sequence[str], universe: Column | None = None
) -> DataFrame:
    """Household roll-up with area columns carried; the serial number is the primary key of the table behind."""
    households = role(spark, sf_dir, "area_households")
    if universe is not None:
        households = households.where(universe)
    return rollup_members(
        households, role(spark, sf_dir, "persons"), ["serialno"], "wgtp", flags, carry=carry, unique_key=True
    )


AREA_MEASURES = ("hh_eligible", "hh_unconnected", "hh_eligible_unconnected")


def area_conditions() -> dict[str, Column]:
    return {
        "hh_eligible": on("eligible"),
        "hh_unconnected": on("unconnected"),
        "hh_eligible_unconnected": on("eligible") & on("unconnected"),
    }


def totals_per_area(spark: SparkSession, sf_dir: str, by: Sequence[str]) -> DataFrame:
    rolled = by_area(spark, sf_dir, {"eligible": eligible(), "unconnected": unconnected()}, by)
    return T.weighted_totals(rolled, "hh_weight", area_conditions(), by)


# --- national totals -------------------------------------------------------------------------------


@query
def eligibility_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households that qualify, and those that are also unconnected or of low income."""
    rolled = rollup_members(
        role(spark, sf_dir, "households"),
        role(spark, sf_dir, "persons"),
        ["serialno"],
        "wgtp",
        {
            "eligible": eligible(),
            "unconnected": unconnected(),
            "vulnerable": household_flag(P.income_at_most(LOW_INCOME, positive=True)),
        },
    )
    return T.weighted_totals(rolled, "hh_weight", {
        "hh_eligible": on("eligible"),
        "hh_eligible_unconnected_or_vulnerable": on("eligible") & (on("unconnected") | on("vulnerable")),
        "hh_eligible_unconnected": on("eligible") & on("unconnected"),
        "hh_eligible_vulnerable": on("eligible") & on("vulnerable"),
    })


@query
def eligibility_vulnerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant with a connected low-income group, a fixed part of which counts; joined on area and serial number."""
    rolled = rollup_members(
        role(spark, sf_dir, "area_households"),
        role(spark, sf_dir, "area_persons"),
        ["area20", "serialno"],
        "wgtp",
        {
            "eligible": eligible(),
            "unconnected": unconnected(),
            "low_income": household_flag(P.income_at_most(LOW_INCOME)),
        },
    )
    out = T.weighted_totals(rolled, "hh_weight", {
        "hh_eligible": on("eligible"),
        "hh_eligible_unconnected": on("eligible") & on("unconnected"),
        "hh_low_income": on("eligible") & on("low_income") & ~on("unconnected"),
    })
    return rounded(out.withColumn("vulnerable", F.col("hh_low_income") * VULNERABLE_PART), {"vulnerable": 4})


def _gap_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"eligible": eligible(), "gap": gap(), "unconnected": unconnected(), **subgroups()}
    return rollup_members(
        role(spark, sf_dir, "households").where(weighted()), role(spark, sf_dir, "persons"), ["serialno"], "wgtp", flags
    ).where(on("eligible") & on("unconnected"))


@query
def gap_by_subgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households that would lose eligibility at the lower threshold, overall and per subgroup."""
    measures: dict[str, Column | None] = {"hh_eligible": None, "hh_gap": on("gap")}
    for name in subgroups():
        measures[name] = on(name)
        measures[f"{name}_gap"] = on(name) & on("gap")
    return T.weighted_totals(_gap_households(spark, sf_dir), "hh_weight", measures, empty="null")


@query
def gap_whole_household(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap households in the strict reading: no member and no household test qualifies below the band."""
    rolled = rollup_members(
        role(spark, sf_dir, "households").where(weighted()),
        role(spark, sf_dir, "persons"),
        ["serialno"],
        "wgtp",
        {"gap": gap(), "qualifies_below": eligible(GAP_BAND[0] - 1)},
    )
    return T.weighted_totals(rolled, "hh_weight", {
        "gap_any_member": on("gap"),
        "gap_whole_household": on("gap") & ~on("qualifies_below"),
    })


def _area_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rural share of every area, through the zip crosswalk."""
    return X.compose(
        role(spark, sf_dir, "area_zip"),
        role(spark, sf_dir, "zip_rural").where(F.col("urban_rural_code") == "R"),
        "puma_id",
        ("zipcode", "zip"),
        ("allocation_factor", "allocation_factor"),
        factor_as="rural_share",
    )


def _gap_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per area: eligible and gap weight among unconnected households, overall and per subgroup, with rural parts."""
    flags = {"eligible": eligible(), "gap": gap(), "unconnected": unconnected(), **subgroups()}
    rolled = by_area(spark, sf_dir, flags, ["area10"], weighted()).where(on("unconnected"))
    measures = {"total": on("eligible"), "lost": on("gap")}
    for name in subgroups():
        measures[f"{name}_total"] = on(name) & on("eligible")
        measures[f"{name}_lost"] = on(name) & on("gap")
    areas = T.weighted_totals(rolled, "hh_weight", measures, ["area10"])
    return X.apply_share(
        areas, _area_shares(spark, sf_dir), "area10", "puma_id", "rural_share",
        {"rural_total": "total", "rural_lost": "lost"},
    )


@query
def subgroup_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subgroup: eligible households, households lost at the lower threshold, change in percent."""
    names = [*subgroups(), "rural"]
    columns = ["total", "lost", *[f"{n}_{kind}" for n in names for kind in ("total", "lost")]]
    wide = T.plain_totals(_gap_areas(spark, sf_dir), columns)
    groups = {"overall": ("total", "lost"), **{n: (f"{n}_total", f"{n}_lost") for n in names}}
    return rounded(T.subgroup_change(wide, groups), {"total": 4, "lost": 4})


@query
def crosswalk_compose_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible and gap households, and their rural part through the two-hop crosswalk."""
    out = T.plain_totals(_gap_areas(spark, sf_dir), ["total", "lost", "rural_total", "rural_lost"])
    return rounded(
        out.withColumnsRenamed({"total": "hh_eligible", "lost": "hh_gap", "rural_total": "rural_eligible", "rural_lost": "rural_gap"}),
        {"rural_eligible": 4, "rural_gap": 4},
    )


@query
def rural_share_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed crosswalk itself: rural share per area."""
    return rounded(_area_shares(spark, sf_dir), {"rural_share": 8})


@query
def school_age_unconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households with a pupil and no connection, and their share of all households."""
    rolled = rollup_members(
        role(spark, sf_dir, "households"),
        role(spark, sf_dir, "persons"),
        ["serialno"],
        "wgtp",
        {"unconnected": unconnected(), "pupil": member_flag(P.code_in("schg", codes.SCHOOL_GRADES_K12))},
    )
    out = T.weighted_totals(rolled, "hh_weight", {
        "households": None,
        "hh_unconnected": on("unconnected"),
        "hh_pupil": on("pupil"),
        "hh_pupil_unconnected": on("pupil") & on("unconnected"),
    })
    return rounded(out.withColumn("share", ratio("hh_pupil_unconnected", "households")), {"share": 8})


@query
def connectivity_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households and people, in all and unconnected; three-column key, occupied units only."""
    rolled = rollup_members(
        role(spark, sf_dir, "area_households").where(F.col("np") > 0),
        role(spark, sf_dir, "area_persons"),
        ["area20", "area10", "serialno"],
        "wgtp",
        {
            "no_internet": household_flag(P.no_internet()),
            "cellular_only": household_flag(P.cellular_only()),
            "dialup_only": household_flag(P.dialup_only()),
        },
        values={"population": MemberValue("sum", F.col("pwgtp"))},
        weight_as="households",
    )
    without = P.any_of(on("no_internet"), on("cellular_only"), on("dialup_only"))
    return rolled.agg(
        T.total_where("households").alias("households"),
        T.total_where("population").alias("population"),
        T.total_where("households", without, "null").alias("households_unconnected"),
        T.total_where("population", without, "null").alias("population_unconnected"),
    )


@query
def connectivity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households per kind of missing connection; no member data needed."""
    classed = role(spark, sf_dir, "households").withColumn("connectivity", P.connectivity_class())
    return T.weighted_totals(
        classed.where(F.col("connectivity").isNotNull()), "wgtp", {"households": None}, ["connectivity"]
    )


@query
def level_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households per poverty band: each person is banded, the household takes the highest band."""
    bands = [P.Band(1, hi=135, closed="neither"), P.Band(2, 135, 200), P.Band(3, lo=200, closed="neither")]
    rolled = rollup_members(
        role(spark, sf_dir, "households").where(weighted()),
        role(spark, sf_dir, "persons"),
        ["serialno"],
        "wgtp",
        {"eligible": eligible()},
        values={
            "level": MemberValue("max", P.band("povpip", bands)),
            "lowest": MemberValue("min", F.col("povpip")),
            "highest": MemberValue("max", F.col("povpip")),
        },
    ).withColumn("level", F.coalesce("level", F.lit(0)).cast("bigint"))
    return rolled.groupBy("level").agg(
        F.sum("hh_weight").alias("households"),
        T.total_where("hh_weight", on("eligible")).alias("hh_eligible"),
        F.min("lowest").cast("bigint").alias("lowest"),
        F.max("highest").cast("bigint").alias("highest"),
    )


@query
def household_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the household key is unique and how many households have members."""
    return rounded(
        key_profile(role(spark, sf_dir, "households"), role(spark, sf_dir, "persons"), ["serialno"]), {"match_rate": 8}
    )


# --- areas -----------------------------------------------------------------------------------------


@query
def area_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible and unconnected households per state, in state order."""
    return T.order_nulls_last(totals_per_area(spark, sf_dir, ["state_id"]), "state_id")


def _cost_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = role(spark, sf_dir, "cost_groups")
    sums = T.weighted_totals(groups, "total_households", {
        "high_cost_households": F.col("high_cost_indicator") == "true",
        "low_cost_households": F.col("high_cost_indicator") == "false",
        "total_households": None,
    }, ["state_id"])
    return sums.withColumn("high_cost_share", ratio("high_cost_households", "total_households"))


@query
def area_share_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-cost share of a state times its eligible unconnected households."""
    out = X.share_times_total(
        _cost_shares(spark, sf_dir), totals_per_area(spark, sf_dir, ["state_id"]), "state_id",
        "high_cost_share", "hh_eligible_unconnected", "high_cost_eligible_unconnected",
    )
    return rounded(out, {"high_cost_share": 8, "high_cost_eligible_unconnected": 4})


def _state_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = by_area(
        spark, sf_dir, {"eligible": eligible(), "unconnected": unconnected()}, ["state_id"], weighted()
    )
    totals = T.weighted_totals(rolled, "hh_weight", area_conditions(), ["state_id"])
    names = T.latest_rows(role(spark, sf_dir, "states"), "year", ["state_id"]).select(
        "state_id", F.col("geo_name").alias("state_name"), "total_households"
    )
    return X.decorate(
        totals, names, "state_id", "state_name", NAME_CODES, "state_code",
        {"rate": ("hh_eligible_unconnected", "total_households")},
    )


@query
def area_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State totals with name, code and rate (the table behind a map)."""
    return rounded(_state_rates(spark, sf_dir), {"rate": 8})


@query
def area_rates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five states with the highest rate, one territory left out by its key."""
    states = _state_rates(spark, sf_dir).where(F.col("state_id") != TERRITORY)
    return rounded(T.top_k(states, "rate", 5, ["state_id"]), {"rate": 8})


@query
def latest_period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographic totals of the latest year of the household table, over two tables joined on zip and year."""
    population = role(spark, sf_dir, "zip_population").withColumn("known", F.lit(True))
    joined = role(spark, sf_dir, "zip_households").join(population, ["zip", "year"], "left")
    sources = {"households": "total_households", "population": "total_hh_population", "black": "total_black", "latino": "total_hispanic"}
    return T.latest_totals(joined, "year", {new: T.total_where(old, F.col("known"), "null") for new, old in sources.items()})


# --- crosswalks ------------------------------------------------------------------------------------


def _district_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.link_table(role(spark, sf_dir, "area_district"), "puma_id", "district", "allocation_factor")


def _allocated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Moved and unmatched totals."""
    areas = totals_per_area(spark, sf_dir, ["state_id", "area10"])
    links = _district_links(spark, sf_dir)
    moved = X.allocate(
        areas, links, "area10", "puma_id", "district", "allocation_factor", AREA_MEASURES, ["state_id"]
    )
    return moved, X.unmatched(areas, links, "area10", "puma_id")


@query
def crosswalk_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per state and district."""
    moved, _ = _allocated(spark, sf_dir)
    return rounded(T.order_nulls_last(moved, "state_id", "district"), dict.fromkeys(AREA_MEASURES, 4))


@query
def crosswalk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area totals beside every district of the area, unmatched areas included."""
    out = X.overlap(totals_per_area(spark, sf_dir, ["state_id", "area10"]), _district_links(spark, sf_dir), "area10", "puma_id")
    return rounded(out.drop("state_id"), {"allocation_factor": 8})


@query
def crosswalk_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the areas without a link."""
    return _allocated(spark, sf_dir)[1]


@query
def crosswalk_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and eligible weight that find a link."""
    areas = totals_per_area(spark, sf_dir, ["state_id", "area10"])
    return rounded(
        X.match_rate(areas, _district_links(spark, sf_dir), "area10", "puma_id", "hh_eligible"), {"rate": 8}
    )


@query
def crosswalk_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per state and district with the unmatched remainder spread by eligible households."""
    out = X.allocate_all(
        totals_per_area(spark, sf_dir, ["state_id", "area10"]), _district_links(spark, sf_dir), "area10", "puma_id",
        "state_id", "district", "allocation_factor", "hh_eligible", AREA_MEASURES,
    )
    return rounded(out, dict.fromkeys(AREA_MEASURES, 4))


def _tract_means(spark: SparkSession, sf_dir: str, only: Column | None) -> DataFrame:
    rolled = by_area(spark, sf_dir, {"eligible": eligible()}, ["area10"])
    if only is not None:
        rolled = rolled.where(only)
    areas = X.area_measures(rolled, {"households": F.col("hh_weight")}, ["area10"])
    links = X.link_table(role(spark, sf_dir, "area_tract"), "puma22_id", "tract_id", "allocation_factor")
    tracts = X.allocate(areas, links, "area10", "puma22_id", "tract_id", "allocation_factor", ["households"])
    means = X.entity_means(
        role(spark, sf_dir, "locations"), F.left(F.col("block_fips"), F.lit(11)), "tract_id",
        ["served_by_copper_100_20", "served_by_coaxcable_100_20", "served_by_fiber_100_20"],
        "location_id", "providers_per_location",
    )
    return X.attach_means(tracts, means, "tract_id")


@query
def entity_mean_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All households and the mean provider count per tract, in tract order."""
    out = T.order_nulls_last(_tract_means(spark, sf_dir, None), "tract_id")
    return rounded(out, {"households": 4, "providers_per_location": 8})


@query
def entity_mean_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with eligible households only."""
    return rounded(_tract_means(spark, sf_dir, on("eligible")), {"households": 4, "providers_per_location": 8})


@query
def weighted_mean_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean provider count over tracts, weighted by eligible households."""
    tracts = _tract_means(spark, sf_dir, on("eligible"))
    return rounded(T.weighted_mean(tracts, "providers_per_location", "households"), {"weighted_mean": 8})


# --- distributions ---------------------------------------------------------------------------------


def _eligible_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest poverty level of eligible unconnected households, for all and for veteran households."""
    rolled = rollup_members(
        role(spark, sf_dir, "households").where(weighted()),
        role(spark, sf_dir, "persons"),
        ["serialno"],
        "wgtp",
        {"eligible": eligible(), "unconnected": unconnected(), "veteran": subgroups()["veteran"]},
        values={"povpip": MemberValue("max", F.col("povpip"))},
    ).where(on("eligible") & on("unconnected"))
    return rolled.withColumns({
        "veteran_weight": P.masked(on("veteran"), "hh_weight"),
        "veteran_level": P.masked(on("veteran"), "povpip"),
    })


@query
def threshold_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of eligible households between two poverty levels, for all and for veteran households."""
    levels = _eligible_levels(spark, sf_dir)
    inside = P.within("povpip", 135, 200)
    sums = levels.agg(
        F.coalesce(F.sum("hh_weight"), F.lit(0)).alias("all_total"),
        F.coalesce(F.sum(P.masked(inside, "hh_weight")), F.lit(0)).alias("all_inside"),
        F.coalesce(F.sum("veteran_weight"), F.lit(0)).alias("veteran_total"),
        F.coalesce(F.sum(P.masked(inside, "veteran_weight")), F.lit(0)).alias("veteran_inside"),
    )
    return sums.withColumns({
        "all_share": F.bround(ratio("all_inside", "all_total"), 2),
        "veteran_share": F.bround(ratio("veteran_inside", "veteran_total"), 3),
    })


@query
def threshold_share_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold share operator per state, on the household income."""
    return T.threshold_share(
        by_area_income(spark, sf_dir), "wgtp", P.within("hincp", 10_000, 50_000, "left"), ["state_id"], 3
    )


def by_area_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, "area_households").where(weighted()).select("state_id", "wgtp", "hincp")


@query
def hist_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poverty histogram of eligible unconnected households, bins of 5 up to 200, with the threshold class."""
    levels = D.stack_populations(_eligible_levels(spark, sf_dir), {
        "all": D.Population(F.col("povpip").isNotNull(), F.col("povpip"), F.col("hh_weight")),
        "veteran": D.Population(F.col("veteran_level").isNotNull(), F.col("veteran_level"), F.col("veteran_weight")),
    })
    histogram = D.weighted_hist(levels, "value", "weight", 0, 200, 5, ["population"])
    return _histogram(D.threshold_class(histogram, 135).drop("total"), ["above_threshold"])


def _histogram(df: DataFrame, more_integers: Sequence[str] = ()) -> DataFrame:
    return rounded(
        df.withColumns({name: F.col(name).cast("bigint") for name in ("bin", *more_integers)}),
        {"bin_left": 6, "bin_right": 6},
    )


LEVEL_POPULATIONS = ("unconnected", "all", "food_support", "medical")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest poverty level per household for four overlapping populations, from one roll-up."""
    rolled = rollup_members(
        role(spark, sf_dir, "households"),
        role(spark, sf_dir, "persons"),
        ["serialno"],
        "wgtp",
        {
            "unconnected": household_flag(P.any_of(P.no_internet(), P.cellular_only(), P.dialup_only())),
            "food_support": household_flag(P.household_qualifies()),
        },
        values={
            "lowest": MemberValue("min", F.col("povpip")),
            "lowest_medical": MemberValue("min", P.masked(F.col("hins4") == codes.YES, "povpip")),
        },
    )
    known = F.col("lowest").isNotNull() & (F.col("hh_weight") > 0)
    lowest, weight = F.col("lowest"), F.col("hh_weight")
    return D.stack_populations(rolled, {
        "unconnected": D.Population(on("unconnected"), lowest, weight),
        "all": D.Population(known, lowest, weight),
        "food_support": D.Population(known & on("food_support"), lowest, weight),
        "medical": D.Population(
            F.col("lowest_medical").isNotNull() & (weight > 0), F.col("lowest_medical"), weight
        ),
    })


@query
def hist_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms with 50 bins over the observed range of each of four populations."""
    return _histogram(
        D.weighted_hist_auto(_levels(spark, sf_dir), "value", "weight", 50, ["population"], LEVEL_POPULATIONS)
    )


@query
def hist_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative form of the four histograms."""
    histogram = D.weighted_hist_auto(_levels(spark, sf_dir), "value", "weight", 50, ["population"], LEVEL_POPULATIONS)
    return rounded(_histogram(D.cumulative(histogram, ["population"])), {"cumulative_share": 8})


@query
def hist_cumulative_unconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative distribution of the unconnected with 100 bins; unknown levels stay in the denominator."""
    levels = _levels(spark, sf_dir).where(F.col("population") == "unconnected").drop("population")
    histogram = D.weighted_hist_auto(levels, "value", "weight", 100)
    return rounded(_histogram(D.cumulative(histogram)), {"cumulative_share": 8})


@query
def level_share_unconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households of each population at or below the lower threshold, and their share."""
    return T.threshold_share(_levels(spark, sf_dir), "weight", F.col("value") <= 135, ["population"], 4)


# --- panels ----------------------------------------------------------------------------------------


@query
def panel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers and disbursements per month from raw records, with the month text parsed to a date."""
    sums = panel.panel_totals(
        role(spark, sf_dir, "subscriber_records"),
        ["support_year", "support_month", "month_text"],
        {"subscribers": "subscribers", "disbursed": "disbursed"},
        since=("support_year", 1997),
    )
    dated = panel.with_parsed_date(sums, "month_text", "MM/yyyy", "month_start")
    return T.order_nulls_last(dated, "support_year", "support_month")


@query
def panel_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers and disbursements per year, in year order."""
    sums = panel.panel_totals(
        role(spark, sf_dir, "subscriber_records"), ["support_year"],
        {"subscribers": "subscribers", "disbursed": "disbursed"},
    )
    return T.order_nulls_last(sums, "support_year")


@query
def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, maximum, mean and median of the yearly available funds, per state."""
    out = T.summary(role(spark, sf_dir, "state_ledger"), "available", ["state_id"])
    return rounded(out, {"mean": 4, "median": 4})


@query
def panel_diff_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly state panel: change, share of the state total, running total, first value handed out in proportion."""
    by = ["state_id"]
    out = panel.period_diff(role(spark, sf_dir, "state_ledger").drop("committed"), "available", "year", by)
    out = panel.share_of_total(out, "available", by)
    out = panel.running_total(out, "available", "year", by)
    out = panel.first_value(out, "available", "year", by)
    out = panel.spread_in_proportion(out, "available", F.col("first"), by)
    return rounded(out, {"share": 8, "spread": 2})


@query
def panel_first_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three years of every state, one cell of the second set to zero."""
    first = panel.first_periods(role(spark, sf_dir, "state_ledger"), "year", 3, ["state_id"])
    return panel.set_value(first, "available", F.col("year") == 1996, 0)


@query
def panel_mean_after_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean yearly funds per state without the first year."""
    out = panel.mean_after_first(role(spark, sf_dir, "state_ledger"), "available", "year", ["state_id"], "mean_available")
    return rounded(out, {"mean_available": 2})


# --- projections and budget ------------------------------------------------------------------------


def _universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals_per_area(spark, sf_dir, ["state_id"]).select(
        "state_id", F.col("hh_eligible_unconnected").alias("universe")
    )


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    benefits = [
        scenario.Benefit("mixed", blended_benefit(BENEFIT_MIX)),
        scenario.Benefit("flat", FLAT_BENEFIT),
        scenario.Benefit("mixed_loaded", blended_benefit(BENEFIT_MIX), LOADING),
    ]
    return scenario.scenario_grid(_universes(spark, sf_dir), "universe", SCENARIOS, benefits, 1, 72)


@query
def logistic_projection_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost, adoption and enrolment per state, scenario, benefit rule and program year."""
    out = scenario.yearly_rollup(_grid(spark, sf_dir), ["state_id", "scenario", "benefit"], name="program_year")
    return rounded(
        out.withColumn("program_year", F.col("program_year").cast("bigint")),
        {"cost": 2, "adoption_rate": 6, "enrolled_hh": 4},
    )


@query
def scenario_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scenarios side by side per state and month, under the mixed benefit."""
    grid = _grid(spark, sf_dir).where(F.col("benefit") == "mixed")
    measures = ["adoption_rate", "enrolled_hh", "cost"]
    out = scenario.compare_scenarios(grid, ["state_id", "months"], ["S1", "S3"], measures)
    digits = {"adoption_rate": 6, "enrolled_hh": 4, "cost": 3}
    return rounded(
        out.withColumn("months", F.col("months").cast("bigint")),
        {f"{s}_{m}": digits[m] for s in ("S1", "S3") for m in measures},
    )


@query
def curve_match_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scenario scaled so that its largest monthly rate equals an observed rate, with its cost."""
    grid = _grid(spark, sf_dir).where((F.col("scenario") == "S1") & (F.col("benefit") == "mixed"))
    matched = scenario.match_observed(grid, "adoption_rate", OBSERVED_RATE, ["state_id"], "adoption_rate")
    out = scenario.project(matched, "universe", blended_benefit(BENEFIT_MIX))
    return rounded(
        out.select("state_id", F.col("months").cast("bigint").alias("months"), "adoption_rate", "enrolled_hh", "cost"),
        {"adoption_rate": 6, "enrolled_hh": 4, "cost": 3},
    )


@query
def ledger_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State ledger beside the projected yearly cost; program year 1 falls on 1997, two years into the ledger."""
    costs = scenario.yearly_rollup(
        _grid(spark, sf_dir).where((F.col("scenario") == "S1") & (F.col("benefit") == "mixed")),
        ["state_id"], name="program_year", maxima=(),
    )
    out = scenario.ledger_headroom(
        role(spark, sf_dir, "state_ledger"), costs, "available", "committed", offset=PROGRAM_START, by=["state_id"]
    )
    return rounded(out.withColumn("year", F.col("year").cast("bigint")), {"cost": 2, "headroom": 2})


@query
def ledger_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State ledger beside the yearly costs of two scenarios, one column each."""
    yearly = scenario.yearly_rollup(
        _grid(spark, sf_dir).where(F.col("benefit") == "mixed"), ["state_id", "scenario"], name="program_year", maxima=()
    )
    costs = scenario.compare_scenarios(yearly, ["state_id", "program_year"], ["S1", "S3"], ["cost"])
    out = panel.align(role(spark, sf_dir, "state_ledger"), costs, "year", "program_year", PROGRAM_START, ["state_id"])
    return rounded(out.withColumn("year", F.col("year").cast("bigint")), {"S1_cost": 2, "S3_cost": 2})


@query
def universe_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly cost of one scenario for universes cut at two poverty levels, from one roll-up."""
    rolled = by_area(
        spark, sf_dir, {"at_200": eligible(), "at_135": eligible(135), "unconnected": unconnected()}, ["state_id"]
    )
    wide = T.weighted_totals(rolled, "hh_weight", {
        "at_200": on("at_200") & on("unconnected"), "at_135": on("at_135") & on("unconnected"),
    }, ["state_id"])
    universes = wide.unpivot("state_id", ["at_200", "at_135"], "level", "universe")
    grid = scenario.scenario_grid(
        universes, "universe", [SCENARIOS[2]], [scenario.Benefit("mixed", blended_benefit(BENEFIT_MIX))], 1, 72
    )
    out = scenario.yearly_rollup(grid, ["state_id", "level", "universe"], name="program_year")
    return rounded(
        out.withColumn("program_year", F.col("program_year").cast("bigint")),
        {"cost": 2, "adoption_rate": 6, "enrolled_hh": 4},
    )


@query
def budget_matched_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first curve per state, drawn to the rate at which the largest yearly budget is used up."""
    benefit = blended_benefit(BENEFIT_MIX)
    budgets = panel.panel_reduce(role(spark, sf_dir, "state_ledger"), ["state_id"], {"available": "max"})
    peaks = budgets.join(_universes(spark, sf_dir), "state_id").withColumn(
        "peak", peak_rate("available", "universe", benefit, LOADING)
    )
    first = SCENARIOS[0]
    months = scenario.with_periods(peaks, 1, 72).withColumn(
        "adoption_rate",
        rescale(logistic("months", first.asymptote, first.rate, first.midpoint), first.asymptote, "peak"),
    )
    yearly = scenario.yearly_rollup(
        scenario.project(months, "universe", benefit, LOADING), ["state_id", "peak"], name="program_year"
    )
    return rounded(
        yearly.withColumn("program_year", F.col("program_year").cast("bigint")),
        {"peak": 4, "cost": 2, "adoption_rate": 4, "enrolled_hh": 3},
    )


def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = role(spark, sf_dir, "state_ledger").join(_universes(spark, sf_dir), "state_id")
    return scenario.capacity(ledger, "available", blended_benefit(BENEFIT_MIX), LOADING, "universe")


@query
def budget_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households that the available funds of a state and year can serve, their rate, and the peak rate solved back."""
    out = _capacity(spark, sf_dir).withColumn(
        "peak_rate", peak_rate("available", "universe", blended_benefit(BENEFIT_MIX), LOADING)
    )
    return rounded(scenario.market_size(out, "households", FLAT_BENEFIT), {
        "households": 3, "adoption_rate": 6, "peak_rate": 4, "market_opp": 1,
    })


@query
def fund_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fund income from the yearly increase of households that the budget can serve."""
    out = scenario.fund_income(_capacity(spark, sf_dir), "households", "year", PORTAL_SHARES, FEE, ["state_id"])
    return rounded(out.select("state_id", "year", "increase_hh", "fund_income"), {"increase_hh": 3, "fund_income": 1})


@query
def fund_income_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the first year handed out over the later increases of a rising (running) enrolment."""
    rising = panel.running_total(_capacity(spark, sf_dir), "households", "year", ["state_id"], "enrolled")
    out = scenario.fund_income_spread(rising, "enrolled", "year", PORTAL_SHARES, FEE, ["state_id"])
    return rounded(out.select("state_id", "year", "new_households", "fund_income"), {"new_households": 3, "fund_income": 1})


@query
def money_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label columns of the state ledger."""
    ledger = role(spark, sf_dir, "state_ledger")
    national = ledger.groupBy("year").agg(F.sum("available").alias("available"), F.sum("committed").alias("committed"))
    both = national.select(F.lit("all").alias("state_id"), "year", "available", "committed").unionByName(ledger)
    return both.select(
        "state_id",
        "year",
        labels.money("available").alias("money"),
        labels.money_small("committed").alias("money_small"),
        labels.billions("committed").alias("billions"),
        labels.count("available").alias("count"),
        labels.percent(ratio("available", F.col("available") + F.col("committed"))).alias("percent"),
        labels.thousands("committed").alias("thousands"),
    )


# --- fits ------------------------------------------------------------------------------------------


def _adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative enrolment per state and month, in percent of the state's households."""
    parts = panel.share_of_total(role(spark, sf_dir, "state_enrolment"), "enrolled", ["state_id"], "part")
    running = panel.running_total(parts, "part", "months", ["state_id"], "adopted")
    return running.select("state_id", "months", (F.col("adopted") * 100).alias("rate"))


@query
def adoption_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed cumulative adoption itself."""
    return rounded(_adoption(spark, sf_dir), {"rate": 6})


@query
def fit_logit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic parameters per state from a straight line on the logit scale."""
    out = fitting.logit_line(_adoption(spark, sf_dir), ["state_id"], "months", "rate", 110.0)
    return rounded(out, {"k": 6, "x0": 4})


@query
def fit_logistic_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic fit per state with a fixed asymptote."""
    out = fitting.fit_logistic(_adoption(spark, sf_dir), ["state_id"], "months", "rate", 110.0)
    return rounded(out.drop("passes"), {"L": 4, "k": 6, "x0": 4, "sse": 3})


@query
def fit_logistic_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic fit per state with a free asymptote."""
    out = fitting.fit_logistic(_adoption(spark, sf_dir), ["state_id"], "months", "rate")
    return rounded(out.drop("passes"), {"L": 3, "k": 6, "x0": 3, "sse": 3})


@query
def fitted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted curves drawn to a lower asymptote, evaluated on 72 months and priced on the state's universe."""
    fits = fitting.fit_logistic(_adoption(spark, sf_dir), ["state_id"], "months", "rate", 110.0)
    curves = scenario.evaluate_curves(fits.join(_universes(spark, sf_dir), "state_id"), 1, 72)
    drawn = curves.withColumn("adoption_rate", F.col("adoption_rate") * (44.0 / 110.0))
    priced = scenario.project(drawn, "universe", blended_benefit(BENEFIT_MIX))
    return rounded(
        priced.select("state_id", F.col("months").cast("bigint").alias("months"), "adoption_rate", "enrolled_hh", "cost"),
        {"adoption_rate": 4, "enrolled_hh": 2, "cost": 0},
    )


@query
def fit_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic trend per state beside the yearly funds it smooths, with the smoothed change."""
    ledger = role(spark, sf_dir, "state_ledger").drop("committed")
    fit = fitting.fit_quadratic(ledger, ["state_id"], "year", "available", 1998)
    smooth = ledger.join(fit.drop("points"), "state_id").withColumn("smoothed", fitting.quadratic("year", 1998))
    out = panel.period_diff(smooth, "smoothed", "year", ["state_id"], "smoothed_increase")
    return rounded(
        out.select("state_id", "year", "available", "smoothed", "smoothed_increase"),
        {"smoothed": 1, "smoothed_increase": 1},
    )


@query
def logistic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic curve over the observed months of every state."""
    points = role(spark, sf_dir, "state_enrolment")
    return rounded(
        points.select("state_id", "months", logistic("months", 44.0, 0.126, 26.0).alias("curve")), {"curve": 6}
    )
