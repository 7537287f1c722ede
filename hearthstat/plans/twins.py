"""SQL twins of the registered queries for DuckDB.

They are written the plain way - join persons to households, group afterwards, multiply household rows by
crosswalk rows - and share no code with the operators except the role texts and the query parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from hearthstat.functions import codes
from hearthstat.plans import queries as Q
from hearthstat.plans.binding import role_views

TWINS: dict[str, str] = {}


def _in(column: str, code_list: Sequence[str]) -> str:
    return f"{column} IN ({', '.join(repr(code) for code in code_list)})"


def _qualifies(threshold: int) -> str:
    return f"(h.fs = '1' OR p.hins4 = '1' OR p.pap > 0 OR p.ssip > 0 OR p.povpip <= {threshold})"


_GAP = (
    f"(p.povpip BETWEEN {Q.GAP_BAND[0]} AND {Q.GAP_BAND[1]} AND p.hins4 <> '1' AND h.fs <> '1' "
    "AND p.pap = 0 AND p.ssip = 0)"
)
_NO_FIXED = "h.accessinet = '1' AND h.hispeed = '2' AND h.othsvcex = '2' AND h.satellite = '2'"
_UNCONNECTED = f"(h.accessinet = '3' OR ({_NO_FIXED} AND h.dialup IN ('1', '2')))"
_SUBGROUPS = {
    "veteran": _in("p.vps", codes.VETERAN_PERIODS),
    "senior": _in("h.r65", codes.SENIOR_PRESENT),
    "black": "p.racblk = '1'",
    "latinx": _in("p.hisp", codes.HISPANIC_ORIGINS),
}
_ELIGIBLE = _qualifies(Q.THRESHOLD)


def _rolled(
    flags: Mapping[str, str],
    keep: Sequence[str] = (),
    extra: Mapping[str, str] | None = None,
    where: str = "TRUE",
    households: str = "households",
    persons: str = "persons",
    key: Sequence[str] = ("serialno",),
) -> str:
    """One row per household, by joining first and grouping by the key and the kept columns."""
    group = ", ".join(f"h.{name}" for name in dict.fromkeys([*key, *keep]))
    columns = [
        group,
        "max(h.wgtp) AS w",
        *[f"coalesce(bool_or({condition}), FALSE) AS {name}" for name, condition in flags.items()],
        *[f"{text} AS {name}" for name, text in (extra or {}).items()],
    ]
    match = " AND ".join(f"h.{name} = p.{name}" for name in key)
    return (
        f"SELECT {', '.join(columns)} FROM {households} h LEFT JOIN {persons} p ON {match} "
        f"WHERE {where} GROUP BY {group}"
    )


def _whole(name: str, weight: str = "w") -> str:
    return f"CAST(sum({weight}) AS BIGINT) AS {name}"


def _sum0(name: str, condition: str, weight: str = "w") -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN {weight} ELSE 0 END) AS BIGINT) AS {name}"


def _sumnull(name: str, condition: str, weight: str = "w") -> str:
    return f"CAST(sum({weight}) FILTER (WHERE {condition}) AS BIGINT) AS {name}"


def _twin(name: str, roles: Sequence[str], text: str) -> None:
    TWINS[name] = f"{role_views(roles)} {text}"


def _with(roles: Sequence[str], **tables: str) -> str:
    return role_views(roles) + "".join(f", {name} AS ({text})" for name, text in tables.items()) + " "


_HP = ["households", "persons"]
_AHP = ["area_households", "persons"]

# --- national totals -------------------------------------------------------------------------------

TWINS["eligibility_totals"] = _with(_HP, r=_rolled({
    "e": _ELIGIBLE, "u": _UNCONNECTED, "v": f"h.hincp > 0 AND h.hincp <= {Q.LOW_INCOME}",
})) + f"""SELECT {_sum0('hh_eligible', 'e')}, {_sum0('hh_eligible_unconnected_or_vulnerable', 'e AND (u OR v)')},
    {_sum0('hh_eligible_unconnected', 'e AND u')}, {_sum0('hh_eligible_vulnerable', 'e AND v')} FROM r"""

TWINS["eligibility_vulnerable"] = _with(["area_households", "area_persons"], r=_rolled(
    {"e": _ELIGIBLE, "u": _UNCONNECTED, "v": f"h.hincp <= {Q.LOW_INCOME}"},
    households="area_households", persons="area_persons", key=("area20", "serialno"),
)) + f"""SELECT {_sum0('hh_eligible', 'e')}, {_sum0('hh_eligible_unconnected', 'e AND u')},
    {_sum0('hh_low_income', 'e AND v AND NOT u')},
    round(CAST(sum(CASE WHEN e AND v AND NOT u THEN w ELSE 0 END) AS DOUBLE) * {Q.VULNERABLE_PART}, 4) AS vulnerable FROM r"""

_GAP_FLAGS = {"e": _ELIGIBLE, "g": _GAP, "u": _UNCONNECTED, **_SUBGROUPS}

TWINS["gap_by_subgroup"] = _with(_HP, r=_rolled(_GAP_FLAGS, where="h.wgtp > 0")) + (
    "SELECT " + _whole("hh_eligible") + ", " + _sumnull("hh_gap", "g") + ", "
    + ", ".join(f"{_sumnull(n, n)}, {_sumnull(f'{n}_gap', f'{n} AND g')}" for n in _SUBGROUPS)
    + " FROM r WHERE e AND u"
)

TWINS["gap_whole_household"] = _with(
    _HP, r=_rolled({"g": _GAP, "b": _qualifies(Q.GAP_BAND[0] - 1)}, where="h.wgtp > 0")
) + f"SELECT {_sum0('gap_any_member', 'g')}, {_sum0('gap_whole_household', 'g AND NOT b')} FROM r"

_RURAL = """SELECT z.puma_id, sum(z.allocation_factor * r.allocation_factor) AS rural_share
    FROM area_zip z JOIN zip_rural r ON z.zipcode = r.zip AND r.urban_rural_code = 'R' GROUP BY z.puma_id"""
_RURAL_ROLES = [*_AHP, "area_zip", "zip_rural"]
_GAP_AREAS = _rolled(_GAP_FLAGS, ["area10"], where="h.wgtp > 0", households="area_households")


def _change_row(label: str, group: str, factor: str = "") -> str:
    total = f"CAST(sum(w{factor}) FILTER (WHERE e AND u{group}) AS DOUBLE)"
    lost = f"CAST(sum(w{factor}) FILTER (WHERE g AND u{group}) AS DOUBLE)"
    return f"SELECT '{label}' AS subgroup, {total} AS t, {lost} AS l FROM d"


TWINS["subgroup_change"] = _with(
    _RURAL_ROLES, r=_GAP_AREAS, s=_RURAL,
    d="SELECT r.*, s.rural_share FROM r LEFT JOIN s ON r.area10 = s.puma_id",
    c=" UNION ALL ".join([
        _change_row("overall", ""),
        *[_change_row(n, f" AND {n}") for n in _SUBGROUPS],
        _change_row("rural", "", " * rural_share"),
    ]),
) + "SELECT subgroup, round(t, 4) AS total, round(l, 4) AS lost, round_even(-(l / t) * 100, 2) + 0.0::DOUBLE AS percent_change FROM c"

TWINS["crosswalk_compose_share"] = _with(_RURAL_ROLES, r=_GAP_AREAS, s=_RURAL) + f"""
    SELECT {_sumnull('hh_eligible', 'e AND u')}, {_sumnull('hh_gap', 'g AND u')},
        round(sum(w * rural_share) FILTER (WHERE e AND u), 4) AS rural_eligible,
        round(sum(w * rural_share) FILTER (WHERE g AND u), 4) AS rural_gap
    FROM r LEFT JOIN s ON r.area10 = s.puma_id"""

TWINS["rural_share_by_area"] = _with(["area_zip", "zip_rural"], s=_RURAL) + (
    "SELECT puma_id, round(rural_share, 8) AS rural_share FROM s"
)

TWINS["school_age_unconnected"] = _with(
    _HP, r=_rolled({"u": _UNCONNECTED, "k": _in("p.schg", codes.SCHOOL_GRADES_K12)})
) + f"""SELECT {_whole('households')}, {_sum0('hh_unconnected', 'u')}, {_sum0('hh_pupil', 'k')},
    {_sum0('hh_pupil_unconnected', 'u AND k')},
    round(CAST(sum(CASE WHEN u AND k THEN w ELSE 0 END) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 8) AS share FROM r"""

_WITHOUT = f"(h.accessinet = '3' OR ({_NO_FIXED} AND h.dialup = '2') OR ({_NO_FIXED} AND h.dialup = '1'))"

TWINS["connectivity_population"] = _with(["area_households", "area_persons"], r=_rolled(
    {"u": _WITHOUT}, extra={"people": "sum(p.pwgtp)"}, where="h.np > 0",
    households="area_households", persons="area_persons", key=("area20", "area10", "serialno"),
)) + f"""SELECT {_whole('households')}, {_whole('population', 'people')},
    {_sumnull('households_unconnected', 'u')}, {_sumnull('population_unconnected', 'u', 'people')} FROM r"""

TWINS["connectivity_classes"] = _with(["households"], c=f"""
    SELECT wgtp, CASE WHEN h.accessinet = '3' THEN 'none' WHEN {_NO_FIXED} AND h.dialup = '2' THEN 'cellular_only'
        WHEN {_NO_FIXED} AND h.dialup = '1' THEN 'dialup_only' END AS connectivity FROM households h""") + (
    f"SELECT connectivity, {_whole('households', 'wgtp')} FROM c WHERE connectivity IS NOT NULL GROUP BY connectivity"
)

TWINS["level_bands"] = _with(_HP, r=_rolled(
    {"e": _ELIGIBLE}, where="h.wgtp > 0",
    extra={
        "level": """max(CASE WHEN p.povpip < 135 THEN 1 WHEN p.povpip BETWEEN 135 AND 200 THEN 2
            WHEN p.povpip > 200 THEN 3 ELSE 0 END)""",
        "lo": "min(p.povpip)",
        "hi": "max(p.povpip)",
    },
)) + f"""SELECT CAST(level AS BIGINT) AS level, {_whole('households')}, {_sum0('hh_eligible', 'e')},
    CAST(min(lo) AS BIGINT) AS lowest, CAST(max(hi) AS BIGINT) AS highest FROM r GROUP BY level"""

TWINS["household_key_profile"] = _with(_HP, k="""
    SELECT h.serialno, count(*) AS n, bool_or(EXISTS (SELECT 1 FROM persons p WHERE p.serialno = h.serialno)) AS found
    FROM households h GROUP BY h.serialno""") + """
    SELECT CAST(sum(n) AS BIGINT) AS household_rows,
        CAST(sum(CASE WHEN serialno IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS household_keys,
        CAST(sum(CASE WHEN n > 1 AND serialno IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS repeated_keys,
        CAST(sum(CASE WHEN serialno IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_key_rows,
        CAST(sum(CASE WHEN found THEN 1 ELSE 0 END) AS BIGINT) AS keys_with_members,
        (SELECT count(DISTINCT serialno) FROM persons WHERE serialno NOT IN (SELECT serialno FROM households)) AS orphan_person_keys,
        round(sum(CASE WHEN found THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN serialno IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE), 8)
            AS match_rate
    FROM k"""

# --- areas -----------------------------------------------------------------------------------------

_AREA_FLAGS = {"e": _ELIGIBLE, "u": _UNCONNECTED}
_AREA_SUMS = (
    f"{_sum0('hh_eligible', 'e')}, {_sum0('hh_unconnected', 'u')}, {_sum0('hh_eligible_unconnected', 'e AND u')}"
)
_BY_STATE = _rolled(_AREA_FLAGS, ["state_id"], households="area_households")
_STATE_SUMS = f"SELECT state_id, {_AREA_SUMS} FROM r GROUP BY state_id"

TWINS["area_totals"] = _with(_AHP, r=_BY_STATE) + _STATE_SUMS

TWINS["area_share_transfer"] = _with([*_AHP, "cost_groups"], r=_BY_STATE, t=_STATE_SUMS, c=f"""
    SELECT state_id, {_sum0('high_cost_households', "high_cost_indicator = 'true'", 'total_households')},
        {_sum0('low_cost_households', "high_cost_indicator = 'false'", 'total_households')},
        CAST(sum(total_households) AS BIGINT) AS total_households
    FROM cost_groups GROUP BY state_id""") + """
    SELECT state_id, high_cost_households, low_cost_households, total_households,
        round(high_cost_households / CAST(total_households AS DOUBLE), 8) AS high_cost_share,
        hh_eligible, hh_unconnected, hh_eligible_unconnected,
        round(high_cost_households / CAST(total_households AS DOUBLE) * hh_eligible_unconnected, 4) AS high_cost_eligible_unconnected
    FROM c JOIN t USING (state_id)"""

_CODES = " ".join(f"WHEN '{name}' THEN '{code}'" for name, code in Q.NAME_CODES.items())
_RATES = _with(
    [*_AHP, "states"],
    r=_rolled(_AREA_FLAGS, ["state_id"], where="h.wgtp > 0", households="area_households"),
    t=_STATE_SUMS,
) + f"""SELECT t.state_id, hh_eligible, hh_unconnected, hh_eligible_unconnected, geo_name AS state_name, total_households,
    CASE geo_name {_CODES} END AS state_code,
    round(hh_eligible_unconnected / CAST(total_households AS DOUBLE), 8) AS rate
    FROM t LEFT JOIN states s ON t.state_id = s.state_id AND s.year = (SELECT max(year) FROM states)"""

TWINS["area_rates"] = _RATES
TWINS["area_rates_topk"] = (
    f"SELECT * FROM ({_RATES}) rates WHERE state_id <> '{Q.TERRITORY}' AND rate IS NOT NULL "
    "ORDER BY rate DESC, state_id LIMIT 5"
)

_twin("latest_period_totals", ["zip_population", "zip_households"], f"""
    SELECT {_whole('households', 'h.total_households')}, {_whole('population', 'z.total_hh_population')},
        {_whole('black', 'z.total_black')}, {_whole('latino', 'z.total_hispanic')}
    FROM zip_population z JOIN zip_households h ON z.zip = h.zip AND z.year = h.year
    WHERE z.year = (SELECT max(year) FROM zip_households)""")

# --- crosswalks ------------------------------------------------------------------------------------

_BY_AREA = _rolled(_AREA_FLAGS, ["state_id", "area10"], households="area_households")
_AREA_TOTALS = f"SELECT state_id, area10, {_AREA_SUMS} FROM r GROUP BY state_id, area10"
_CROSS_ROLES = [*_AHP, "area_district"]
# Household rows are multiplied by their districts before anything is summed.
_MOVED = """SELECT state_id, district,
    sum(CASE WHEN e THEN w * allocation_factor ELSE 0 END) AS hh_eligible,
    sum(CASE WHEN u THEN w * allocation_factor ELSE 0 END) AS hh_unconnected,
    sum(CASE WHEN e AND u THEN w * allocation_factor ELSE 0 END) AS hh_eligible_unconnected
    FROM r JOIN area_district x ON r.area10 = x.puma_id GROUP BY state_id, district"""
_ROUNDED = ", ".join(f"round({name}, 4) AS {name}" for name in Q.AREA_MEASURES)

TWINS["crosswalk_allocate"] = _with(_CROSS_ROLES, r=_BY_AREA, m=_MOVED) + f"SELECT state_id, district, {_ROUNDED} FROM m"

TWINS["crosswalk_overlap"] = _with(_CROSS_ROLES, r=_BY_AREA, a=_AREA_TOTALS) + """
    SELECT area10, district, round(allocation_factor, 8) AS allocation_factor,
        hh_eligible, hh_unconnected, hh_eligible_unconnected
    FROM a LEFT JOIN area_district x ON a.area10 = x.puma_id"""

_UNMATCHED = "SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM area_district x WHERE x.puma_id = a.area10)"
TWINS["crosswalk_unmatched"] = _with(_CROSS_ROLES, r=_BY_AREA, a=_AREA_TOTALS) + _UNMATCHED

TWINS["crosswalk_match_rate"] = _with(_CROSS_ROLES, r=_BY_AREA, a=_AREA_TOTALS, q="""
    SELECT hh_eligible, area10 IN (SELECT puma_id FROM area_district) AS found FROM a""") + """
    SELECT count(*) AS areas, CAST(count(*) FILTER (WHERE found) AS BIGINT) AS matched_areas,
        CAST(sum(hh_eligible) AS BIGINT) AS weight, CAST(sum(hh_eligible) FILTER (WHERE found) AS BIGINT) AS matched_weight,
        round(CAST(sum(hh_eligible) FILTER (WHERE found) AS DOUBLE) / CAST(sum(hh_eligible) AS DOUBLE), 8) AS rate
    FROM q"""

TWINS["crosswalk_redistribute"] = _with(
    _CROSS_ROLES, r=_BY_AREA, a=_AREA_TOTALS, m=_MOVED, n=_UNMATCHED,
    rest="SELECT state_id, " + ", ".join(f"sum({c}) AS {c}" for c in Q.AREA_MEASURES) + " FROM n GROUP BY state_id",
    base="SELECT state_id, sum(hh_eligible) AS b FROM m GROUP BY state_id",
) + "SELECT m.state_id, m.district, " + ", ".join(
    f"round(m.{c} + CASE WHEN b > 0 THEN coalesce(rest.{c}, 0) * m.hh_eligible / b ELSE 0 END, 4) AS {c}"
    for c in Q.AREA_MEASURES
) + """ FROM m JOIN base ON m.state_id = base.state_id LEFT JOIN rest ON m.state_id = rest.state_id
    UNION ALL SELECT rest.state_id, 'unallocated', """ + ", ".join(
    f"round(CAST(rest.{c} AS DOUBLE), 4)" for c in Q.AREA_MEASURES
) + " FROM rest LEFT JOIN base ON rest.state_id = base.state_id WHERE coalesce(b, 0) <= 0"

_TRACT_ROLES = [*_AHP, "area_tract", "locations"]


def _tracts(where: str) -> dict[str, str]:
    return {
        "r": _rolled({"e": _ELIGIBLE}, ["area10"], households="area_households"),
        "m": f"""SELECT tract_id, sum(w * allocation_factor) AS households
            FROM r JOIN area_tract x ON r.area10 = x.puma22_id WHERE {where} GROUP BY tract_id""",
        "k": """SELECT substr(block_fips, 1, 11) AS tract_id,
            CAST(sum(served_by_copper_100_20 + served_by_coaxcable_100_20 + served_by_fiber_100_20) AS DOUBLE)
                / count(location_id) AS providers_per_location
            FROM locations GROUP BY 1""",
    }


_TRACT_TABLE = """SELECT m.tract_id, round(households, 4) AS households,
    round(providers_per_location, 8) AS providers_per_location FROM m JOIN k ON m.tract_id = k.tract_id"""
TWINS["entity_mean_transfer"] = _with(_TRACT_ROLES, **_tracts("TRUE")) + _TRACT_TABLE
TWINS["entity_mean_eligible"] = _with(_TRACT_ROLES, **_tracts("e")) + _TRACT_TABLE
TWINS["weighted_mean_providers"] = _with(_TRACT_ROLES, **_tracts("e")) + """
    SELECT round(sum(households * providers_per_location) / sum(households), 8) AS weighted_mean
    FROM m JOIN k ON m.tract_id = k.tract_id"""

# --- distributions ---------------------------------------------------------------------------------

_LEVELS = _rolled(
    {"e": _ELIGIBLE, "u": _UNCONNECTED, "v": _SUBGROUPS["veteran"]},
    extra={"pov": "max(p.povpip)"}, where="h.wgtp > 0",
)

TWINS["threshold_share"] = _with(_HP, r=_LEVELS, d="SELECT * FROM r WHERE e AND u", s="""
    SELECT CAST(coalesce(sum(w), 0) AS BIGINT) AS all_total,
        CAST(coalesce(sum(w) FILTER (WHERE pov >= 135 AND pov <= 200), 0) AS BIGINT) AS all_inside,
        CAST(coalesce(sum(w) FILTER (WHERE v), 0) AS BIGINT) AS veteran_total,
        CAST(coalesce(sum(w) FILTER (WHERE v AND pov >= 135 AND pov <= 200), 0) AS BIGINT) AS veteran_inside
    FROM d""") + """SELECT *, round_even(all_inside / CAST(all_total AS DOUBLE), 2) AS all_share,
        round_even(veteran_inside / CAST(veteran_total AS DOUBLE), 3) AS veteran_share FROM s"""

_twin("threshold_share_by_state", ["area_households"], """
    SELECT state_id, CAST(sum(wgtp) AS BIGINT) AS total,
        CAST(coalesce(sum(wgtp) FILTER (WHERE hincp >= 10000 AND hincp < 50000), 0) AS BIGINT) AS inside,
        round_even(coalesce(sum(wgtp) FILTER (WHERE hincp >= 10000 AND hincp < 50000), 0) / CAST(sum(wgtp) AS DOUBLE), 3) AS share
    FROM area_households WHERE wgtp > 0 GROUP BY state_id""")

TWINS["hist_fixed"] = _with(
    _HP, r=_LEVELS, d="SELECT * FROM r WHERE e AND u AND pov IS NOT NULL",
    v="""SELECT 'all' AS population, pov, w FROM d UNION ALL SELECT 'veteran', pov, w FROM d WHERE v""",
    b="SELECT i AS bin, population FROM range(40) t(i), (SELECT DISTINCT population FROM v) q",
) + """SELECT b.population, CAST(b.bin AS BIGINT) AS bin, round(CAST(b.bin * 5 AS DOUBLE), 6) AS bin_left,
        round(CAST(b.bin * 5 + 5 AS DOUBLE), 6) AS bin_right, CAST(coalesce(sum(v.w), 0) AS BIGINT) AS weight,
        CAST(CASE WHEN b.bin * 5 <= 135 THEN 0 ELSE 1 END AS BIGINT) AS above_threshold
    FROM b LEFT JOIN v ON v.population = b.population AND v.pov >= b.bin * 5
        AND (v.pov < b.bin * 5 + 5 OR (b.bin = 39 AND v.pov = 200))
    GROUP BY b.population, b.bin"""

_POPULATIONS = {
    "r": _rolled(
        {"u": _WITHOUT, "s": "h.fs = '1'"},
        extra={"lo": "min(p.povpip)", "lom": "min(p.povpip) FILTER (WHERE p.hins4 = '1')"},
    ),
    "v": """SELECT 'unconnected' AS population, CAST(lo AS DOUBLE) AS x, w FROM r WHERE u
        UNION ALL SELECT 'all', lo, w FROM r WHERE lo IS NOT NULL AND w > 0
        UNION ALL SELECT 'food_support', lo, w FROM r WHERE lo IS NOT NULL AND w > 0 AND s
        UNION ALL SELECT 'medical', lom, w FROM r WHERE lom IS NOT NULL AND w > 0""",
}


def _auto_bins(bins: int) -> dict[str, str]:
    """Bin edges as min + i * width per population, and the weight between two edges."""
    return {
        "g": f"""SELECT population, min(x) AS mn, (max(x) - min(x)) / {bins} AS step,
            CAST(coalesce(sum(w), 0) AS BIGINT) AS total FROM v GROUP BY population""",
        "e": f"SELECT g.*, i AS bin, mn + i * step AS el, mn + (i + 1) * step AS er, mn + i * step + step AS er_shown FROM g, range({bins}) t(i)",
        "hist": f"""SELECT e.population, CAST(e.bin AS BIGINT) AS bin, round(el, 6) AS bin_left, round(er_shown, 6) AS bin_right,
            CAST(coalesce(sum(v.w), 0) AS BIGINT) AS weight, e.total
            FROM e LEFT JOIN v ON v.population = e.population
                AND (v.x >= e.el OR e.bin = 0) AND (v.x < e.er OR e.bin = {bins - 1})
            GROUP BY e.population, e.bin, el, er_shown, e.total""",
        "cum": """SELECT *, CAST(sum(weight) OVER (PARTITION BY population ORDER BY bin) AS BIGINT) AS cumulative,
            round(sum(weight) OVER (PARTITION BY population ORDER BY bin) / CAST(total AS DOUBLE), 8) AS cumulative_share
            FROM hist""",
    }


TWINS["hist_auto"] = _with(_HP, **_POPULATIONS, **_auto_bins(50)) + "SELECT * FROM hist"
TWINS["hist_cumulative"] = _with(_HP, **_POPULATIONS, **_auto_bins(50)) + "SELECT * FROM cum"
TWINS["hist_cumulative_unconnected"] = _with(_HP, **_POPULATIONS, **_auto_bins(100)) + (
    "SELECT bin, bin_left, bin_right, weight, total, cumulative, cumulative_share FROM cum WHERE population = 'unconnected'"
)
TWINS["level_share_unconnected"] = _with(_HP, **_POPULATIONS) + """
    SELECT population, CAST(sum(w) AS BIGINT) AS total, CAST(coalesce(sum(w) FILTER (WHERE x <= 135), 0) AS BIGINT) AS inside,
        round_even(coalesce(sum(w) FILTER (WHERE x <= 135), 0) / CAST(sum(w) AS DOUBLE), 4) AS share
    FROM v GROUP BY population"""

# --- panels ----------------------------------------------------------------------------------------

_twin("panel_totals", ["subscriber_records"], f"""
    SELECT support_year, support_month, month_text, {_whole('subscribers', 'subscribers')}, {_whole('disbursed', 'disbursed')},
        CAST(strptime(month_text, '%m/%Y') AS DATE) AS month_start
    FROM subscriber_records WHERE support_year >= 1997 GROUP BY support_year, support_month, month_text""")

_twin("panel_years", ["subscriber_records"], f"""
    SELECT support_year, {_whole('subscribers', 'subscribers')}, {_whole('disbursed', 'disbursed')}
    FROM subscriber_records GROUP BY support_year""")

_twin("period_summary", ["state_ledger"], """
    SELECT state_id, CAST(sum(available) AS BIGINT) AS sum, max(available) AS max, round(avg(available), 4) AS mean,
        round(median(available), 4) AS median
    FROM state_ledger GROUP BY state_id""")

_twin("panel_diff_share", ["state_ledger"], """
    SELECT state_id, year, available,
        CAST(coalesce(available - lag(available) OVER s, 0) AS BIGINT) AS difference,
        round(CAST(available AS DOUBLE) / sum(available) OVER (PARTITION BY state_id), 8) AS share,
        CAST(sum(available) OVER s AS BIGINT) AS running,
        first_value(available) OVER s AS first,
        round(available + CAST(available AS DOUBLE) / sum(available) OVER (PARTITION BY state_id)
            * first_value(available) OVER s, 2) AS spread
    FROM state_ledger WINDOW s AS (PARTITION BY state_id ORDER BY year)""")

_twin("panel_first_periods", ["state_ledger"], """
    SELECT state_id, year, committed, CASE WHEN year = 1996 THEN 0 ELSE available END AS available
    FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY year) AS n FROM state_ledger) q WHERE n <= 3""")

_twin("panel_mean_after_first", ["state_ledger"], """
    SELECT state_id, round(avg(available), 2) AS mean_available
    FROM state_ledger l WHERE year > (SELECT min(year) FROM state_ledger m WHERE m.state_id = l.state_id)
    GROUP BY state_id""")

# --- projections and budget ------------------------------------------------------------------------

_BLEND_VALUE = f"(CAST({Q.BENEFIT_MIX[0][1]} AS DOUBLE) * {Q.BENEFIT_MIX[0][0]} + CAST({Q.BENEFIT_MIX[1][1]} AS DOUBLE) * {Q.BENEFIT_MIX[1][0]})"
_SCENARIO_ROWS = ", ".join(
    f"('{s.name}', CAST({s.asymptote} AS DOUBLE), CAST({s.rate} AS DOUBLE), CAST({s.midpoint} AS DOUBLE), "
    f"CAST({s.asymptote if s.drawn_to is None else s.drawn_to} AS DOUBLE))"
    for s in Q.SCENARIOS
)
_UNIVERSE = {
    "r": _BY_STATE,
    "u": f"SELECT state_id, {_sum0('universe', 'e AND u')} FROM r GROUP BY state_id",
}
_GRID = {
    **_UNIVERSE,
    "g": f"""SELECT state_id, universe, scenario, benefit, months,
        asymptote / (1 + exp(-rate * (months - midpoint))) * (drawn / asymptote) AS adoption_rate, amount, loading
        FROM u, (VALUES {_SCENARIO_ROWS}) s(scenario, asymptote, rate, midpoint, drawn),
            (VALUES ('mixed', {_BLEND_VALUE}, 1.0), ('flat', CAST({Q.FLAT_BENEFIT} AS DOUBLE), 1.0),
                ('mixed_loaded', {_BLEND_VALUE}, CAST({Q.LOADING} AS DOUBLE))) b(benefit, amount, loading),
            range(1, 73) m(months)""",
    "p": """SELECT *, adoption_rate / 100 * universe AS enrolled_hh,
        adoption_rate / 100 * universe * amount * loading AS cost FROM g""",
}

TWINS["logistic_projection_yearly"] = _with(_AHP, **_GRID) + """
    SELECT state_id, scenario, benefit, CAST((months - 1) // 12 + 1 AS BIGINT) AS program_year, round(sum(cost), 2) AS cost,
        round(max(adoption_rate), 6) AS adoption_rate, round(max(enrolled_hh), 4) AS enrolled_hh
    FROM p GROUP BY state_id, scenario, benefit, (months - 1) // 12"""

TWINS["scenario_compare"] = _with(_AHP, **_GRID) + "SELECT state_id, months, " + ", ".join(
    f"round(max(CASE WHEN scenario = '{s}' THEN {c} END), {d}) AS {s}_{c}"
    for s in ("S1", "S3")
    for c, d in (("adoption_rate", 6), ("enrolled_hh", 4), ("cost", 3))
) + " FROM p WHERE benefit = 'mixed' AND scenario IN ('S1', 'S3') GROUP BY state_id, months"

TWINS["curve_match_observed"] = _with(_AHP, **_GRID, q=f"""
    SELECT state_id, months, universe,
        adoption_rate * ({Q.OBSERVED_RATE} / (SELECT max(adoption_rate) FROM p WHERE scenario = 'S1')) AS rate
    FROM p WHERE scenario = 'S1' AND benefit = 'mixed'""") + f"""
    SELECT state_id, months, round(rate, 6) AS adoption_rate, round(rate / 100 * universe, 4) AS enrolled_hh,
        round(rate / 100 * universe * {_BLEND_VALUE}, 3) AS cost FROM q"""

TWINS["ledger_headroom"] = _with([*_AHP, "state_ledger"], **_GRID, c=f"""
    SELECT state_id, (months - 1) // 12 + 1 + {Q.PROGRAM_START} AS year, sum(cost) AS cost
    FROM p WHERE scenario = 'S1' AND benefit = 'mixed' GROUP BY 1, 2""") + """
    SELECT l.state_id, CAST(l.year AS BIGINT) AS year, committed, available, round(cost, 2) AS cost,
        committed + available AS stacked, round(available - cost, 2) AS headroom
    FROM state_ledger l LEFT JOIN c ON l.state_id = c.state_id AND l.year = c.year"""

TWINS["ledger_scenarios"] = _with([*_AHP, "state_ledger"], **_GRID, c=f"""
    SELECT state_id, (months - 1) // 12 + 1 + {Q.PROGRAM_START} AS year,
        sum(cost) FILTER (WHERE scenario = 'S1') AS c1, sum(cost) FILTER (WHERE scenario = 'S3') AS c3
    FROM p WHERE benefit = 'mixed' GROUP BY 1, 2""") + """
    SELECT l.state_id, CAST(l.year AS BIGINT) AS year, committed, available, round(c1, 2) AS "S1_cost", round(c3, 2) AS "S3_cost"
    FROM state_ledger l LEFT JOIN c ON l.state_id = c.state_id AND l.year = c.year"""

_LOW = Q.SCENARIOS[2]
TWINS["universe_levels"] = _with(
    _AHP,
    r=_rolled({"e": _ELIGIBLE, "f": _qualifies(135), "u": _UNCONNECTED}, ["state_id"], households="area_households"),
    v=f"""SELECT state_id, 'at_200' AS level, {_sum0('universe', 'e AND u')} FROM r GROUP BY state_id
        UNION ALL SELECT state_id, 'at_135', {_sum0('universe', 'f AND u')} FROM r GROUP BY state_id""",
    g=f"""SELECT v.*, months, {_LOW.asymptote} / (1 + exp(-{_LOW.rate} * (months - {_LOW.midpoint})))
        * (CAST({_LOW.drawn_to} AS DOUBLE) / {_LOW.asymptote}) AS rate FROM v, range(1, 73) m(months)""",
) + f"""SELECT state_id, level, universe, CAST((months - 1) // 12 + 1 AS BIGINT) AS program_year,
    round(sum(rate / 100 * universe * {_BLEND_VALUE}), 2) AS cost, round(max(rate), 6) AS adoption_rate,
    round(max(rate / 100 * universe), 4) AS enrolled_hh
    FROM g GROUP BY state_id, level, universe, (months - 1) // 12"""

_S1 = Q.SCENARIOS[0]
TWINS["budget_matched_projection"] = _with(
    [*_AHP, "state_ledger"], **_UNIVERSE,
    b=f"""SELECT u.state_id, universe, max(available) / ({_BLEND_VALUE} * {Q.LOADING} * 12) / nullif(universe, 0) * 100 AS peak
        FROM state_ledger l JOIN u ON l.state_id = u.state_id GROUP BY u.state_id, universe""",
    g=f"""SELECT b.*, months, {_S1.asymptote} / (1 + exp(-{_S1.rate} * (months - {_S1.midpoint}))) * (peak / {_S1.asymptote}) AS rate
        FROM b, range(1, 73) m(months)""",
) + f"""SELECT state_id, round(peak, 4) AS peak, CAST((months - 1) // 12 + 1 AS BIGINT) AS program_year,
    round(sum(rate / 100 * universe * {_BLEND_VALUE} * {Q.LOADING}), 2) AS cost, round(max(rate), 4) AS adoption_rate,
    round(max(rate / 100 * universe), 3) AS enrolled_hh
    FROM g GROUP BY state_id, peak, (months - 1) // 12"""

_CAPACITY = {
    **_UNIVERSE,
    "c": f"""SELECT l.*, universe, available / ({Q.LOADING} * 12 * {_BLEND_VALUE}) AS households
        FROM state_ledger l JOIN u ON l.state_id = u.state_id""",
}
_LEDGER_ROLES = [*_AHP, "state_ledger"]

TWINS["budget_capacity"] = _with(_LEDGER_ROLES, **_CAPACITY) + f"""
    SELECT state_id, year, committed, available, universe, round(households, 3) AS households,
        round(households / nullif(universe, 0), 6) AS adoption_rate,
        round(households / nullif(universe, 0) * 100, 4) AS peak_rate,
        round(households * 12 * {Q.FLAT_BENEFIT}, 1) AS market_opp FROM c"""

_FEE = " * ".join(str(share) for share in (*Q.PORTAL_SHARES, Q.FEE))
TWINS["fund_income"] = _with(_LEDGER_ROLES, **_CAPACITY, d="""
    SELECT state_id, year, coalesce(households - lag(households) OVER (PARTITION BY state_id ORDER BY year), 0) AS inc FROM c""") + f"""
    SELECT state_id, year, round(inc, 3) AS increase_hh, round(inc * {_FEE}, 1) AS fund_income FROM d"""

TWINS["fund_income_spread"] = _with(_LEDGER_ROLES, **_CAPACITY,
    n="SELECT state_id, year, sum(households) OVER (PARTITION BY state_id ORDER BY year) AS enrolled FROM c",
    d="""SELECT state_id, year, enrolled - coalesce(lag(enrolled) OVER s, enrolled) AS inc,
        first_value(enrolled) OVER s AS one FROM n WINDOW s AS (PARTITION BY state_id ORDER BY year)""",
    f="SELECT state_id, year, inc + inc / nullif(sum(inc) OVER (PARTITION BY state_id), 0) * one AS more FROM d",
) + f"SELECT state_id, year, round(more, 3) AS new_households, round(more * {_FEE}, 1) AS fund_income FROM f"


def _label(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', round_even(CAST({value} AS DOUBLE), {digits}))"


_twin("money_labels", ["state_ledger"], f"""
    , b AS (SELECT 'all' AS state_id, year, CAST(sum(available) AS BIGINT) AS available, CAST(sum(committed) AS BIGINT) AS committed
        FROM state_ledger GROUP BY year UNION ALL SELECT state_id, year, available, committed FROM state_ledger)
    SELECT state_id, year,
        CASE WHEN available >= 1e9 THEN '$' || {_label('available / 1e9', 1)} || 'B'
            ELSE '$' || {_label('available / 1e6', 0)} || 'M' END AS money,
        CASE WHEN committed >= 1e6 THEN '$' || {_label('committed / 1e6', 0)} || 'M'
            ELSE '$' || {_label('committed', 0)} END AS money_small,
        '$' || {_label('committed / 1e9', 1)} || 'B' AS billions,
        CASE WHEN available >= 1e6 THEN {_label('available / 1e6', 1)} || 'M'
            ELSE {_label('available / 1e3', 0)} || 'K' END AS count,
        {_label('available / CAST(available + committed AS DOUBLE) * 100', 1)} || '%' AS percent,
        format('{{:,}}', committed) AS thousands
    FROM b""")

# --- fits ------------------------------------------------------------------------------------------

_ADOPTION = {
    "a": """SELECT state_id, months, CAST(sum(enrolled) OVER (PARTITION BY state_id ORDER BY months) AS DOUBLE)
        / sum(enrolled) OVER (PARTITION BY state_id) * 100 AS rate FROM state_enrolment""",
}
TWINS["adoption_curve"] = _with(["state_enrolment"], **_ADOPTION) + "SELECT state_id, months, round(rate, 6) AS rate FROM a"

TWINS["fit_logit_linear"] = _with(["state_enrolment"], **_ADOPTION, z="""
    SELECT state_id, months, ln(greatest(least(rate / 110, 0.9999), 0.0001) / (1 - greatest(least(rate / 110, 0.9999), 0.0001))) AS z,
        CASE WHEN rate / 110 < 0.0001 OR rate / 110 > 0.9999 THEN 1 ELSE 0 END AS moved
    FROM a""", s="""
    SELECT state_id, regr_slope(z, months) AS k, regr_intercept(z, months) AS i, count(*) AS points,
        CAST(sum(moved) AS BIGINT) AS clamped FROM z GROUP BY state_id""") + """
    SELECT state_id, round(k, 6) AS k, round(-i / k, 4) AS x0, points, clamped FROM s"""

def _newton_chain(free: bool, steps: int) -> dict[str, str]:
    """Undamped Gauss-Newton in a recursive table: curve a / (1 + exp(-(b t + c))) with t = (months - 40) / 40."""
    residual = "(rate - a * s)"
    gradient = {"b": "a * s * (1 - s) * t", "c": "a * s * (1 - s)"} | ({"a": "s"} if free else {})
    names = list(gradient)
    sums = [f"sum({gradient[m]} * {gradient[n]}) AS {m}{n}" for i, m in enumerate(names) for n in names[i:]]
    sums += [f"sum({gradient[m]} * {residual}) AS r{m}" for m in names]

    def det(rows: list[list[str]]) -> str:
        if len(rows) == 2:
            return f"({rows[0][0]} * {rows[1][1]} - {rows[0][1]} * {rows[1][0]})"
        inner = [det([[r[j] for j in range(3) if j != k] for r in rows[1:]]) for k in range(3)]
        return f"({rows[0][0]} * {inner[0]} - {rows[0][1]} * {inner[1]} + {rows[0][2]} * {inner[2]})"

    def cell(m: str, n: str) -> str:
        return f"{m}{n}" if names.index(m) <= names.index(n) else f"{n}{m}"

    normal = [[cell(m, n) for n in names] for m in names]
    moved = {}
    for k, m in enumerate(names):
        swapped = [[f"r{names[i]}" if j == k else normal[i][j] for j in range(len(names))] for i in range(len(names))]
        moved[m] = f"{m} + {det(swapped)} / {det(normal)}"
    return {
        **_ADOPTION,
        "pts": "SELECT state_id, rate, (months - 40) / 40.0::DOUBLE AS t FROM a",
        "line": "SELECT state_id, regr_slope(ln(rate / (110 - rate)), t) AS b, regr_intercept(ln(rate / (110 - rate)), t) AS c FROM pts GROUP BY state_id",
        "chain": f"""SELECT 0 AS step, state_id, 110::DOUBLE AS a, b, c FROM line UNION ALL
            SELECT step + 1, state_id, {moved.get('a', 'a')}, {moved['b']}, {moved['c']} FROM (
                SELECT step, state_id, max(a) AS a, max(b) AS b, max(c) AS c, {', '.join(sums)}
                FROM (SELECT q.*, pts.t, pts.rate, 1 / (1 + exp(-(b * pts.t + c))) AS s
                      FROM chain q JOIN pts ON q.state_id = pts.state_id WHERE step < {steps}) z
                GROUP BY step, state_id) y""",
        "fits": f"""SELECT q.state_id, a AS l, b / 40 AS k, 40 - c * 40 / b AS x0,
            sum(pow(rate - a / (1 + exp(-(b * t + c))), 2)) AS sse, count(*) AS points
            FROM chain q JOIN pts ON q.state_id = pts.state_id WHERE step = {steps} GROUP BY q.state_id, a, b, c""",
    }


def _recursive(roles: Sequence[str], tables: Mapping[str, str]) -> str:
    return _with(roles, **tables).replace("WITH ", "WITH RECURSIVE ", 1)


TWINS["fit_logistic_fixed"] = _recursive(["state_enrolment"], _newton_chain(False, 25)) + """
    SELECT state_id, round(l, 4) AS "L", round(k, 6) AS k, round(x0, 4) AS x0, round(sse, 3) AS sse, points, TRUE AS converged FROM fits"""

TWINS["fit_logistic_free"] = _recursive(["state_enrolment"], _newton_chain(True, 60)) + """
    SELECT state_id, round(l, 3) AS "L", round(k, 6) AS k, round(x0, 3) AS x0, round(sse, 3) AS sse, points, TRUE AS converged FROM fits"""

TWINS["fitted_projection"] = _recursive([*_AHP, "state_enrolment"], {
    **_newton_chain(False, 25), **_UNIVERSE,
    "m": """SELECT f.state_id, m.months, universe, l / (1 + exp(-k * (m.months - x0))) * (44.0 / 110.0) AS rate
        FROM fits f JOIN u ON f.state_id = u.state_id, range(1, 73) m(months)""",
}) + f"""SELECT state_id, months, round(rate, 4) AS adoption_rate, round(rate / 100 * universe, 2) AS enrolled_hh,
    round(rate / 100 * universe * {_BLEND_VALUE}, 0) AS cost FROM m"""

_S = {f"s{i}": f"sum(pow(t, {i}))" for i in range(5)} | {f"m{i}": f"sum(available * pow(t, {i}))" for i in range(3)}
_DET = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
TWINS["fit_quadratic"] = _with(
    ["state_ledger"],
    l="SELECT *, CAST(year - 1998 AS DOUBLE) AS t FROM state_ledger",
    q="SELECT state_id, " + ", ".join(f"{text} AS {name}" for name, text in _S.items()) + " FROM l GROUP BY state_id",
    c=f"""SELECT state_id,
        (m0 * (s2 * s4 - s3 * s3) - s1 * (m1 * s4 - m2 * s3) + s2 * (m1 * s3 - m2 * s2)) / {_DET} AS c0,
        (s0 * (m1 * s4 - m2 * s3) - m0 * (s1 * s4 - s2 * s3) + s2 * (s1 * m2 - s2 * m1)) / {_DET} AS c1,
        (s0 * (s2 * m2 - s3 * m1) - s1 * (s1 * m2 - s2 * m1) + m0 * (s1 * s3 - s2 * s2)) / {_DET} AS c2 FROM q""",
    f="SELECT l.state_id, year, available, c0 + c1 * t + c2 * t * t AS smoothed FROM l JOIN c ON l.state_id = c.state_id",
) + """SELECT state_id, year, available, round(smoothed, 1) AS smoothed,
    round(coalesce(smoothed - lag(smoothed) OVER (PARTITION BY state_id ORDER BY year), 0), 1) AS smoothed_increase FROM f"""

_twin("logistic_values", ["state_enrolment"], """
    SELECT state_id, months, round(44.0 / (1 + exp(-0.126 * (months - 26.0))), 6) AS curve FROM state_enrolment""")
