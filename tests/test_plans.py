"""Plan shapes that the operators promise, read with broadcasting switched off as for large tables."""

import re

import pytest

from hearthstat.operators import members, totals
from hearthstat.plans.binding import role
from hearthstat.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
EAGER = {"fit_logistic_fixed", "fit_logistic_free", "fitted_projection"}


@pytest.fixture
def large(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_no_python_no_sort_aggregate(large, name):
    text = plan(QUERIES[name](large, SF_DIR))
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas", "SortAggregate"):
        assert operator not in text


def test_national_rollup_is_one_shuffle_without_join(large):
    text = plan(QUERIES["eligibility_totals"](large, SF_DIR))
    assert "Join" not in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    lineitem = re.search(r"FileScan parquet \[([^]]*)\][^\n]*lineitem", text).group(1)
    assert "l_comment" not in lineitem and len(lineitem.split(",")) == 6


def test_carried_rollup_shuffles_each_side_once(large):
    text = plan(members.rollup_members(
        role(large, SF_DIR, "households"), role(large, SF_DIR, "persons"), ["serialno"], "wgtp",
        {"offline": members.household_flag(totals.F.col("accessinet") == "3"), "vet": members.member_flag(totals.F.col("vps") == "01")},
        carry=["fs"], unique_key=True,
    ))
    assert text.count("SortMergeJoin") == 1 and len(re.findall(r"Exchange hashpartitioning", text)) == 2


def test_filters_reach_the_scan(large):
    text = plan(QUERIES["panel_totals"](large, SF_DIR))
    assert "support_year" not in re.search(r"FileScan parquet \[([^]]*)\]", text).group(1)
    area = plan(role(large, SF_DIR, "area_households").where("wgtp > 0").select("state_id"))
    assert "PushedFilters" in area
    assert re.search(r"FileScan parquet \[o_orderkey[^]]*\]", area).group(0).count("#") == 3
