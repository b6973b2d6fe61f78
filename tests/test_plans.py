"""Plan properties: no Python operators, no cross joins, pushed filters, partial group limits."""

import pytest

from pitpanel import plans
from tests.plan_scan import FORBIDDEN, plan_of

SF = "/root/testdata/sf0.001"
NAMES = ["hs3_prior_totals_wide", "hs5_last_n_means", "hs8_leakage_audit", "wn5_confidence_top3", "mt7_top1_accuracy", "mt15_psi_open", "bt2_max_drawdown", "bt6_stress_pair",
         "rg1_threshold_grid", "rg2_rule_grid", "bs1_roi_bootstrap", "dq3_dimension_missingness", "jn2_left_integration", "fl5_reports",
         "hs8_leakage_samples", "jn12_joined_sample", "jn12_status_codes", "tb7_digest_tree", "tb7_changed_keys", "dq19_frequent_values", "dq24_market_logit"]


@pytest.mark.parametrize("name", NAMES)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(plans.queries()[name](spark, SF))
    assert not [w for w in FORBIDDEN if w in plan]


@pytest.mark.parametrize("name", ["hs5_last_n_means", "wn5_confidence_top3", "mt7_top1_accuracy", "bt6_stress_pair", "so3_top_k_per_group", "hs8_leakage_samples"])
def test_group_limit_runs_before_the_shuffle(spark, name):
    plan = plan_of(plans.queries()[name](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filter_and_columns_reach_the_scan(spark):
    df = plans.queries()["sc4_filtered_scan"](spark, SF)
    plan = plan_of(df)
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderpriority" in plan and "o_totalprice" not in plan


def test_year_filter_prunes_partitions(spark):
    plan = plan_of(plans.queries()["sc2_partitioned_years"](spark, SF))
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_nested_walk_forward_reads_its_yearly_grid_once(spark):
    plan = plan_of(plans.queries()["rg9_nested_walk_forward"](spark, SF))
    assert "lineitem.parquet" not in plan and "yearly" in plan


def test_threshold_grid_joins_nothing(spark):
    assert "Join" not in plan_of(plans.queries()["rg1_threshold_grid"](spark, SF))
