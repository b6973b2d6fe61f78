"""Large frames: every lead is shuffled by itself, the last record is a maximum, and both equal the SQL."""

import pytest

from pitpanel import plans
from pitpanel.functions import ordered
from pitpanel.operators import history as H
from tests.oracle import compare, connect
from tests.plan_scan import plan_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", ["hs3_prior_totals_wide", "hs8_leakage_samples"])
def test_large_plan_equals_sql(spark, monkeypatch, name):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    status, _, _, _, detail = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert status == "ok", detail


@pytest.mark.parametrize("name", ["jn10_asof_source", "hs6_last_diffs"])
def test_hot_leads_equal_sql(spark, monkeypatch, name):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    for f in (H.before_parts, H.asof_sources, H.before_day):
        place = f.__code__.co_varnames.index("hot_rows") - f.__code__.co_argcount
        monkeypatch.setattr(f, "__defaults__", tuple(20 if i == len(f.__defaults__) + place else v for i, v in enumerate(f.__defaults__)))
    status, _, _, _, detail = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert status == "ok", detail


def test_no_lead_shuffles_the_results_of_another(spark, monkeypatch):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    plan = plan_of(QUERIES["jn10_asof_source"](spark, SF))
    assert plan.count("Exchange hashpartitioning(_lead") == 3 and "Union" in plan
    last = plan_of(QUERIES["hs6_last_diffs"](spark, SF))
    assert last.count("Exchange") == 1 and "Join" not in last
