"""The plans meant for large inputs (slices, salted joins), forced on the smallest tables, equal the SQL."""

import pytest

from pitpanel import plans
from pitpanel.functions import ordered
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()
FORCED = ["hs5_last_n_means", "hs6_last_diffs", "hs8_leakage_audit", "hs8_leakage_injected", "jn10_asof_source", "hs3_prior_totals", "wn9_cumulative_roi", "wn12_rank_bins", "mt2_roc_auc",
          "mt3_average_precision", "mt11_distribution", "mt15_psi_open", "bt2_max_drawdown", "bt3_losing_streak", "bt7_concentration_all", "bs1_roi_bootstrap",
          "dq19_frequent_values", "dq24_market_logit", "rg2_full_grid"]
FORCED += [n for n in QUERIES if n.startswith("wn12_") and n not in FORCED]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", FORCED)
def test_forced(spark, con, monkeypatch, name):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    status, _, _, _, detail = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert status == "ok", detail
