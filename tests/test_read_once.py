"""Frames that are read more than once are written once in the plans for large inputs."""

import pytest
from pyspark.sql import functions as F

from pitpanel import plans
from pitpanel.functions import ordered
from pitpanel.operators import contest as C
from pitpanel.plans.base import bets
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bets_have_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    assert plan(bets(spark, SF)).count("Exchange ") == 1
    assert plan(bets(spark, SF).select("entry_id", "ev")).count("Exchange ") == 0


def test_normalise_hot_groups(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(50)] + [(2, 3.0), (2, 1.0), (None, 4.0), (3, 0.0), (4, None)], "g int, v double")
    got = [sorted(C.normalise(df, ["g"], F.col("v"), "s", hot).select("g", "v", F.round("s", 12).alias("s")).collect(), key=str) for hot in (10, None)]
    assert str(got[0]) == str(got[1])


@pytest.mark.parametrize("name", ["mt11_residual_distribution", "mt16_year_correlation", "mt17_correlations"])
def test_lineage_is_cut(spark, monkeypatch, name):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    assert "lineitem" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["bt11_ev_spearman", "dq21_prediction_diff", "mt11_residual_distribution", "mt16_year_correlation", "mt17_correlations"])
def test_large_plan(spark, con, monkeypatch, name):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    status, _, _, _, detail = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert status == "ok", detail


def test_plain_and_array_means_agree(spark, monkeypatch):
    from pitpanel.operators import history as H
    df = spark.sql("select r from values (array(named_struct('v', 1), named_struct('v', cast(null as int)), named_struct('v', 4))), (array(named_struct('v', cast(null as int)))), (cast(array() as array<struct<v:int>>)), (cast(null as array<struct<v:int>>)) as t(r)")
    plain = df.select(*[H.array_mean(F.col("r"), "v", n) for n in (1, 2, 3, 5)]).collect()
    monkeypatch.setattr(H, "PLAIN_SPAN", 0)
    assert [tuple(x) for x in plain] == [tuple(x) for x in df.select(*[H.array_mean(F.col("r"), "v", n) for n in (1, 2, 3, 5)]).collect()]
    assert [tuple(x) for x in plain][0] == (1.0, 1.0, 2.5, 2.5)


def test_means_come_back_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    assert "recent" not in plan(QUERIES["hs5_last_n_means"](spark, SF))
