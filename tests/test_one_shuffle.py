"""Queries on ranked contests read and shuffle the entries once; hot contests go by slices with the same result."""

import pytest
from pyspark.sql import functions as F

from pitpanel import plans
from pitpanel.functions import ordered
from pitpanel.operators import contest as C
from pitpanel.plans.q_columns import ranked
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_ranked_has_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    plan = ranked(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("FileScan ") == 1


def test_hot_contests_by_slices(spark):
    nan = float("nan")
    rows = [(1, f"e{i:03d}", (i * 7 % 13) / 13.0, 1.0 + i % 5) for i in range(60)] + [(c, f"f{c}-{i}", (i * c % 5) / 5.0, 2.0 + i) for c in range(2, 9) for i in range(4)]
    rows += [(1, "n1", None, 2.0), (1, "n2", nan, 3.0), (2, "n3", None, None), (9, "one", 0.5, 2.0), (None, "x1", 0.25, 2.0), (None, "x2", 0.5, 4.0)]
    df = spark.createDataFrame(rows, "g int, e string, p double, o double")

    def view(hot_rows):
        d = C.contest_view(df, ["g"], "p", 1.0 / F.col("o"), "share", "e", {"odd": "o"}, hot_rows)
        return sorted(d.select("g", "e", "model_rank", "market_rank", "odd", *[F.round(c, 9).alias(c) for c in ("share", "margin", "entropy")]).collect(), key=str)

    hot = ordered.hot_groups(df, ["g"], 10)
    assert [r[0] for r in hot.collect()] == [1] and ordered.hot_groups(df, ["g"], 100) is None
    assert str(view(10)) == str(view(None))


@pytest.mark.parametrize("name", ["pr23_rule_mask", "rg2_rule_grid", "rg2_best_rules", "rg5_candidate_classes", "rg7_pruned_rules", "rg4_full_rules_applied"])
def test_large_plan(spark, con, monkeypatch, name):
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    status, _, _, _, detail = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert status == "ok", detail
