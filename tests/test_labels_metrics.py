"""Label rules, metric values, complete contests, backtest and ledger invariants on small frames."""

import pytest
from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.operators import backtest as K
from pitpanel.operators import contest as C
from pitpanel.operators import labels as L
from pitpanel.operators import ledger as G
from pitpanel.operators import metrics as M
from pitpanel.operators import resample as B
from tests.plan_scan import plan_of


def test_place_rule_and_ids(spark):
    df = spark.createDataFrame([(4, 1), (5, 2), (7, 3), (8, 3)], "field_size int, rank int")
    lim = L.place_limit(F.col("field_size"))
    got = df.select(lim.alias("l"), ((F.col("field_size") >= 5) & (F.col("rank") <= lim)).cast("int").alias("t")).collect()
    assert [(r.l, r.t) for r in got] == [(0, 0), (2, 1), (2, 0), (3, 1)]
    ids = spark.createDataFrame([(None,), ("",), ("0",), ("000000",), ("2016000001",)], "x string")
    assert [r[0] for r in ids.select(X.is_valid_id(F.col("x"))).collect()] == [False, False, False, False, True]


def test_exclusion_reasons(spark):
    df = spark.createDataFrame([("c1", "a", 1, "0", "h", 1, 200, 120), ("c2", "b", 1, "0", "h", 1, None, 120), ("c3", "c", 1, "0", "0", 1, 200, 120)],
                               "contest_id string, entry_id string, entry_no int, status string, runner string, rank int, win_pay int, place_pay int")
    df = df.withColumns({"field_size": F.lit(8), "win_odds": F.lit(2.0)})
    r = {x.entry_id: (x.win_exclusion, x.place_exclusion) for x in L.add_targets(df).collect()}
    assert r == {"a": ("", ""), "b": ("no_win_payout", ""), "c": ("invalid_runner_id", "invalid_runner_id")}


def test_probability_metrics_known_values(spark):
    df = spark.createDataFrame([(0, 0.25), (1, 0.75)], "y int, p double")
    assert M.probability_metrics(df, [], "y", "p").first().brier == pytest.approx(0.0625)
    assert M.roc_auc(df.withColumn("g", F.lit(1)), ["g"], "y", "p").first().auc == 1.0
    assert M.average_precision(df.withColumn("g", F.lit(1)), ["g"], "y", "p").first().average_precision == 1.0


def test_null_probability_stays_null(spark):
    df = spark.createDataFrame([(None, 1)], "p double, y int")
    r = df.select(X.clip(F.col("p")).alias("a"), X.logit(F.col("p")).alias("b"), M.log_loss(F.col("y"), F.col("p"), 1e-6).alias("c")).first()
    assert (r.a, r.b, r.c) == (None, None, None)


def test_complete_contests(spark):
    df = spark.createDataFrame([("a", "a1", 1, 2.0, .6, .5), ("a", "a2", 0, 4.0, .4, .5), ("b", "b1", 1, None, .6, .5), ("b", "b2", 0, 2.0, .4, .5), ("c", "c1", 0, 2.0, .6, .5),
                                ("c", "c2", 0, 2.0, .4, .5), ("d", "d1", 1, 2.0, .6, None), ("d", "d2", 0, 3.0, .4, .5)], "c string, e string, y int, odds double, m1 double, m2 double")
    reasons = C.contest_reasons(df, "c", "e", "y", "odds", ["m1", "m2"])
    assert {r.c: r.reason for r in reasons.collect()} == {"a": "", "b": "missing_odds_runner", "c": "missing_winner", "d": "missing_model_prediction"}
    kept = C.normalise(C.complete_contests(df, reasons, "c"), ["c"], 1 / F.col("odds"), "pm")
    assert kept.agg(F.sum("pm")).first()[0] == pytest.approx(1.0)


def test_agreement(spark):
    df = spark.createDataFrame([("m1", "r", "a", .7), ("m1", "r", "b", .3), ("m2", "r", "a", .6), ("m2", "r", "b", .4), ("m3", "r", "a", .2), ("m3", "r", "b", .8)], "m string, c string, e string, p double")
    top = C.one_per_group(df, ["c", "m"], [-F.col("p"), F.col("e")])
    assert {r.m: r.agreement for r in C.agreement(top, ["c"], "m", "e").collect()} == {"m1": 2, "m2": 2, "m3": 1}


def test_bet_totals_and_stress(spark):
    df = spark.createDataFrame([("c1", "a", 250, 2.0), ("c2", "b", 0, 99.0)], "c string, e string, pay int, odds double")
    r = K.bet_summary(df, [], "c", "pay", "odds").first()
    assert (r.stake, r["return"], r.roi, r.hits) == (200, 250, 125.0, 1)
    s = K.stress(df, [], "e", "pay").collect()
    assert all(x.payout_zeroed_roi <= x.normal_roi for x in s) and s[0].row_removed_roi == 0.0


def test_roi_is_total_over_total(spark):
    df = spark.createDataFrame([(2020, "a", 300), (2021, "b", 0), (2021, "c", 0), (2021, "d", 100)], "y int, e string, pay int")
    r = K.year_stability(df, [], "y", "pay").first()
    assert r.roi == 100.0 and r.year_roi_mean == pytest.approx((300 + 100 / 3) / 2)


def test_contests_without_bets_stay_in_bootstrap(spark):
    pop = spark.createDataFrame([(f"c{i}",) for i in range(4)], "c string")
    none = spark.createDataFrame([], "c string, pay int")
    r = B.roi_bootstrap(B.contest_bets(none, "c", "pay", population=pop), "c", 10, 1).first()
    assert r.contests == 4 and r.point_roi is None and r.replicates == 0


def test_bootstrap_methods_agree(spark):
    df = spark.range(400).select(F.col("id").alias("c"), (F.col("id") % 5 * 60).alias("pay"))
    c = B.contest_bets(df, "c", "pay")
    a, b = (B.roi_bootstrap(c, "c", 200, 1, m).first() for m in ("multinomial", "poisson"))
    assert abs(a.mean_roi - 120) < 3 and abs(b.mean_roi - 120) < 3
    assert abs((a.roi_p975 - a.roi_p025) - (b.roi_p975 - b.roi_p025)) < 4
    sliced = B.replicate_sums(c, "c", ["return"], 3, 9, slices=5).orderBy("replicate").collect()
    assert sliced == B.replicate_sums(c, "c", ["return"], 3, 9).orderBy("replicate").collect()


def test_permutation_keeps_values(spark):
    df = spark.range(300).select(F.col("id").alias("u"), (F.col("id") * 2).alias("x"), F.col("id").alias("y"))
    p = B.permute(df, "u", ["x"], 5, slices=4)
    assert sorted(r.x for r in p.collect()) == [2 * i for i in range(300)]
    assert p.filter("x = 2 * y").count() < 30 and p.count() == 300


def test_tiers_nested_and_settlement(spark):
    df = spark.createDataFrame([("a", 1.21), ("b", 1.14), ("c", 1.22), ("d", 0.96)], "entry_id string, ev double")
    t = G.tier_rows(df, ["entry_id"], "ev")
    assert G.nesting_violations(t, ["entry_id"]).first().violations == 0
    assert {r.tier: r.n for r in t.filter("selected").groupBy("tier").agg(F.count("*").alias("n")).collect()} == {"CORE": 3, "MARGIN": 3, "HIGH": 3, "VERY_HIGH": 2}
    s = spark.createDataFrame([("a", 220.0, 1), ("a", 230.0, 2)], "entry_id string, pay double, version int")
    out = G.settle(t, G.latest_settlements(s, ["entry_id"], "version"), ["entry_id"], "pay")
    assert {(r.entry_id, r.status, r.payout) for r in out.filter("tier = 'CORE'").collect()} == {("a", "settled", 230.0), ("b", "pending", None), ("c", "pending", None)}


def test_empty_group_spearman_is_null(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 3.0)], "g string, a double, b double")
    assert M.correlations(df, ["g"], "a", "b").first().spearman is None


def test_importance_numbers_and_joins_rows_once(spark):
    df = spark.createDataFrame([(f"u{i:02d}", i % 2, 0.1 + i / 50, 1.0 + i % 7) for i in range(40)], "u string, y int, p double, o double")
    groups = {"p": ["p"], "o": ["o"], "both": ["p", "o"]}
    out = B.permutation_importance(df, "u", "y", groups, lambda d: F.col("p") / F.col("o"), 5)
    assert plan_of(out).count("SortMergeJoin") == 1 and len(out.collect()) == 3
    for r in out.collect():
        moved, eps = B.permute(df, "u", groups[r.feature_group], 5), 1e-6
        b = [x.agg(F.avg(F.pow(F.col("p") / F.col("o") - F.col("y"), 2))).first()[0] for x in (moved, df)]
        assert abs(r.delta_brier - (b[0] - b[1])) < 1e-12


def test_draws_are_not_shuffled_and_blocks_of_clusters_add_up(spark):
    c = spark.range(300).select(F.col("id").alias("c"), (F.col("id") % 7 * 10).cast("double").alias("return"))
    whole = B.replicate_sums(c, "c", ["return"], 12, 9).orderBy("replicate").collect()
    parts = B.replicate_sums(c, "c", ["return"], 12, 9, block_rows=70)
    assert plan_of(parts).count("BroadcastHashJoin") == 5 and "ShuffledHashJoin" not in plan_of(parts)
    assert parts.orderBy("replicate").collect() == whole


def test_poisson_hashes_a_cluster_once(spark):
    c = spark.range(90).select((F.col("id") / 3).cast("int").alias("c"), (F.col("id") % 3).alias("bin"), F.col("id").cast("double").alias("n"))
    split = B.replicate_sums(c, "c", ["n"], 8, 9, "poisson", ["bin"])
    plan = plan_of(split)
    assert "Generate inline(_rows" in plan and plan.index("Generate inline(_rows") < plan.index("md5(")
    one = {(r.replicate, k): r.n for k in range(3) for r in B.replicate_sums(c.filter(F.col("bin") == k), "c", ["n"], 8, 9, "poisson").collect()}
    assert {(r.replicate, r.bin): r.n for r in split.collect()} == one


def test_bands_do_not_depend_on_the_order_of_a_float_sum(spark):
    near = [0.3, 0.1 + 0.2, 0.2, 0.7 - 0.5]
    df = spark.createDataFrame([("a", p, 1) for p in near], "g string, p double, y int")
    assert {(r.band, r.rows) for r in M.reliability_cut(df, ["g"], "y", "p", [0.0, 0.1, 0.2, 0.3, 0.4]).collect()} == {("(0.2,0.3]", 2), ("(0.1,0.2]", 2)}


def test_market_crossing_is_the_same_rule_on_both_sides():
    from pitpanel import plans
    for name in ("bt12_ev_crossing", "bt12_odd_numbers"):
        assert "round(p_market*odds*1.4,9)>=1" in plans.oracle_sql()[name]
