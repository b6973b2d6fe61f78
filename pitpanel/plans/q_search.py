"""Registered queries: rule search and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import join_stats, quantiles
from pitpanel.operators import backtest as K
from pitpanel.operators import contest as C
from pitpanel.operators import resample as B
from pitpanel.operators import search as S
from pitpanel.operators.metrics import join_groups
from pitpanel.plans.base import BETS, SCORED, bets, odd_bets, odd_sql, r6, rounded, scored
from pitpanel.plans.q_backtest import order, picks
from pitpanel.plans.q_columns import RANKED, ranked
from pitpanel.sources.workdir import materialise

THRESHOLDS = [round(0.8 + 0.05 * i, 2) for i in range(31)]
DRAWS = 1000
LOWS = [1.0, 1.2, 1.4, 1.5, 1.7, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 7.0]
HIGHS = [1.2, 1.4, 1.5, 1.7, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 7.0, 10.0, 20.0, 99.0]
EVS = [0.0, *[round(0.8 + 0.05 * i, 2) for i in range(10)]]  # the first is no limit


def dims():
    return [S.Dim("rank", "model_rank", "<=", (1, 2, 4)), S.Dim("ev", "ev", ">=", (0.9, 1.0, 1.2)), S.Dim("p", "p_model", ">=", (0.0, 0.25, 0.4)),
            S.Dim("margin", "margin", ">=", (0.0, 0.05)), S.Dim("odds", "odds", "band", ((1.0, 999.0), (1.5, 2.5), (2.5, 3.5), (3.5, 999.0)))]


FULL_DIMS = {"rank": (1, 2), "ev": (0.9, 1.0, 1.1, 1.2), "p": (0.0, 0.2, 0.3, 0.4), "margin": (0.0, 0.02, 0.05), "agree": (1, 2, 3), "calm": (0, 1),
             "odds": ((1.0, 999.0), (1.5, 2.5), (2.5, 3.5), (3.5, 999.0)), "gap": (-999.0, 0.0, 0.02)}
FULL_COLUMNS = {"rank": "model_rank", "p": "p_model", "agree": "agreement", "gap": "edge"}


def full_dims():
    """The whole grid of eight conditions: 6,912 rules."""
    ops = {"rank": "<=", "odds": "band"}
    return [S.Dim(n, FULL_COLUMNS.get(n, n), ops.get(n, ">="), v) for n, v in FULL_DIMS.items()]


def full_ranked(spark, sf):
    """Coded entries; they count how many of three scores put the entry first and whether the contest's entropy is below the training quantile 0.75.

    The rows are written once, before the quantile is known.
    """
    d = ranked(spark, sf, alt_rank="p_alt")
    votes = [F.when(F.col(c) == 1, 1).otherwise(0) for c in ("model_rank", "alt_rank", "market_rank")]
    d = d.withColumn("agreement", votes[0] + votes[1] + votes[2])
    d = S.coded_rows(d, [x for x in full_dims() if x.name != "calm"], [*stored_columns(), F.col("entropy")])
    level = quantiles(d.filter("split = 'train'"), ["status"], "entropy", [0.75]).withColumnRenamed("q0", "entropy_max")
    level = join_groups(d.groupBy("status").agg(F.count(F.lit(1)).alias("rows")), level, ["status"])
    level = materialise(level, "entropy-levels")  # its size is known then, so that few levels are broadcast
    return join_stats(d, level, ["status"], ["entropy_max"], "rows").withColumn("calm", (F.col("entropy") <= F.col("entropy_max")).cast("int")).drop("entropy_max")


def stored_columns():
    return [F.col(c) for c in ("status", "split", "event_date", "contest_id", "entry_id", "pay", "odds")]


def surface_dims():
    return [S.Dim("low", "odds", ">=", tuple(LOWS)), S.Dim("high", "odds", "<", tuple(HIGHS)), S.Dim("ev", "ev", ">=", tuple(EVS))]


def valued(spark, sf):
    """Scored entries with their expected value: all that the threshold grids read, so no contest sums are joined."""
    return scored(spark, sf).withColumn("ev", F.col("p_model") * F.col("odds"))


def rg1(spark, sf):
    return rounded(S.threshold_grid(valued(spark, sf), ["year"], "contest_id", F.col("ev"), THRESHOLDS, "pay"), "roi", "hit_rate")


def rg1_combined(spark, sf):
    return rounded(S.threshold_grid(valued(spark, sf), [], "contest_id", F.col("ev"), THRESHOLDS, "pay"), "roi", "hit_rate")


def rg2(spark, sf):
    g = S.rule_grid(ranked(spark, sf), ["split"], dims(), "pay", 100)
    return rounded(S.rule_values(g, dims()), "roi")


def rg1_odd(spark, sf):
    return rounded(S.threshold_grid(odd_bets(spark, sf), ["year"], "contest_id", F.col("ev"), THRESHOLDS, "pay"), "roi", "hit_rate")


def rg2_odd(spark, sf):
    """The rule grid with NaN and infinite EVs and margins: none of them meets a rule."""
    odd = F.when(F.col("entry_no") == 2, float("nan")).when(F.col("entry_no") == 3, float("inf")).when(F.col("entry_no") == 4, float("-inf")).when(F.col("entry_no") == 5, None)
    d = ranked(spark, sf).withColumns({"ev": odd.otherwise(F.col("ev")), "p_model": F.when(F.col("entry_no") == 6, float("nan")).otherwise(F.col("p_model"))})
    return rounded(S.rule_values(S.rule_grid(d, ["split"], dims(), "pay", 100), dims()), "roi")


def rg3_odd(spark, sf):
    g = S.rule_values(S.rule_grid(odd_bets(spark, sf), [], surface_dims(), "pay"), surface_dims()).filter("high > low")
    return rounded(g, "roi").select("low", "high", "ev", "bets", "return", "hits", "roi")


def rg6_odd(spark, sf):
    return rounded(S.select_alpha(odd_bets(spark, sf), "p_model", "p_market", "odds", "pay", [0.0, 0.25, 0.5, 0.75, 1.0], 1.0), "roi")


def rule_rows(spark, sf):
    return S.coded_rows(ranked(spark, sf), dims(), stored_columns())


def best(rows):
    return S.best_rules(rows.filter("split = 'train'"), ["status"], dims(), order(), "pay", 200, 3, stored=True)


def rg2_best(spark, sf):
    return rounded(best(rule_rows(spark, sf)), "roi", "score", digits=4).select("status", "rule_id", "bets", "return", "hits", "roi", "max_drawdown", "max_losing_streak", "score", "selected_order")


def rg2_full(spark, sf):
    """All rules of the whole grid with at least 100 bets on the training split."""
    d = full_ranked(spark, sf).filter("split = 'train'")
    return rounded(S.rule_grid(d, ["status"], full_dims(), "pay", 100), "roi").select("status", "rule_id", "bets", "return", "hits", "roi")


def full_best(rows):
    return S.best_rules(rows.filter("split = 'train'"), ["status"], full_dims(), order(), "pay", 200, 3, stored=True)


def rg2_full_best(spark, sf):
    return rounded(full_best(full_ranked(spark, sf)), "roi", "score", digits=4).select("status", "rule_id", "bets", "return", "hits", "roi", "max_drawdown", "max_losing_streak", "score", "selected_order")


def rg4_full(spark, sf):
    """The three best of 6,912 rules per status, applied unchanged to the later splits."""
    rows = full_ranked(spark, sf)
    return applied(rows, full_dims(), full_best(rows))


def applied(rows, dims, best):
    """Bets of the chosen rules on the later splits."""
    rules = materialise(best.select("status", "rule_id", *[f"{d.name}_i" for d in dims]), "chosen-rules")
    tagged = S.rule_bets(rows.filter("split <> 'train'"), dims, rules, ["status"])
    return rounded(K.bet_summary(tagged, ["status", "rule_id", "split"], "contest_id", "pay", "odds", median=False), "roi", "hit_rate", "mean_payout").withColumn("mean_odds", r6("mean_odds", 9))


def rg3(spark, sf):
    g = S.rule_values(S.rule_grid(bets(spark, sf), [], surface_dims(), "pay"), surface_dims()).filter("high > low")
    return rounded(g, "roi").select("low", "high", "ev", "bets", "return", "hits", "roi")


def rg4(spark, sf):
    """Rules selected on the training split, applied unchanged to later splits."""
    rows = rule_rows(spark, sf)
    return applied(rows, dims(), best(rows))


def classified(spark, sf):
    ev_min = X.config_band(F.col("odds"), [("0.9", None, 2.0), ("1.0", 2.0, 3.5), ("1.1", 3.5, None)]).cast("double")
    d = ranked(spark, sf).select("entry_id", "odds", "ev", "model_rank", "market_rank", "rank_gap", "margin", "edge", "pay", "label")
    return S.classify_candidates(d, ev_min, 3.0, 3.5)


def rg5(spark, sf):
    """The share counts all entries: one ranked row each."""
    d = classified(spark, sf)
    capped = S.cap_share(d, F.col("strategy_type") == "longshot", scored(spark, sf), 0.01, [-F.col("ev"), F.col("entry_id")])
    return capped.groupBy("strategy_type").agg(F.count(F.lit(1)).alias("bets"), F.sum("pay").alias("return"), F.sum("label").alias("hits"))


def rg6(spark, sf):
    return rounded(S.select_alpha(bets(spark, sf), "p_model", "p_market", "odds", "pay", [0.0, 0.25, 0.5, 0.75, 1.0], 1.0), "roi")


def big_rules(spark, sf):
    """All rules with at least 2,000 bets and their pairwise overlap, both from one cell table."""
    cells = materialise(S.cell_table(ranked(spark, sf), [], dims(), "pay"), "cells")
    rules = S.cell_grid(cells, [], dims(), 2000)
    return rules, S.cell_overlap(cells, dims(), rules)


def rg7(spark, sf):
    """Pairwise Jaccard of all rules with at least 2,000 bets."""
    return rounded(big_rules(spark, sf)[1], "jaccard")


def rg7_pruned(spark, sf):
    rules, overlap = big_rules(spark, sf)
    return S.greedy_prune(rules, overlap, [-F.col("bets"), F.col("rule_id")], 0.6).select("rule_id", "bets")


def yearly_grid(spark, sf):
    return S.threshold_grid(valued(spark, sf), ["year"], "contest_id", F.col("ev"), THRESHOLDS, "pay")


def rg8(spark, sf):
    y = yearly_grid(spark, sf).filter("year <= 1999")
    c = y.groupBy("threshold").agg(F.sum("bets").alias("bets"), F.sum("return").alias("return"), F.count(F.lit(1)).alias("years"), F.min("bets").alias("min_yearly_bets"),
                                   F.min("roi").alias("min_yearly_roi"), F.count_if(F.col("roi") >= 90).alias("years_ge_90"))
    c = c.withColumn("roi", 100.0 * F.col("return") / (F.col("bets") * 100))
    g = S.gate(c, {"bets": F.col("bets") >= 3000, "years": F.col("years") >= 4, "roi": F.col("roi") >= 90.0})
    best_t = S.choose(g.filter("eligible"), [], [F.col("min_yearly_roi").desc(), F.col("bets").desc(), F.col("threshold")]).select(F.col("threshold").alias("_t"))
    return rounded(g.join(F.broadcast(best_t), F.col("threshold") == F.col("_t"), "left").select(
        "threshold", "bets", "roi", "min_yearly_roi", "years_ge_90", F.coalesce("failed", F.lit("")).alias("failed"), "eligible", F.col("_t").isNotNull().alias("chosen")), "roi", "min_yearly_roi")


def rg8_near_tie(spark, sf):
    from pitpanel.plans.q_metrics import yearly
    y = rounded(yearly(spark, sf), "logloss", "brier")
    c = y.groupBy("model").agg(F.round(F.avg("logloss"), 6).alias("logloss"), F.round(F.max("logloss"), 6).alias("worst"), F.round(F.avg("brier"), 6).alias("brier"))
    return S.near_tie_choice(c, "logloss", 0.05, ["logloss", "worst", "brier"], "model").select("model", "logloss", "rank_sum")


def rg9(spark, sf):
    out = S.nested_walk_forward(yearly_grid(spark, sf), "year", [1998, 1999, 2000, 2001], (F.col("bets") >= 1000) & (F.col("min_yearly_roi") >= 80.0),
                                [F.col("min_yearly_roi").desc(), F.col("bets").desc(), F.col("threshold")], 1.0)
    return rounded(out, "validation_roi")


def bs1(method):
    def run(spark, sf):
        c = B.contest_bets(picks(spark, sf), "contest_id", "pay")
        return rounded(B.roi_bootstrap(c, "contest_id", DRAWS, 42, method), "point_roi", "mean_roi", "roi_p025", "roi_p500", "roi_p975", "p_roi_ge_90", "p_roi_ge_100")
    return run


def bs1_weighted(spark, sf):
    d = picks(spark, sf).withColumn("pay", F.col("pay") * F.col("entry_no"))
    c = B.contest_bets(d, "contest_id", "pay", stake=F.col("entry_no") * 100)
    return rounded(B.roi_bootstrap(c, "contest_id", DRAWS, 7), "point_roi", "mean_roi", "roi_p025", "roi_p500", "roi_p975", "p_roi_ge_90", "p_roi_ge_100")


def bs2(spark, sf):
    d = bets(spark, sf)
    c = B.contest_bets(d.filter("ev >= 1.3"), "contest_id", "pay", population=d)
    return rounded(B.roi_bootstrap(c, "contest_id", DRAWS, 42), "point_roi", "mean_roi", "roi_p025", "roi_p500", "roi_p975", "p_roi_ge_90", "p_roi_ge_100")


def bs3(spark, sf):
    d = B.paired_bootstrap(bets(spark, sf), "contest_id", "label", "p_model", "p_market", DRAWS, 42, method="poisson")
    return rounded(d, "point_delta", "mean_delta", "p025", "p975", "p_a_better")


def bs4(spark, sf):
    d = B.ece_bootstrap(bets(spark, sf), "contest_id", "label", "p_model", "p_market", DRAWS, 42, method="poisson")
    return rounded(d, "mean_delta", "p025", "p975", "p_a_better")


def bs5(spark, sf):
    d = scored(spark, sf).select("entry_id", "label", "p_model", "p_alt", "odds")

    def score(x):
        return X.sigmoid(0.4 * X.logit(F.col("p_model")) + 0.3 * X.logit(F.col("p_alt")) - 0.2 * F.log("odds"))

    out = B.permutation_importance(d, "entry_id", "label", {"model": ["p_model"], "market": ["odds"], "both_scores": ["p_model", "p_alt"]}, score, 42)
    return rounded(out, "delta_logloss", "delta_brier")


def bs6(spark, sf):
    return B.stratified_sample(scored(spark, sf).select("entry_id", "year"), ["year"], "entry_id", 50, 42)


QUERIES = {
    "rg1_threshold_grid": rg1, "rg1_threshold_combined": rg1_combined, "rg2_rule_grid": rg2, "rg2_best_rules": rg2_best, "rg3_odds_ev_surface": rg3,
    "rg4_rules_applied": rg4, "rg5_candidate_classes": rg5, "rg6_alpha_selection": rg6, "rg7_rule_jaccard": rg7, "rg7_pruned_rules": rg7_pruned,
    "rg8_eligibility_choice": rg8, "rg8_near_tie_choice": rg8_near_tie, "rg9_nested_walk_forward": rg9,
    "rg2_full_grid": rg2_full, "rg2_full_best_rules": rg2_full_best, "rg4_full_rules_applied": rg4_full,
    "rg1_odd_numbers": rg1_odd, "rg2_odd_numbers": rg2_odd, "rg3_odd_numbers": rg3_odd, "rg6_odd_numbers": rg6_odd,
    "bs1_roi_bootstrap": bs1("multinomial"), "bs1_roi_bootstrap_poisson": bs1("poisson"), "bs1_weighted_bootstrap": bs1_weighted, "bs2_bootstrap_population": bs2,
    "bs3_paired_bootstrap": bs3, "bs4_ece_bootstrap": bs4, "bs5_permutation_importance": bs5, "bs6_stratified_sample": bs6,
}
Bq = f"WITH {BETS} "
TH = "t AS (SELECT unnest([" + ",".join(str(t) for t in THRESHOLDS) + "])::double AS threshold)"
GRIDSUM = "count(*) AS bets, count(DISTINCT contest_id) AS contests, count(*) FILTER (pay>0) AS hits, cast(sum(pay) AS bigint) AS return, round(100.0*sum(pay)/(100*count(*)),6) AS roi, round(avg(cast(pay>0 AS int)),6) AS hit_rate"
RULES = """d1 AS (SELECT unnest([0,1,2]) AS i1, unnest([4,2,1]) AS v1), d2 AS (SELECT unnest([0,1,2]) AS i2, unnest([0.9,1.0,1.2])::double AS v2), d3 AS (SELECT unnest([0,1,2]) AS i3, unnest([0.0,0.25,0.4])::double AS v3),
 d4 AS (SELECT unnest([0,1]) AS i4, unnest([0.0,0.05])::double AS v4), d5 AS (SELECT unnest([0,1,2,3]) AS i5, unnest([1.0,1.5,2.5,3.5])::double AS v5, unnest([999.0,2.5,3.5,999.0])::double AS v6),
 rules AS (SELECT *, i1||'-'||i2||'-'||i3||'-'||i4||'-'||i5 AS rule_id FROM d1, d2, d3, d4, d5)"""
MATCH = "model_rank<=v1 AND ev>=v2 AND p_model>=v3 AND margin>=v4 AND odds>=v5 AND odds<v6"
BEST = f"WITH {RANKED}, {RULES}, m AS (SELECT status, rule_id, event_date, contest_id, entry_id, pay FROM ranked JOIN rules ON {MATCH} WHERE split='train'), " + """
 a AS (SELECT status, rule_id, count(*) AS bets, sum(pay) AS ret, count(*) FILTER (pay>0) AS hits FROM m GROUP BY 1,2 HAVING count(*)>=200),
 c AS (SELECT status, rule_id, event_date, contest_id, entry_id, pay, sum(pay-100) OVER w AS c, sum(cast(pay>0 AS int)) OVER w AS h FROM m WINDOW w AS (PARTITION BY status, rule_id ORDER BY event_date, contest_id, entry_id ROWS UNBOUNDED PRECEDING)),
 pk AS (SELECT status, rule_id, c, max(c) OVER (PARTITION BY status, rule_id ORDER BY event_date, contest_id, entry_id ROWS UNBOUNDED PRECEDING) AS pk FROM c),
 dd AS (SELECT status, rule_id, max(greatest(pk,0)-c) AS dd FROM pk GROUP BY 1,2), ls AS (SELECT status, rule_id, max(n) AS ls FROM (SELECT status, rule_id, h, count(*) FILTER (pay<=0) AS n FROM c GROUP BY 1,2,3) GROUP BY 1,2),
 s AS (SELECT *, 100.0*ret/(100*bets) AS roi, CASE WHEN 100.0*ret/(100*bets)>=90 THEN 1000000 ELSE 0 END + 100.0*ret/(100*bets)*1000 + least(bets,5000) - dd*0.01 AS score FROM a JOIN dd USING (status, rule_id) JOIN ls USING (status, rule_id)),
 top AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY score DESC, rule_id) AS selected_order FROM s)"""


def boot(clusters, its, seed, key="contest_id"):
    return Bq + f""", c AS ({clusters}), i AS (SELECT *, row_number() OVER (ORDER BY {key})-1 AS i, count(*) OVER () AS n FROM c), d AS (SELECT r AS replicate, ('0x'||substr(md5('{seed}:'||(r//4)||':'||i),1+8*(r%4),8))::bigint % n AS j FROM i, range({its}) t(r))"""


ROI = """, s AS (SELECT replicate, 100.0*sum(c.return)/nullif(sum(c.stake),0) AS roi FROM d JOIN i c ON c.i=d.j GROUP BY 1), g AS (SELECT * FROM s WHERE roi IS NOT NULL)
 SELECT round((SELECT 100.0*sum(return)/sum(stake) FROM c),6) AS point_roi, round(avg(roi),6) AS mean_roi, round(quantile_cont(roi,0.025),6) AS roi_p025, round(quantile_cont(roi,0.5),6) AS roi_p500, round(quantile_cont(roi,0.975),6) AS roi_p975,
 round(avg(cast(roi>=90 AS int)),6) AS p_roi_ge_90, round(avg(cast(roi>=100 AS int)),6) AS p_roi_ge_100, (SELECT count(*) FROM c) AS contests, count(*) AS replicates FROM g"""
CL = "SELECT contest_id, 100.0*count(*) AS stake, cast(sum(pay) AS double) AS return FROM bets WHERE ev>={t} GROUP BY 1"
import math as _m
_CUM, _POIS = 0.0, []
for _k in range(16):
    _CUM += _m.exp(-1.0) / _m.factorial(_k)
    _POIS.append(f"cast(u>={_CUM!r}::double AS int)")


def poisson(clusters, its=DRAWS, seed=42):
    """Clusters times replicates with their weight ``w``."""
    u = f"('0x'||substr(md5('{seed}:'||(r//4)||':'||contest_id),1+8*(r%4),8))::bigint/4294967296.0::double"
    return Bq + f", c AS ({clusters}), u AS (SELECT c.*, r AS replicate, {u} AS u FROM c, range({its}) t(r)), d AS (SELECT *, {'+'.join(_POIS)} AS w FROM u)"


def ll(y, p, e):
    q = f"greatest({e},least(1.0-{e},{p}))"
    return f"(CASE WHEN {y}=1 THEN -ln({q}) ELSE -ln(1.0-{q}) END)"


def bn(p):
    return "least(" + "+".join(f"cast({p}>={i/10} AS int)" for i in range(1, 10)) + ",9)"


def lgt(p):
    q = f"greatest(1e-6,least(1.0-1e-6,{p}))"
    return f"ln({q}/(1.0-{q}))"


def perm(cols):
    take = {c: (f"dn.{c}" if c in cols else f"nt.{c}") for c in ("p_model", "p_alt", "odds")}
    return ("SELECT nt.label, " + ", ".join(f"{v} AS {k}" for k, v in take.items()) + " FROM (SELECT *, row_number() OVER (ORDER BY entry_id) AS i FROM bets) nt JOIN (SELECT *, row_number() OVER (ORDER BY md5('42:'||entry_id), entry_id) AS i FROM bets) dn USING (i)")


def pmet(frame):
    p = f"1.0/(1.0+exp(-(0.4*{lgt('p_model')}+0.3*{lgt('p_alt')}-0.2*ln(odds))))"
    return f"SELECT avg({ll('label','p','1e-6')}) AS l, avg((p-label)**2) AS b FROM (SELECT label, {p} AS p FROM ({frame}))"


CLS = RANKED + """, e AS (SELECT *, CASE WHEN odds>=3.5 THEN 1.1 WHEN odds>=2.0 THEN 1.0 ELSE 0.9 END AS evm FROM ranked),
 cl AS (SELECT 'core' AS strategy_type, * FROM e WHERE model_rank=1 AND margin>=0.02 AND ev>=evm AND odds<3 UNION ALL SELECT 'value', * FROM e WHERE model_rank<=3 AND market_rank>=4 AND rank_gap>=1 AND edge>0 AND ev>=evm
 UNION ALL SELECT 'longshot', * FROM e WHERE model_rank<=3 AND odds>=3.5 AND edge>0.03 AND ev>=evm+0.15)"""
YG = BETS + f", {TH}, yg AS (SELECT year, threshold, count(*) AS bets, sum(pay) AS ret, 100.0*sum(pay)/(100*count(*)) AS roi FROM bets JOIN t ON ev>=threshold GROUP BY 1,2)"
BIG = f"WITH {RANKED}, {RULES}, m AS (SELECT rule_id, entry_id FROM ranked JOIN rules ON {MATCH}), big AS (SELECT rule_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*)>=2000), mb AS (SELECT * FROM m JOIN big USING (rule_id))"
SQL = {
    "rg1_threshold_grid": Bq + f", {TH} SELECT year, threshold, {GRIDSUM} FROM bets JOIN t ON ev>=threshold GROUP BY 1,2",
    "rg1_threshold_combined": Bq + f", {TH} SELECT threshold, {GRIDSUM} FROM bets JOIN t ON ev>=threshold GROUP BY 1",
    "rg2_rule_grid": f"WITH {RANKED}, {RULES} SELECT split, rule_id, count(*) AS bets, cast(sum(pay) AS bigint) AS return, count(*) FILTER (pay>0) AS hits, round(100.0*sum(pay)/(100*count(*)),6) AS roi, v1::double AS rank, v2 AS ev, v3 AS p, v4 AS margin, v5 AS odds_min, v6 AS odds_max FROM ranked JOIN rules ON "
                     + MATCH.replace("model_rank", "ranked.model_rank") .replace("AND ev>", "AND ranked.ev>").replace("AND margin>", "AND ranked.margin>") + " GROUP BY split, rule_id, v1, v2, v3, v4, v5, v6 HAVING count(*)>=100",
    "rg2_best_rules": BEST + " SELECT status, rule_id, bets, cast(ret AS bigint) AS return, hits, round(roi,4) AS roi, cast(dd AS bigint) AS max_drawdown, ls AS max_losing_streak, round(score,4) AS score, selected_order FROM top WHERE selected_order<=3",
    "rg3_odds_ev_surface": Bq + f", l AS (SELECT unnest({LOWS})::double AS low), h AS (SELECT unnest({HIGHS})::double AS high), e AS (SELECT unnest({EVS})::double AS e) SELECT low, high, e.e AS ev, count(*) AS bets, cast(sum(pay) AS bigint) AS return, count(*) FILTER (pay>0) AS hits, round(100.0*sum(pay)/(100*count(*)),6) AS roi FROM bets b JOIN l ON odds>=low JOIN h ON odds<high AND high>low JOIN e ON b.ev>=e.e GROUP BY 1,2,3",
    "rg4_rules_applied": BEST + f", tp AS (SELECT status AS st, rules.* FROM top JOIN rules USING (rule_id) WHERE selected_order<=3) SELECT status, rule_id, split, count(*) AS bets, count(DISTINCT contest_id) AS contests, 100*count(*) AS stake, cast(sum(pay) AS bigint) AS return, cast(sum(pay)-100*count(*) AS bigint) AS profit, round(100.0*sum(pay)/(100*count(*)),6) AS roi, count(*) FILTER (pay>0) AS hits, round(avg(cast(pay>0 AS int)),6) AS hit_rate, round(avg(odds),9) AS mean_odds, max(odds) AS max_odds, round(avg(pay),6) AS mean_payout, max(pay) AS max_payout FROM ranked JOIN tp ON status=st AND {MATCH} WHERE split<>'train' GROUP BY 1,2,3",
    "rg5_candidate_classes": f"WITH {CLS}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy_type ORDER BY ev DESC, entry_id) AS rn FROM cl) SELECT strategy_type, count(*) AS bets, cast(sum(pay) AS bigint) AS return, cast(sum(label) AS bigint) AS hits FROM r WHERE strategy_type<>'longshot' OR rn<=greatest(1,floor((SELECT count(*) FROM ranked)*0.01)) GROUP BY 1",
    "rg6_alpha_selection": Bq + ", a AS (SELECT unnest([0.0,0.25,0.5,0.75,1.0])::double AS alpha), s AS (SELECT alpha, count(*) AS bets, cast(sum(pay) AS bigint) AS return, 100.0*sum(pay)/(100*count(*)) AS roi FROM bets JOIN a ON (alpha*p_model+(1.0-alpha)*p_market)*odds>=1 GROUP BY 1), f AS (SELECT alpha, coalesce(bets,0) AS bets, coalesce(return,0) AS return, roi FROM a LEFT JOIN s USING (alpha)) SELECT alpha, bets, return, round(roi,6) AS roi, row_number() OVER (ORDER BY roi DESC NULLS LAST, bets DESC, alpha)=1 AS selected FROM f",
    "rg7_rule_jaccard": BIG + " SELECT a.rule_id, b.rule_id AS other_id, count(*) AS common, max(a.n)+max(b.n)-count(*) AS together, round(count(*)/(max(a.n)+max(b.n)-count(*)),6) AS jaccard FROM mb a JOIN mb b ON a.entry_id=b.entry_id AND a.rule_id<b.rule_id GROUP BY 1,2",
    "rg8_eligibility_choice": f"WITH {YG}, c AS (SELECT threshold, sum(bets) AS bets, 100.0*sum(ret)/(sum(bets)*100) AS roi, count(*) AS years, min(roi) AS miny, count(*) FILTER (roi>=90) AS y90 FROM yg WHERE year<=1999 GROUP BY 1), g AS (SELECT *, CASE WHEN bets<3000 THEN 'bets' WHEN years<4 THEN 'years' WHEN roi<90 THEN 'roi' ELSE '' END AS failed FROM c), b AS (SELECT threshold FROM g WHERE failed='' ORDER BY miny DESC, bets DESC, threshold LIMIT 1) SELECT threshold, cast(bets AS bigint) AS bets, round(roi,6) AS roi, round(miny,6) AS min_yearly_roi, y90 AS years_ge_90, failed, failed='' AS eligible, threshold IN (SELECT threshold FROM b) AS chosen FROM g",
    "rg9_nested_walk_forward": f"""WITH {YG}, f AS (SELECT unnest([1998,1999,2000,2001]) AS fold), c AS (SELECT fold, threshold, sum(bets) AS bets, min(roi) AS miny FROM yg JOIN f ON year<fold GROUP BY 1,2), b AS (SELECT fold, threshold FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY miny DESC, bets DESC, threshold) AS rn FROM c WHERE bets>=1000 AND miny>=80) WHERE rn=1),
 p AS (SELECT fold, coalesce(threshold,1.0) AS threshold, threshold IS NOT NULL AS certified FROM f LEFT JOIN b USING (fold)) SELECT fold, p.threshold, certified, y.bets AS validation_bets, cast(ret AS bigint) AS validation_return, round(roi,6) AS validation_roi FROM p LEFT JOIN yg y ON y.year=fold AND y.threshold=p.threshold""",
    "bs1_roi_bootstrap": boot(CL.format(t=1), DRAWS, 42) + ROI,
    "bs1_roi_bootstrap_poisson": poisson(CL.format(t=1)) + ", s AS (SELECT replicate, 100.0*sum(return*w)/sum(stake*w) AS roi FROM d GROUP BY 1), g AS (SELECT * FROM s)" + ROI[ROI.index("\n SELECT"):],
    "bs1_weighted_bootstrap": boot("SELECT contest_id, cast(sum(100*entry_no) AS double) AS stake, cast(sum(pay*entry_no) AS double) AS return FROM bets WHERE ev>=1 GROUP BY 1", DRAWS, 7) + ROI,
    "bs2_bootstrap_population": boot("SELECT contest_id, 100.0*count(*) FILTER (ev>=1.3) AS stake, cast(coalesce(sum(pay) FILTER (ev>=1.3),0) AS double) AS return FROM bets GROUP BY 1", DRAWS, 42) + ROI,
    "bs3_paired_bootstrap": poisson(f"SELECT contest_id, count(*) AS cn, sum({ll('label','p_model','1e-15')}-{ll('label','p_market','1e-15')}) AS dl, sum((p_model-label)**2-(p_market-label)**2) AS db FROM bets GROUP BY 1") + """, s AS (SELECT replicate, sum(dl*w)/sum(cn*w) AS l, sum(db*w)/sum(cn*w) AS b FROM d GROUP BY 1),
 x AS (SELECT unnest(['logloss','brier']) AS metric, unnest([l,b]) AS x FROM s), p AS (SELECT sum(dl)/sum(cn) AS l, sum(db)/sum(cn) AS b FROM c) SELECT metric, round(CASE metric WHEN 'logloss' THEN (SELECT l FROM p) ELSE (SELECT b FROM p) END,6) AS point_delta, round(avg(x),6) AS mean_delta, round(quantile_cont(x,0.025),6) AS p025, round(quantile_cont(x,0.975),6) AS p975, round(avg(cast(x<0 AS int)),6) AS p_a_better FROM x GROUP BY 1""",
    "bs4_ece_bootstrap": poisson(f"SELECT contest_id, m, bin, count(*) AS n, sum(label-p) AS gap FROM (SELECT contest_id, 'a' AS m, {bn('p_model')} AS bin, p_model AS p, label FROM bets UNION ALL SELECT contest_id, 'b', {bn('p_market')}, p_market, label FROM bets) GROUP BY 1,2,3") + """,
 s AS (SELECT replicate, m, bin, sum(n*w) AS n, sum(gap*w) AS gap FROM d GROUP BY 1,2,3), e AS (SELECT replicate, m, sum(abs(gap))/sum(n) AS ece FROM s GROUP BY 1,2), x AS (SELECT a.ece-b.ece AS x FROM e a JOIN e b ON a.replicate=b.replicate AND a.m='a' AND b.m='b')
 SELECT round(avg(x),6) AS mean_delta, round(quantile_cont(x,0.025),6) AS p025, round(quantile_cont(x,0.975),6) AS p975, round(avg(cast(x<0 AS int)),6) AS p_a_better FROM x""",
    "bs5_permutation_importance": Bq + f", base AS ({pmet('SELECT * FROM bets')}), x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS g, * FROM ({pmet(perm(c))})" for n, c in {"model": ["p_model"], "market": ["odds"], "both_scores": ["p_model", "p_alt"]}.items()) + ") SELECT g AS feature_group, round(x.l-base.l,6) AS delta_logloss, round(x.b-base.b,6) AS delta_brier FROM x, base",
    "bs6_stratified_sample": f"WITH {SCORED} SELECT entry_id, year FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY md5('42:'||entry_id), entry_id) AS rn FROM scored) WHERE rn<=50",
}


def full_rules():
    """The whole grid as SQL: value lists from loosest to tightest, numbered from 0."""
    parts = []
    for n, v in FULL_DIMS.items():
        if n == "odds":
            lists = f"unnest({[a for a, _ in v]})::double AS v_low, unnest({[b for _, b in v]})::double AS v_high"
        else:
            lists = f"unnest({sorted(v, reverse=n == 'rank')})::double AS v_{n}"
        parts.append(f"g_{n} AS (SELECT unnest(range({len(v)})) AS i_{n}, {lists})")
    name = "||'-'||".join(f"i_{n}" for n in FULL_DIMS)
    return ", ".join(parts) + f", rules AS (SELECT *, {name} AS rule_id FROM {', '.join('g_' + n for n in FULL_DIMS)})"


FULL_MATCH = "model_rank<=v_rank AND ev>=v_ev AND p_model>=v_p AND margin>=v_margin AND agreement>=v_agree AND calm>=v_calm AND odds>=v_low AND odds<v_high AND edge>=v_gap"
FULL_RANKED = RANKED + """, alts AS (SELECT *, cast(model_rank=1 AS int)+cast(market_rank=1 AS int)+cast(row_number() OVER (PARTITION BY contest_id ORDER BY p_alt DESC, entry_id)=1 AS int) AS agreement FROM ranked),
 lev AS (SELECT status, quantile_cont(entropy,0.75) AS entropy_max FROM alts WHERE split='train' GROUP BY 1), wide AS (SELECT alts.*, cast(entropy<=entropy_max AS int) AS calm FROM alts LEFT JOIN lev USING (status))"""
FULL_BEST = BEST.replace(RANKED, FULL_RANKED).replace(RULES, full_rules()).replace(f"FROM ranked JOIN rules ON {MATCH}", f"FROM wide JOIN rules ON {FULL_MATCH}")
SQL["rg2_full_grid"] = f"WITH {FULL_RANKED}, {full_rules()} SELECT status, rule_id, count(*) AS bets, cast(sum(pay) AS bigint) AS return, count(*) FILTER (pay>0) AS hits, round(100.0*sum(pay)/(100*count(*)),6) AS roi FROM wide JOIN rules ON {FULL_MATCH} WHERE split='train' GROUP BY 1,2 HAVING count(*)>=100"
SQL["rg2_full_best_rules"] = FULL_BEST + SQL["rg2_best_rules"][len(BEST):]
SQL["rg4_full_rules_applied"] = FULL_BEST + SQL["rg4_rules_applied"][len(BEST):].replace(f"FROM ranked JOIN tp ON status=st AND {MATCH}", f"FROM wide JOIN tp ON status=st AND {FULL_MATCH}")
SQL["rg1_odd_numbers"] = odd_sql(SQL["rg1_threshold_grid"])
SQL["rg2_odd_numbers"] = odd_sql(SQL["rg2_rule_grid"], "ranked").replace("p_market END AS p_market", "p_model END AS p_model").replace("NULL ELSE p_market", "NULL ELSE p_model")
SQL["rg3_odd_numbers"] = odd_sql(SQL["rg3_odds_ev_surface"])
SQL["rg6_odd_numbers"] = odd_sql(SQL["rg6_alpha_selection"])
# a sequential pass in score order: each step keeps the best rule left and drops what is similar to it
SQL["rg7_pruned_rules"] = BIG.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT rule_id, n, row_number() OVER (ORDER BY n DESC, rule_id) AS k FROM big),
 e AS MATERIALIZED (SELECT x.k AS a, y.k AS b FROM (SELECT a.rule_id AS r, b.rule_id AS o, count(*)/(max(a.n)+max(b.n)-count(*)) AS j FROM mb a JOIN mb b ON a.entry_id=b.entry_id AND a.rule_id<>b.rule_id GROUP BY 1,2) JOIN n x ON x.rule_id=r JOIN n y ON y.rule_id=o WHERE j>=0.6),
 p AS (SELECT 1 AS k, [1] AS kept UNION ALL SELECT k+1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b=p.k+1 AND list_contains(p.kept, e.a)) THEN kept ELSE list_append(kept, k+1) END FROM p WHERE k<(SELECT count(*) FROM n))
 SELECT n.rule_id, n.n AS bets FROM n WHERE list_contains((SELECT kept FROM p ORDER BY k DESC LIMIT 1), n.k)"""


def _late():
    from pitpanel.plans.q_metrics import LONG
    SQL["rg8_near_tie_choice"] = f"""WITH {LONG}, y AS (SELECT model, year, round(avg({ll('label','p','1e-6')}),6) AS l, round(avg((p-label)*(p-label)),6) AS b FROM long GROUP BY 1,2), c AS (SELECT model, round(avg(l),6) AS logloss, round(max(l),6) AS worst, round(avg(b),6) AS brier FROM y GROUP BY 1),
 n AS (SELECT * FROM c WHERE logloss<=(SELECT min(logloss) FROM c)+0.05), r AS (SELECT *, rank() OVER (ORDER BY logloss)+rank() OVER (ORDER BY worst)+rank() OVER (ORDER BY brier) AS rank_sum FROM n) SELECT model, logloss, rank_sum FROM r ORDER BY rank_sum, logloss, model LIMIT 1"""


_late()
