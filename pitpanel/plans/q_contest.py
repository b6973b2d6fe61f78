"""Registered queries: operators within a contest."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.ordered import average_ranks
from pitpanel.operators import contest as C
from pitpanel.operators import metrics as M
from pitpanel.plans.base import BETS, SCORED, bets, r6, rounded, scored

G = ["contest_id"]


def wn1(spark, sf):
    return bets(spark, sf).select("entry_id", r6("p_market").alias("p_market"))


def wn2(spark, sf):
    d = C.ratios(scored(spark, sf), G, "odds", "odds")
    return d.select("entry_id", r6("odds_ratio_min").alias("odds_ratio_min"), r6("odds_ratio_mean").alias("odds_ratio_mean"))


def wn3(spark, sf):
    d = scored(spark, sf).withColumn("popularity", F.when(F.col("status") == "O", F.col("entry_no")))
    return C.fill_rank(d, G, "popularity", "odds", "entry_id", "filled").select("entry_id", F.col("filled").cast("long").alias("filled"))


def wn4(spark, sf):
    return C.model_rank(scored(spark, sf), G, "p_model", "entry_id").select("entry_id", "model_rank")


def wn4_gap(spark, sf):
    d = C.contest_view(scored(spark, sf), G, "p_model", 1.0 / F.col("odds"), "p_market", "entry_id")
    return d.withColumn("rank_gap", F.col("market_rank") - F.col("model_rank")).groupBy("rank_gap").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("label").alias("hits"))


def conf(spark, sf):
    return C.confidence_by_group(scored(spark, sf), G, "p_model", "entry_id")


def wn5(spark, sf):
    return rounded(conf(spark, sf), "top1", "top2", "top3", "margin", "top3_sum").select(
        "contest_id", "size", "top1", "top2", "top3", "margin", "top3_sum", "top_entry")


def wn6(spark, sf):
    return rounded(conf(spark, sf), "entropy").select("contest_id", "entropy")


def wn7(spark, sf):
    d = bets(spark, sf)
    long = M.long_scores(d, ["contest_id", "entry_id"], ["p_model", "p_alt", "p_market"])
    top = C.one_per_group(long.select("contest_id", "model", "entry_id", "p"), ["contest_id", "model"], [-F.col("p"), F.col("entry_id")])
    return C.agreement(top, G, "model", "entry_id").groupBy("model", "agreement").agg(F.count(F.lit(1)).alias("contests"))


def wn8(spark, sf):
    d = bets(spark, sf).select("contest_id", "entry_id", "ev", "p_model", "odds", "pay")
    return rounded(C.one_per_group(d, G, [-F.col("ev"), -F.col("p_model"), F.col("entry_id")]), "ev", "p_model").select(
        "contest_id", "entry_id", "ev", "p_model", "pay")


def wn9(spark, sf):
    d = bets(spark, sf).filter("ev >= 1").withColumn("stake", F.lit(100).cast("long"))
    d = C.cumulative(d.select("segment", "status", "event_date", "contest_id", "entry_id", "stake", "pay"), ["status"],
                     [F.col("event_date"), F.col("contest_id"), F.col("entry_id")], "stake", "pay")
    return rounded(d, "cum_roi").select("status", "entry_id", "cum_stake", "cum_return", "cum_profit", "cum_roi")


def wn10(spark, sf):
    y = bets(spark, sf).groupBy("segment", "year").agg(F.count_if(F.col("ev") >= 1).alias("picks"))
    return rounded(C.year_over_year(y, ["segment"], "year", "picks"), "picks_ratio")


def broken(spark, sf):
    """Scores with natural gaps: odds missing on one tax level, predictions missing on another."""
    from pitpanel.plans.base import SCORED_COLUMNS, table
    return table(spark, sf, "lineitem").selectExpr(
        *SCORED_COLUMNS, "l_tax").withColumns({
            "odds": F.when(F.col("l_tax") >= 0.075, None).when(F.col("l_tax") <= 0.005, F.lit(0.0)).otherwise(F.col("odds")),
            "p_alt": F.when((F.col("l_tax") > 0.065) & (F.col("l_tax") < 0.075), None).otherwise(F.col("p_alt"))})


def wn11(spark, sf):
    r = C.contest_reasons(broken(spark, sf), "contest_id", "entry_id", "label", "odds", ["p_model", "p_alt"])
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("contests"))


def wn11_frame(spark, sf):
    d = broken(spark, sf)
    c = C.complete_contests(d, C.contest_reasons(d, "contest_id", "entry_id", "label", "odds", ["p_model", "p_alt"]), "contest_id")
    return C.normalise(c, G, 1.0 / F.col("odds"), "p_market").select("entry_id", r6("p_market").alias("p_market"))


def wn12_rank(spark, sf):
    d = C.rank_bins(scored(spark, sf), "p_alt", "entry_id", 10)
    return rounded(d.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.avg("p_alt").alias("mean_p"), F.avg("label").alias("rate")), "mean_p", "rate")


def wn12_value(spark, sf):
    d = C.value_bins(scored(spark, sf), "p_model", 13)
    return rounded(d.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.avg("p_model").alias("mean_p"), F.avg("label").alias("rate")), "mean_p", "rate")


def wn12_quantile(spark, sf):
    d = C.quantile_bins(scored(spark, sf), "p_alt", 10)
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))


QUERIES = {
    "wn1_normalised_market": wn1, "wn2_group_ratios": wn2, "wn3_rank_fallback": wn3, "wn4_model_rank": wn4, "wn4_rank_gap": wn4_gap,
    "wn5_confidence_top3": wn5, "wn6_entropy": wn6, "wn7_model_agreement": wn7, "wn8_one_pick_per_contest": wn8,
    "wn9_cumulative_roi": wn9, "wn10_year_over_year": wn10, "wn11_contest_reasons": wn11, "wn11_complete_contests": wn11_frame,
    "wn12_rank_bins": wn12_rank, "wn12_value_bins": wn12_value, "wn12_quantile_bins": wn12_quantile,
}
W, B = f"WITH {SCORED} ", f"WITH {BETS} "
CONF = SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY p_model DESC, entry_id) AS rn, p_model/sum(p_model) OVER (PARTITION BY contest_id) AS q FROM scored),
 conf AS (SELECT contest_id, count(*) AS size, max(p_model) FILTER (rn=1) AS t1, max(p_model) FILTER (rn=2) AS t2, max(p_model) FILTER (rn=3) AS t3,
 max(entry_id) FILTER (rn=1) AS top_entry, sum(-q*ln(q))/ln(greatest(count(*),2)) AS h FROM r GROUP BY 1)"""
BROKEN = SCORED.replace(" FROM lineitem", ", l_tax FROM lineitem") + """, broken AS (SELECT * REPLACE (CASE WHEN l_tax>=0.075 THEN NULL WHEN l_tax<=0.005 THEN 0.0 ELSE odds END AS odds,
 CASE WHEN l_tax>0.065 AND l_tax<0.075 THEN NULL ELSE p_alt END AS p_alt) FROM scored),
 reasons AS (SELECT contest_id, CASE WHEN count(*)>count(DISTINCT entry_id) THEN 'duplicate_entry_id' WHEN count(*) FILTER (label NOT IN (0,1) OR label IS NULL)>0 THEN 'invalid_actual'
 WHEN sum(label)<1 THEN 'missing_winner' WHEN count(*) FILTER (odds IS NULL)>0 THEN 'missing_odds_runner' WHEN count(*) FILTER (odds<=0)>0 THEN 'invalid_odds_runner'
 WHEN count(*) FILTER (p_model IS NULL OR p_alt IS NULL)>0 THEN 'missing_model_prediction' ELSE '' END AS reason FROM broken GROUP BY 1)"""
SQL = {
    "wn1_normalised_market": B + "SELECT entry_id, round(p_market,6) AS p_market FROM bets",
    "wn2_group_ratios": W + "SELECT entry_id, round(odds/min(odds) OVER g,6) AS odds_ratio_min, round(odds/avg(odds) OVER g,6) AS odds_ratio_mean FROM scored WINDOW g AS (PARTITION BY contest_id)",
    "wn3_rank_fallback": W + "SELECT entry_id, cast(CASE WHEN status='O' THEN entry_no ELSE row_number() OVER (PARTITION BY contest_id ORDER BY odds, entry_id) END AS bigint) AS filled FROM scored",
    "wn4_model_rank": W + "SELECT entry_id, row_number() OVER (PARTITION BY contest_id ORDER BY p_model DESC, entry_id) AS model_rank FROM scored",
    "wn4_rank_gap": B + """SELECT k-m AS rank_gap, count(*) AS entries, cast(sum(label) AS bigint) AS hits FROM (SELECT label, row_number() OVER (PARTITION BY contest_id ORDER BY p_model DESC, entry_id) AS m,
 row_number() OVER (PARTITION BY contest_id ORDER BY p_market DESC, entry_id) AS k FROM bets) GROUP BY 1""",
    "wn5_confidence_top3": f"WITH {CONF} SELECT contest_id, size, round(t1,6) AS top1, round(t2,6) AS top2, round(t3,6) AS top3, round(t1-coalesce(t2,0),6) AS margin, round(t1+coalesce(t2,0)+coalesce(t3,0),6) AS top3_sum, top_entry FROM conf",
    "wn6_entropy": f"WITH {CONF} SELECT contest_id, round(h,6)+0.0 AS entropy FROM conf",
    "wn7_model_agreement": B + """, l AS (SELECT contest_id, entry_id, unnest(['p_model','p_alt','p_market']) AS model, unnest([p_model,p_alt,p_market]) AS p FROM bets),
 t AS (SELECT contest_id, model, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY contest_id, model ORDER BY p DESC, entry_id) AS rn FROM l) WHERE rn=1),
 v AS (SELECT *, count(*) OVER (PARTITION BY contest_id, entry_id) AS agreement FROM t) SELECT model, agreement, count(*) AS contests FROM v GROUP BY 1,2""",
    "wn8_one_pick_per_contest": B + "SELECT contest_id, entry_id, round(ev,6) AS ev, round(p_model,6) AS p_model, pay FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY ev DESC, p_model DESC, entry_id) AS rn FROM bets) WHERE rn=1",
    "wn9_cumulative_roi": B + """SELECT status, entry_id, cs AS cum_stake, cast(cr AS bigint) AS cum_return, cast(cr-cs AS bigint) AS cum_profit, round(100.0*cr/cs,6) AS cum_roi FROM (
 SELECT status, entry_id, cast(100*count(*) OVER w AS bigint) AS cs, sum(pay) OVER w AS cr FROM bets WHERE ev>=1
 WINDOW w AS (PARTITION BY status ORDER BY event_date, contest_id, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "wn10_year_over_year": B + """, y AS (SELECT segment, year, count(*) FILTER (ev>=1) AS picks FROM bets GROUP BY 1,2)
 SELECT segment, year, picks, round(picks/lag(picks) OVER w,6) AS picks_ratio, abs(picks-lag(picks) OVER w) AS picks_delta FROM y WINDOW w AS (PARTITION BY segment ORDER BY year)""",
    "wn11_contest_reasons": f"WITH {BROKEN} SELECT reason, count(*) AS contests FROM reasons GROUP BY 1",
    "wn11_complete_contests": f"WITH {BROKEN} SELECT entry_id, round((1.0/odds)/sum(1.0/odds) OVER (PARTITION BY contest_id),6) AS p_market FROM broken JOIN reasons USING (contest_id) WHERE reason=''",
    "wn12_rank_bins": W + "SELECT cast(bin AS int) AS bin, count(*) AS rows, round(avg(p_alt),6) AS mean_p, round(avg(label),6) AS rate FROM (SELECT p_alt, label, ((row_number() OVER (ORDER BY p_alt, entry_id)-1)*10)//count(*) OVER () AS bin FROM scored) GROUP BY 1",
    "wn12_value_bins": W + ", d AS (SELECT p_model AS v, ntile(13) OVER (ORDER BY p_model)-1 AS bin FROM (SELECT DISTINCT p_model FROM scored)) SELECT cast(bin AS int) AS bin, count(*) AS rows, round(avg(p_model),6) AS mean_p, round(avg(label),6) AS rate FROM scored JOIN d ON v=p_model GROUP BY 1",
    "wn12_quantile_bins": W + ", e AS (SELECT quantile_cont(p_alt,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM scored) SELECT len(list_filter(q, lambda x: p_alt > x)) AS bin, count(*) AS rows, cast(sum(label) AS bigint) AS positives FROM scored, e GROUP BY 1",
}
