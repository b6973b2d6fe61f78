"""Registered queries: backtest aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.operators import backtest as K
from pitpanel.operators import contest as C
from pitpanel.plans.base import BETS, bets, odd_bets, odd_sql, r6, rounded

BANDS = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 6.0]


def order():
    return [F.col("event_date"), F.col("contest_id"), F.col("entry_id")]


def picks(spark, sf):
    """Bets at EV >= 1 with odds band and month."""
    return bets(spark, sf).filter("ev >= 1").withColumns({
        "odds_band": X.bucketize(F.col("odds"), BANDS, right=False), "month": F.date_format("event_date", "yyyy-MM")})


def bt1(spark, sf):
    d = K.bet_summary(picks(spark, sf), ["segment", "split"], "contest_id", "pay", "odds")
    return rounded(d, "roi", "hit_rate", "median_odds", "mean_payout").withColumn("mean_odds", r6("mean_odds", 9))


def bt2(spark, sf):
    return K.ordered_risk(picks(spark, sf), ["status", "split"], order(), "pay")


def bt3(spark, sf):
    return K.ordered_risk(picks(spark, sf), ["status"], order(), "pay").select("status", "max_losing_streak")


def bt4(spark, sf):
    return rounded(K.grouping_roi(picks(spark, sf), ["split"], ["year", "month", "status", "segment", "odds_band"], "pay"), "roi")


def bt5(spark, sf):
    return rounded(K.payout_dependency(picks(spark, sf), ["split"], "entry_id", "pay"), "roi")


def bt6(spark, sf):
    return rounded(K.stress(picks(spark, sf), ["split"], "entry_id", "pay"), "normal_roi", "row_removed_roi", "payout_zeroed_roi", "drop_points", "payout_share")


def bt7(base):
    def run(spark, sf):
        return rounded(K.profit_concentration(picks(spark, sf), ["split"], "entry_id", "pay", 0.05, base), "top1_share", "top_q_share")
    return run


def bt8(spark, sf):
    return rounded(K.band_contribution(picks(spark, sf), ["split"], "odds_band", "pay"), "profit_share")


def bt9(spark, sf):
    return rounded(K.year_stability(picks(spark, sf), ["odds_band"], "year", "pay"), "year_roi_min", "year_roi_mean", "year_roi_std", "roi")


def bt10(spark, sf):
    d = picks(spark, sf)
    g = ["odds_band"]
    removed = K.payout_dependency(d, g, "entry_id", "pay", (5,)).filter("removed = 5").select(*g, F.col("roi").alias("top5_removed_roi"))
    bands = K.year_stability(d, g, "year", "pay").join(removed, g).join(K.ordered_risk(d, g, order(), "pay"), g)
    weights = {k: v for k, v in K.RELIABILITY.items() if k != "bootstrap_lower"}
    out = K.band_reliability(bands, weights)
    return rounded(out, "reliability_score").select(*g, "reliability_score", "band_class",
                                                   F.when(F.col("band_class") != "exclude", F.col("ev_threshold")).alias("ev_threshold"))


def bt11(spark, sf):
    return rounded(K.ev_band_roi(bets(spark, sf), ["split"], F.col("ev"), "pay"), "roi")


def bt11_spearman(spark, sf):
    return rounded(K.ev_spearman(K.ev_band_roi(bets(spark, sf), ["split"], F.col("ev"), "pay"), ["split"]), "spearman")


def bt12(spark, sf):
    """Crossings of 1; the market side is taken to nine digits, so the order in which a contest's float sum was added decides no tie."""
    d = K.ev_crossing(bets(spark, sf), ["year"], F.round(F.col("p_market") * F.col("odds") * 1.4, 9), F.col("ev"))
    return rounded(d, "model_ge_1_rate")


def bt13(spark, sf):
    d = K.pick_frequency(bets(spark, sf), ["year"], "event_date", F.col("ev"), [0.9, 1.0, 1.1, 1.3, 1.6])
    return rounded(d, "picks_per_active_day", "picks_per_active_month")


def bt11_odd(spark, sf):
    return rounded(K.ev_band_roi(odd_bets(spark, sf), ["split"], F.col("ev"), "pay"), "roi")


def bt12_odd(spark, sf):
    d = K.ev_crossing(odd_bets(spark, sf), ["year"], F.round(F.col("p_market") * F.col("odds") * 1.4, 9), F.col("ev"))
    return rounded(d, "model_ge_1_rate")


def bt13_odd(spark, sf):
    d = K.pick_frequency(odd_bets(spark, sf), ["year"], "event_date", F.col("ev"), [0.9, 1.0, 1.1, 1.3, 1.6])
    return rounded(d, "picks_per_active_day", "picks_per_active_month")


def bt14(spark, sf):
    methods = {"equal_100": F.lit(100.0), "three_stage": F.when(F.col("odds") < 2, 100.0).when(F.col("odds") < 3, 50.0).otherwise(0.0),
               "score_bucketed": F.when(F.col("p_model") <= 0.33, 50.0).when(F.col("p_model") <= 0.66, 100.0).otherwise(150.0)}
    return rounded(K.staked_summary(picks(spark, sf), ["split"], methods, "pay"), "stake", "return", "roi", digits=4)


def strategies():
    ev, odds = F.col("ev"), F.col("odds")
    return {"ev_1.0": ev >= 1.0, "ev_1.2": ev >= 1.2, "odds_2_3": (odds >= 2) & (odds < 3), "odds_3_up_ev_1.1": (odds >= 3) & (ev >= 1.1),
            "all": F.lit(True)}


def bt15(spark, sf):
    d = K.strategy_bets(bets(spark, sf), strategies())
    out = K.bet_summary(d, ["strategy", "split"], "contest_id", "pay", "odds", median=False)
    return rounded(out, "roi", "hit_rate", "mean_payout").withColumn("mean_odds", r6("mean_odds", 9))


def bt16(spark, sf):
    conf = C.confidence_by_group(bets(spark, sf), ["contest_id"], "p_model", "entry_id")
    band = X.bucketize(F.col("margin"), [-1.0, 0.02, 0.05, 0.1, 0.2, 1.0], right=True)
    ent = X.bucketize(F.col("entropy"), [-0.1, 0.5, 0.8, 0.9, 0.95, 1.1], right=True)
    conf = conf.select("contest_id", band.alias("margin_band"), ent.alias("entropy_band"))
    d = picks(spark, sf).join(conf, "contest_id")
    return rounded(K.grouping_roi(d, [], ["margin_band", "entropy_band"], "pay"), "roi")


def bt16_contest(spark, sf):
    """Contest level: share of contests whose best entry hits, per margin band."""
    d = bets(spark, sf)
    conf = C.confidence_by_group(d, ["contest_id"], "p_model", "entry_id")
    band = X.bucketize(F.col("margin"), [-1.0, 0.02, 0.05, 0.1, 0.2, 1.0], right=True)
    top = conf.select("contest_id", band.alias("margin_band"), F.col("top_entry").alias("entry_id"))
    return rounded(top.join(d.select("entry_id", "label", "pay"), "entry_id").groupBy("margin_band").agg(
        F.count(F.lit(1)).alias("contests"), F.avg("label").alias("top1_hit_rate"), (F.sum("pay") / F.count(F.lit(1))).alias("roi")), "top1_hit_rate", "roi")


def bt17(spark, sf):
    a = bets(spark, sf).filter("ev >= 1").select("contest_id", "entry_id", "pay")
    b = bets(spark, sf).filter("p_alt * odds >= 1").select("contest_id", "entry_id", "pay")
    return rounded(K.overlap(a, b, ["contest_id", "entry_id"], "pay"), "common_roi", "only_a_roi", "only_b_roi", "jaccard")


def bt18(spark, sf):
    return rounded(K.segment_cube(picks(spark, sf), ["segment", "status", "odds_band"], "year", "pay", 300, 4), "roi", "year_roi_min")


def bt19(spark, sf):
    d = bets(spark, sf).withColumn("odds_band", X.bucketize(F.col("odds"), [1, 1.3, 1.6, 2.0, 2.5], right=False)).filter("odds < 2.5")
    return rounded(K.bet_summary(d, ["odds_band", "year"], "contest_id", "pay", "odds", median=False), "roi", "hit_rate", "mean_payout").withColumn("mean_odds", r6("mean_odds", 9))


QUERIES = {
    "bt1_bet_summary": bt1, "bt2_max_drawdown": bt2, "bt3_losing_streak": bt3, "bt4_grouped_roi": bt4, "bt5_payout_dependency": bt5,
    "bt6_stress_pair": bt6, "bt7_concentration_all": bt7("all"), "bt7_concentration_winning": bt7("winning"), "bt8_band_contribution": bt8,
    "bt9_year_stability": bt9, "bt10_band_reliability": bt10, "bt11_ev_band_roi": bt11, "bt11_ev_spearman": bt11_spearman, "bt12_ev_crossing": bt12,
    "bt13_pick_frequency": bt13, "bt11_odd_numbers": bt11_odd, "bt12_odd_numbers": bt12_odd, "bt13_odd_numbers": bt13_odd, "bt14_stake_methods": bt14, "bt15_fixed_strategies": bt15, "bt16_confidence_entry": bt16,
    "bt16_confidence_contest": bt16_contest, "bt17_overlap": bt17, "bt18_segment_cube": bt18, "bt19_low_odds_bands": bt19,
}


def band_sql(c, edges, right=False):
    out = "CASE "
    for lo, hi in zip(edges[:-1], edges[1:]):
        out += (f"WHEN {c}>{lo} AND {c}<={hi} THEN '({lo:g},{hi:g}]' " if right else f"WHEN {c}>={lo} AND {c}<{hi} THEN '[{lo:g},{hi:g})' ")
    return out + "ELSE '(none)' END"


P = f"WITH {BETS}, picks AS (SELECT *, {band_sql('odds', BANDS)} AS odds_band, strftime(event_date,'%Y-%m') AS month FROM bets WHERE ev>=1) "
B = f"WITH {BETS} "
ORD = "ORDER BY event_date, contest_id, entry_id"


def summary(by, median=True):
    return (f"SELECT {by}, count(*) AS bets, count(DISTINCT contest_id) AS contests, 100*count(*) AS stake, cast(sum(pay) AS bigint) AS return, cast(sum(pay)-100*count(*) AS bigint) AS profit, "
            f"round(100.0*sum(pay)/(100*count(*)),6) AS roi, count(*) FILTER (pay>0) AS hits, round(avg(cast(pay>0 AS int)),6) AS hit_rate, round(avg(odds),9) AS mean_odds, max(odds) AS max_odds, "
            f"round(avg(pay),6) AS mean_payout, max(pay) AS max_payout" + (", round(median(odds),6) AS median_odds" if median else ""))


def risk(frame, by):
    return (f"(SELECT {by}, cast(max(greatest(pk,0)-c) AS bigint) AS max_drawdown FROM (SELECT {by}, c, max(c) OVER (PARTITION BY {by} {ORD} ROWS UNBOUNDED PRECEDING) AS pk FROM "
            f"(SELECT *, sum(pay-100) OVER (PARTITION BY {by} {ORD} ROWS UNBOUNDED PRECEDING) AS c FROM {frame})) GROUP BY {by}) JOIN "
            f"(SELECT {by}, max(n) AS max_losing_streak FROM (SELECT {by}, h, count(*) FILTER (pay<=0) AS n FROM (SELECT *, sum(cast(pay>0 AS int)) OVER (PARTITION BY {by} {ORD} ROWS UNBOUNDED PRECEDING) AS h FROM {frame}) "
            f"GROUP BY {by}, h) GROUP BY {by}) USING ({by})")


RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY pay DESC, entry_id) AS rn FROM picks)"
LIM = "lim AS (SELECT unnest([{n}]) AS removed)"
STAB = """stab AS (SELECT odds_band, count(*) AS years_with_bets, cast(sum(n) AS bigint) AS bets, min(n) AS min_yearly_bets, min(r) AS year_roi_min, avg(r) AS year_roi_mean, stddev_pop(r) AS year_roi_std,
 count(*) FILTER (r>=90) AS years_roi_ge_90, sum(p)/sum(n) AS roi FROM (SELECT odds_band, year, count(*) AS n, sum(pay) AS p, 100.0*sum(pay)/(100*count(*)) AS r FROM picks GROUP BY 1,2) GROUP BY 1)"""


def mm(c, up=True):
    s = f"(CASE WHEN min({c}) OVER () IS NULL OR min({c}) OVER ()=max({c}) OVER () THEN 0.5 ELSE ({c}-min({c}) OVER ())/(max({c}) OVER ()-min({c}) OVER ()) END)"
    return f"coalesce({s if up else '1-' + s},0)"


EVB = "(" + "+".join(f"cast(ev>={e} AS int)" for e in K.EV_EDGES[1:-1]) + ")"
EVBANDS = BETS + f", evb AS (SELECT split, {EVB} AS ev_band, count(*) AS bets, cast(sum(pay) AS bigint) AS return, 100.0*sum(pay)/(100*count(*)) AS roi FROM bets GROUP BY 1,2)"
CONF = """, rk AS (SELECT contest_id, entry_id, p_model, row_number() OVER (PARTITION BY contest_id ORDER BY p_model DESC, entry_id) AS rn, p_model/sum(p_model) OVER (PARTITION BY contest_id) AS q FROM bets),
 conf AS (SELECT contest_id, max(entry_id) FILTER (rn=1) AS top_entry, max(p_model) FILTER (rn=1)-coalesce(max(p_model) FILTER (rn=2),0) AS margin, sum(-q*ln(q))/ln(greatest(count(*),2)) AS entropy FROM rk GROUP BY 1)"""
MB = band_sql("margin", [-1.0, 0.02, 0.05, 0.1, 0.2, 1.0], True)
EB = band_sql("entropy", [-0.1, 0.5, 0.8, 0.9, 0.95, 1.1], True)


def conc(base):
    n = "count(*) OVER (PARTITION BY split)" if base == "all" else "count(*) FILTER (pay>100) OVER (PARTITION BY split)"
    return P + f""", g AS (SELECT split, greatest(pay-100,0) AS g, row_number() OVER (PARTITION BY split ORDER BY pay DESC, entry_id) AS rn, greatest(1,ceil({n}*0.05)) AS k FROM picks)
 SELECT split, round(max(g)/sum(g),6) AS top1_share, round(sum(g) FILTER (rn<=k)/sum(g),6) AS top_q_share FROM g GROUP BY 1"""


_PAIRS = [["segment"], ["status"], ["odds_band"], ["segment", "status"], ["segment", "odds_band"], ["status", "odds_band"]]
CUBE = " UNION ALL ".join(f"SELECT '{'+'.join(p)}' AS axes, {'||chr(43)||'.join(p)} AS values, year, pay FROM picks" for p in _PAIRS)
SQL = {
    "bt1_bet_summary": P + summary("segment, split") + " FROM picks GROUP BY segment, split",
    "bt2_max_drawdown": P + "SELECT * FROM " + risk("picks", "status, split"),
    "bt3_losing_streak": P + "SELECT status, max_losing_streak FROM " + risk("picks", "status"),
    "bt4_grouped_roi": P + """, l AS (SELECT split, pay, unnest(['year','month','status','segment','odds_band']) AS dimension, unnest([cast(year AS varchar), month, status, segment, odds_band]) AS value FROM picks)
 SELECT split, dimension, value, count(*) AS bets, cast(sum(pay) AS bigint) AS return, count(*) FILTER (pay>0) AS hits, round(100.0*sum(pay)/(100*count(*)),6) AS roi FROM l GROUP BY 1,2,3""",
    "bt5_payout_dependency": P + f", {RANKED.format(by='split')}, {LIM.format(n='0,1,3,5,10')} SELECT split, removed, count(*) AS bets, cast(sum(pay) AS bigint) AS return, round(100.0*sum(pay)/(100*count(*)),6) AS roi FROM rk JOIN lim ON rn>removed GROUP BY 1,2",
    "bt6_stress_pair": P + f""", {RANKED.format(by='split')}, {LIM.format(n='1,3,5,10')}, s AS (SELECT split, removed, count(*) AS n, sum(pay) AS t, count(*) FILTER (rn<=removed AND pay>0) AS h, coalesce(sum(pay) FILTER (rn<=removed),0) AS s FROM rk, lim GROUP BY 1,2)
 SELECT split, removed, h AS removed_hits, round(t/n,6) AS normal_roi, round((t-s)/(n-h),6) AS row_removed_roi, round((t-s)/n,6) AS payout_zeroed_roi, round(t/n-(t-s)/n,6) AS drop_points, round(s/t,6) AS payout_share FROM s""",
    "bt7_concentration_all": conc("all"), "bt7_concentration_winning": conc("winning"),
    "bt8_band_contribution": P + ", b AS (SELECT split, odds_band, count(*) AS bets, cast(sum(pay-100) AS bigint) AS profit FROM picks GROUP BY 1,2) SELECT split, odds_band, bets, profit, round(profit/nullif(sum(profit) OVER (PARTITION BY split),0),6) AS profit_share FROM b",
    "bt9_year_stability": P + f", {STAB} SELECT odds_band, years_with_bets, bets, min_yearly_bets, round(year_roi_min,6) AS year_roi_min, round(year_roi_mean,6) AS year_roi_mean, round(year_roi_std,6) AS year_roi_std, years_roi_ge_90, round(roi,6) AS roi FROM stab",
    "bt10_band_reliability": P + f""", {STAB}, {RANKED.format(by='odds_band')}, rem AS (SELECT odds_band, sum(pay) FILTER (rn>5)/nullif(count(*) FILTER (rn>5),0) AS top5 FROM rk GROUP BY 1), risk AS (SELECT * FROM {risk('picks','odds_band')}),
 j AS (SELECT * FROM stab JOIN rem USING (odds_band) JOIN risk USING (odds_band)), sc AS (SELECT *, 0.15*{mm('roi')}+0.25*{mm('year_roi_min')}+0.20*{mm('top5')}+0.10*{mm('bets')}+0.05*{mm('year_roi_std',False)}+0.05*{mm('max_drawdown',False)} AS score,
 CASE WHEN years_with_bets>=4 AND bets>=300 AND min_yearly_bets>=30 AND roi>=95 AND top5>=90 THEN 'main' WHEN bets>=300 AND roi>=85 THEN 'support' ELSE 'exclude' END AS band_class FROM j)
 SELECT odds_band, round(score,6) AS reliability_score, band_class, CASE band_class WHEN 'main' THEN 0.9 WHEN 'support' THEN 0.85 END::double AS ev_threshold FROM sc""",
    "bt11_ev_band_roi": f"WITH {EVBANDS} SELECT split, ev_band, bets, return, round(roi,6) AS roi, coalesce(roi>=lag(roi) OVER (PARTITION BY split ORDER BY ev_band),true) AS monotone FROM evb",
    "bt11_ev_spearman": f"WITH {EVBANDS}, r AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY ev_band) AS a, rank() OVER (PARTITION BY split ORDER BY roi)+(count(*) OVER (PARTITION BY split, roi)-1)/2.0 AS b FROM evb) SELECT split, count(*) AS bands, round(corr(a,b),6) AS spearman FROM r GROUP BY 1",
    "bt12_ev_crossing": B + ", e AS (SELECT year, round(p_market*odds*1.4,9)>=1 AS a, ev>=1 AS b FROM bets) SELECT year, count(*) AS rows, count(*) FILTER (a) AS base_ge_1, count(*) FILTER (b) AS model_ge_1, count(*) FILTER (NOT a AND b) AS up_crossings, count(*) FILTER (a AND NOT b) AS down_crossings, round(avg(cast(b AS int)),6) AS model_ge_1_rate FROM e GROUP BY 1",
    "bt13_pick_frequency": B + """, t AS (SELECT unnest([0.9,1.0,1.1,1.3,1.6])::double AS threshold) SELECT year, threshold, count(*) AS picks, count(DISTINCT event_date) AS active_days, count(DISTINCT date_trunc('month',event_date)) AS active_months,
 round(count(*)/count(DISTINCT event_date),6) AS picks_per_active_day, round(count(*)/count(DISTINCT date_trunc('month',event_date)),6) AS picks_per_active_month FROM bets JOIN t ON ev>=threshold GROUP BY 1,2""",
    "bt14_stake_methods": P + """, l AS (SELECT split, pay, unnest(['equal_100','three_stage','score_bucketed']) AS stake_method, unnest([100.0, CASE WHEN odds<2 THEN 100.0 WHEN odds<3 THEN 50.0 ELSE 0.0 END, CASE WHEN p_model<=0.33 THEN 50.0 WHEN p_model<=0.66 THEN 100.0 ELSE 150.0 END])::double AS stake FROM picks)
 SELECT split, stake_method, count(*) AS bets, round(sum(stake),4) AS stake, round(sum(pay*stake/100),4) AS return, round(100.0*sum(pay*stake/100)/sum(stake),4) AS roi FROM l WHERE stake>0 GROUP BY 1,2""",
    "bt15_fixed_strategies": B + """, s AS (SELECT *, unnest(['ev_1.0','ev_1.2','odds_2_3','odds_3_up_ev_1.1','all']) AS strategy, unnest([ev>=1.0, ev>=1.2, odds>=2 AND odds<3, odds>=3 AND ev>=1.1, true]) AS m FROM bets) """ + summary("strategy, split", False) + " FROM s WHERE m GROUP BY strategy, split",
    "bt16_confidence_entry": P + CONF + f""", l AS (SELECT pay, unnest(['margin_band','entropy_band']) AS dimension, unnest([{MB},{EB}]) AS value FROM picks JOIN conf USING (contest_id))
 SELECT dimension, value, count(*) AS bets, cast(sum(pay) AS bigint) AS return, count(*) FILTER (pay>0) AS hits, round(100.0*sum(pay)/(100*count(*)),6) AS roi FROM l GROUP BY 1,2""",
    "bt16_confidence_contest": B + CONF + f" SELECT {MB} AS margin_band, count(*) AS contests, round(avg(label),6) AS top1_hit_rate, round(sum(pay)/count(*),6) AS roi FROM conf JOIN bets ON top_entry=entry_id GROUP BY 1",
    "bt17_overlap": B + """, f AS (SELECT pay, ev>=1 AS a, p_alt*odds>=1 AS b FROM bets) SELECT count(*) FILTER (a AND b) AS common_bets, round(avg(pay) FILTER (a AND b),6) AS common_roi, count(*) FILTER (a AND NOT b) AS only_a_bets, round(avg(pay) FILTER (a AND NOT b),6) AS only_a_roi,
 count(*) FILTER (b AND NOT a) AS only_b_bets, round(avg(pay) FILTER (b AND NOT a),6) AS only_b_roi, round(count(*) FILTER (a AND b)/count(*) FILTER (a OR b),6) AS jaccard FROM f""",
    "bt18_segment_cube": P + f""", l AS ({CUBE}), y AS (SELECT axes, values, year, count(*) AS n, sum(pay) AS p FROM l GROUP BY 1,2,3)
 SELECT axes, values, cast(sum(n) AS bigint) AS bets, count(*) AS years_with_bets, min(n) AS min_yearly_bets, round(sum(p)/sum(n),6) AS roi, round(min(p/n),6) AS year_roi_min, sum(n)>=300 AND count(*)>=4 AS sample_pass FROM y GROUP BY 1,2""",
    "bt19_low_odds_bands": B + f", l AS (SELECT *, {band_sql('odds',[1,1.3,1.6,2.0,2.5])} AS odds_band FROM bets WHERE odds<2.5) " + summary("odds_band, year", False) + " FROM l GROUP BY odds_band, year",
}


SQL["bt11_odd_numbers"] = odd_sql(SQL["bt11_ev_band_roi"]).replace("FROM bets GROUP BY 1,2)", "FROM bets WHERE ev IS NOT NULL GROUP BY 1,2)")
SQL["bt12_odd_numbers"] = odd_sql(SQL["bt12_ev_crossing"]).replace("round(p_market*odds*1.4,9)>=1 AS a, ev>=1 AS b", "coalesce(round(p_market*odds*1.4,9)>=1,false) AS a, coalesce(ev>=1,false) AS b")
SQL["bt13_odd_numbers"] = odd_sql(SQL["bt13_pick_frequency"])
