"""Registered queries: probability, ranking, calibration and drift metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.operators import metrics as M
from pitpanel.plans.base import BETS, SCORED, bets, r6, rounded, scored

SPLIT = ["split"]
EPS = 1e-6


def mt1(spark, sf):
    return rounded(M.probability_metrics(bets(spark, sf), SPLIT, "label", "p_model", EPS), "positive_rate", "mean_p", "logloss", "brier")


def mt2(spark, sf):
    return rounded(M.roc_auc(bets(spark, sf), SPLIT, "label", "p_market"), "auc")


def mt3(spark, sf):
    return rounded(M.average_precision(bets(spark, sf), SPLIT, "label", "p_alt"), "average_precision")


def mt4(spark, sf):
    return rounded(M.ece_mce(bets(spark, sf), SPLIT, "label", "p_model"), "ece", "mce")


def mt5(spark, sf):
    return rounded(M.reliability(bets(spark, sf), SPLIT, "label", "p_model"), "mean_p", "actual_rate", "gap")


CUTS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 1.0]


def mt5_cut(spark, sf):
    return rounded(M.reliability_cut(bets(spark, sf), SPLIT, "label", "p_market", CUTS), "mean_p", "actual_rate", "gap")


def mt6_ols(spark, sf):
    return rounded(M.calibration_line_ols(bets(spark, sf), SPLIT, "label", "p_model"), "slope", "intercept")


def mt7(spark, sf):
    return rounded(M.top1_metrics(bets(spark, sf), SPLIT, "contest_id", "entry_id", "label", "p_market"), "top1_accuracy", "top3_hit_rate")


def mt8(spark, sf):
    limit = F.when(F.col("entry_no") <= 2, 0).when(F.col("entry_no") <= 4, 2).otherwise(3)
    d = M.precision_at_limit(bets(spark, sf), SPLIT, "contest_id", "entry_id", "label", "p_model", limit)
    return rounded(d, "precision_at_k", "recall_at_k", "hit_contest_rate")


def mt9(spark, sf):
    return rounded(M.probability_sums(bets(spark, sf), SPLIT, "contest_id", "p_model"), "mean", "median", "std", "min", "max")


def mt10(spark, sf):
    d = scored(spark, sf)
    return rounded(M.mean_contest_spearman(d, [], "contest_id", "p_model", "odds"), "mean_spearman")


def mt11(spark, sf):
    return rounded(M.distribution(bets(spark, sf), SPLIT, "ev"), "mean", "std", "min", "max", *[f"p{int(round(q*100)):02d}" for q in M.PERCENTILES])


def mt11_pop(spark, sf):
    d = bets(spark, sf).withColumn("residual", X.logit(F.col("p_model")) - X.logit(F.col("p_market")))
    return rounded(M.distribution(d, ["year"], "residual", 0, (0.05, 0.5, 0.95)), "mean", "std", "min", "max", "p05", "p50", "p95")


def mt12(spark, sf):
    d = bets(spark, sf).withColumn("odds_band", X.bucketize(F.col("odds"), [1, 2, 3, 4, 10], ["a", "b", "c", "d"], right=False))
    return rounded(M.segment_metrics(d, ["segment", "status", "year", "odds_band"], "label", "p_model", "p_market", 5000),
                   "model_logloss", "market_logloss", "delta_logloss", "delta_brier")


def yearly(spark, sf):
    long = M.long_scores(bets(spark, sf), ["year", "contest_id", "entry_id", "label"], ["p_model", "p_alt", "p_market"])
    return M.probability_metrics(long, ["model", "year"], "label", "p", EPS)


def mt13(spark, sf):
    return rounded(M.cross_year(rounded(yearly(spark, sf), "logloss"), ["model"], "year", "logloss"), "mean", "worst", "best", "std", "cv")


def mt13_pooled(spark, sf):
    long = M.long_scores(bets(spark, sf), ["year", "label"], ["p_model", "p_alt", "p_market"])
    return rounded(M.pooled_and_year_mean(long, "model", "year", "label", "p"), "pooled", "year_mean")


def mt14(spark, sf):
    return M.win_loss_matrix(rounded(yearly(spark, sf), "logloss"), "model", "year", "logloss", "p_market")


def mt15(variant):
    def run(spark, sf):
        d = bets(spark, sf)
        return rounded(M.psi(d, "p_market", F.col("year") <= 1998, 10, variant), "psi")
    return run


def mt16(spark, sf):
    d = bets(spark, sf).withColumn("ev", F.when(F.col("odds") > 1.2, F.col("ev")))
    return rounded(M.drift_by_year(d, "year", ["odds", "p_alt", "ev"]), "mean", "std", "p01", "p50", "p99", "missing_rate")


def mt16_year(spark, sf):
    """Rank correlation of every feature with the year."""
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in ("odds", "p_alt", "p_market")])
    long = bets(spark, sf).select("year", F.inline(items))
    return rounded(M.correlations(long, ["feature"], "value", "year"), "pearson", "spearman")


def mt16_unknown(spark, sf):
    return M.unknown_categories(scored(spark, sf).withColumn("pair", F.concat_ws("-", "part_id", "supp_id")), "year", "pair", 1998)


def mt17(spark, sf):
    return rounded(M.correlations(bets(spark, sf), ["year"], "p_model", "p_market"), "pearson", "spearman")


def mt17_top3(spark, sf):
    return rounded(M.top3_agreement(bets(spark, sf), SPLIT, "contest_id", "entry_id", "p_model", "p_market"), "same_top1_rate", "mean_top3_overlap")


def mt18(spark, sf):
    return M.error_win_loss(bets(spark, sf), ["year"], "contest_id", "label", "p_model", "p_alt")


def mt19(spark, sf):
    d = bets(spark, sf).withColumn("step", F.floor(F.col("p_alt") * 40) / 40.0)
    return rounded(M.output_steps(d, SPLIT, "step"), "largest_step")


def mt20(spark, sf):
    return M.invalid_probabilities(bets(spark, sf).withColumn("x", F.col("ev") - 0.5), "x")


def mt21(spark, sf):
    band = X.bucketize(F.col("odds"), [1, 1.5, 2, 3, 5, 10], right=False)
    long = M.long_scores(bets(spark, sf).withColumn("odds_band", band), ["odds_band", "label"], ["p_model", "p_market"])
    return rounded(M.probability_metrics(long, ["odds_band", "model"], "label", "p").select("odds_band", "model", "rows", "positive_rate", "mean_p"), "positive_rate", "mean_p")


def mt22(spark, sf):
    d = M.same_sample_comparison(bets(spark, sf), "split", "contest_id", "entry_id", "label", ["p_model", "p_alt", "p_market"])
    return rounded(d, "positive_rate", "mean_p", "logloss", "brier", "top1_accuracy", "top3_hit_rate", "sum_mean", "sum_min", "sum_max")


def mt23(spark, sf):
    """Metrics recomputed from rows against the same metrics derived from per-year sums."""
    direct = M.probability_metrics(bets(spark, sf), SPLIT, "label", "p_model", EPS)
    by_year = M.probability_metrics(bets(spark, sf), ["split", "year"], "label", "p_model", EPS)
    stored = by_year.groupBy("split").agg(*[(F.sum(F.col(m) * F.col("rows")) / F.sum("rows")).alias(m) for m in ("logloss", "brier")])
    return rounded(M.recheck(direct, stored, SPLIT, ["logloss", "brier"], 1e-9), "logloss_diff", "brier_diff")


QUERIES = {
    "mt1_logloss_brier": mt1, "mt2_roc_auc": mt2, "mt3_average_precision": mt3, "mt4_ece_mce": mt4, "mt5_reliability": mt5,
    "mt5_reliability_cut": mt5_cut, "mt6_calibration_line_ols": mt6_ols, "mt7_top1_accuracy": mt7, "mt8_precision_at_k": mt8, "mt9_probability_sums": mt9,
    "mt10_contest_spearman": mt10, "mt11_distribution": mt11, "mt11_residual_distribution": mt11_pop, "mt12_segment_metrics": mt12,
    "mt13_cross_year": mt13, "mt13_pooled_vs_year_mean": mt13_pooled, "mt14_win_loss_matrix": mt14, "mt15_psi_open": mt15("open"),
    "mt15_psi_closed": mt15("closed"), "mt16_drift_by_year": mt16, "mt16_unknown_categories": mt16_unknown, "mt16_year_correlation": mt16_year, "mt17_correlations": mt17,
    "mt17_top3_agreement": mt17_top3, "mt18_error_win_loss": mt18, "mt19_output_steps": mt19, "mt20_probability_guard": mt20,
    "mt21_odds_band_calibration": mt21, "mt22_same_sample_comparison": mt22, "mt23_recheck": mt23,
}
B = f"WITH {BETS} "


def ll(y, p, e="1e-6"):
    q = f"greatest({e},least(1.0-{e},{p}))"
    return f"(CASE WHEN {y}=1 THEN -ln({q}) ELSE -ln(1.0-{q}) END)"


def pm(p, by):
    return (f"{by}, count(*) AS rows, cast(sum(label) AS bigint) AS positives, round(avg(label),6) AS positive_rate, round(avg({p}),6) AS mean_p, "
            f"round(avg({ll('label', p)}),6) AS logloss, round(avg(({p}-label)*({p}-label)),6) AS brier")


BIN = "least(cast(" + "+".join(f"cast(p_model>={i/10} AS int)" for i in range(1, 10)) + " AS int),9)"
REL = BETS + f", rel AS (SELECT split, {BIN} AS bin, count(*) AS rows, avg(p_model) AS mp, avg(label) AS ar, abs(avg(p_model)-avg(label)) AS gap FROM bets GROUP BY 1,2)"
LONG = BETS + ", long AS (SELECT * EXCLUDE(p_model,p_alt,p_market), unnest(['p_model','p_alt','p_market']) AS model, unnest([p_model,p_alt,p_market]) AS p FROM bets)"
TOP = "row_number() OVER (PARTITION BY {k} contest_id ORDER BY {p} DESC, entry_id) AS rn"


def top1(frame, by, p):
    parts = "".join(f"{b}, " for b in by)
    return (f"(SELECT {parts} count(*) AS contests, round(avg(h1),6) AS top1_accuracy, count(*) FILTER (p1=p2) AS tied_contests, round(avg(h3),6) AS top3_hit_rate FROM ("
            f"SELECT {parts} contest_id, max(label) FILTER (rn=1) AS h1, max(label) FILTER (rn<=3) AS h3, max({p}) FILTER (rn=1) AS p1, max({p}) FILTER (rn=2) AS p2 FROM "
            f"(SELECT *, {TOP.format(k=parts, p=p)} FROM {frame}) GROUP BY {parts} contest_id) GROUP BY {', '.join(by)})")


def avgrank(v, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1)/2.0)"


def psi_sql(variant):
    inner = "list_slice(e, 2, len(e)-1)"
    where = "" if variant == "open" else "WHERE v >= e[1] AND v <= e[-1]"
    a, c = "nr/sum(nr) OVER ()", "nc/sum(nc) OVER ()"
    term = "(c-a)*ln((c+1e-6)/(a+1e-6))" if variant == "open" else "(greatest(c,1e-6)-greatest(a,1e-6))*ln(greatest(c,1e-6)/greatest(a,1e-6))"
    return B + f""", e0 AS (SELECT quantile_cont(p_market,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]) AS q FROM bets WHERE year<=1998),
 e1 AS (SELECT list_sort(list_distinct(q)) AS e FROM e0), d AS (SELECT p_market AS v, year<=1998 AS r, e FROM bets, e1),
 h AS (SELECT len(list_filter({inner}, lambda x: v >= x)) AS b, count(*) FILTER (r) AS nr, count(*) FILTER (NOT r) AS nc FROM d {where} GROUP BY 1),
 s AS (SELECT {a} AS a, {c} AS c FROM h), t AS (SELECT sum({term}) AS psi FROM s)
 SELECT round(psi,6) AS psi, CASE WHEN psi>=0.25 THEN 'SEVERE_SHIFT' WHEN psi>=0.10 THEN 'MODERATE_SHIFT' ELSE 'OK' END AS status FROM t"""


YEARLY = LONG + f", yearly AS (SELECT model, year, round(avg({ll('label','p')}),6) AS logloss FROM long GROUP BY 1,2)"
_D = "round(avg({v}),6) AS mean, round({s}({v}),6) AS std, round(min({v}),6) AS min, round(max({v}),6) AS max"
OB = "CASE WHEN odds>=1 AND odds<2 THEN 'a' WHEN odds>=2 AND odds<3 THEN 'b' WHEN odds>=3 AND odds<4 THEN 'c' WHEN odds>=4 AND odds<10 THEN 'd' ELSE '(none)' END"
SQL = {
    "mt1_logloss_brier": B + f"SELECT {pm('p_model','split')} FROM bets GROUP BY split",
    "mt2_roc_auc": B + f", r AS (SELECT split, label, {avgrank('p_market','split')} AS k FROM bets) SELECT split, round((sum(k) FILTER (label=1) - cast(sum(label) AS double)*(sum(label)+1)/2)/(cast(sum(label) AS double)*(count(*)-sum(label))),6) AS auc FROM r GROUP BY 1",
    "mt3_average_precision": B + """, h AS (SELECT split, p_alt, sum(label) AS pos, count(*) AS n FROM bets GROUP BY 1,2), c AS (SELECT split, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM h WINDOW w AS (PARTITION BY split ORDER BY p_alt DESC))
 SELECT split, round(sum(cast(pos AS double)*cp/cn)/sum(pos),6) AS average_precision FROM c GROUP BY 1""",
    "mt4_ece_mce": f"WITH {REL} SELECT split, round(sum(rows*gap)/sum(rows),6) AS ece, round(max(gap),6) AS mce FROM rel GROUP BY 1",
    "mt5_reliability": f"WITH {REL} SELECT split, bin, rows, round(mp,6) AS mean_p, round(ar,6) AS actual_rate, round(gap,6) AS gap FROM rel",
    "mt5_reliability_cut": B + "SELECT split, CASE " + " ".join(
        f"WHEN round(p_market,12){'>=' if i == 0 else '>'}{CUTS[i]} AND round(p_market,12)<={CUTS[i+1]} THEN '({CUTS[i]:g},{CUTS[i+1]:g}]'" for i in range(6)) +
        " ELSE '(none)' END AS band, count(*) AS rows, round(avg(p_market),6) AS mean_p, round(avg(label),6) AS actual_rate, round(avg(label)-avg(p_market),6) AS gap FROM bets GROUP BY 1,2",
    "mt6_calibration_line_ols": B + ", z AS (SELECT split, label, ln(greatest(1e-6,least(1.0-1e-6,p_model))/(1.0-greatest(1e-6,least(1.0-1e-6,p_model)))) AS z FROM bets) SELECT split, round(regr_slope(label,z),6) AS slope, round(regr_intercept(label,z),6) AS intercept FROM z GROUP BY 1",
    "mt7_top1_accuracy": B + "SELECT * FROM " + top1("bets", ["split"], "p_market"),
    "mt8_precision_at_k": B + """, b AS (SELECT *, max(CASE WHEN entry_no<=2 THEN 0 WHEN entry_no<=4 THEN 2 ELSE 3 END) OVER (PARTITION BY split, contest_id) AS k, row_number() OVER (PARTITION BY split, contest_id ORDER BY p_model DESC, entry_id) AS rn FROM bets),
 c AS (SELECT split, contest_id, max(k) AS k, sum(label) AS actual, coalesce(sum(label) FILTER (rn<=k),0) AS hits FROM b WHERE k>0 GROUP BY 1,2)
 SELECT split, count(*) AS contests, round(avg(hits/k),6) AS precision_at_k, round(avg(hits/nullif(actual,0)),6) AS recall_at_k, round(avg(cast(hits>0 AS int)),6) AS hit_contest_rate FROM c GROUP BY 1""",
    "mt9_probability_sums": B + ", s AS (SELECT split, contest_id, sum(p_model) AS s FROM bets GROUP BY 1,2) SELECT split, round(median(s),6) AS median, " + _D.format(v="s", s="stddev_samp") + " FROM s GROUP BY 1",
    "mt10_contest_spearman": f"WITH {SCORED}, r AS (SELECT contest_id, {avgrank('p_model','contest_id')} AS a, {avgrank('odds','contest_id')} AS b FROM scored), c AS (SELECT contest_id, CASE WHEN min(a)<>max(a) AND min(b)<>max(b) THEN corr(a,b) END AS s FROM r GROUP BY 1) SELECT round(avg(s),6) AS mean_spearman, count(s) AS contests_with_variation FROM c",
    "mt11_distribution": B + "SELECT split, count(ev) AS n, " + _D.format(v="ev", s="stddev_samp") + ", " + ", ".join(f"round(quantile_cont(ev,{q}),6) AS p{int(round(q*100)):02d}" for q in M.PERCENTILES) + " FROM bets GROUP BY 1",
    "mt11_residual_distribution": B + ", z AS (SELECT year, ln(p_model/(1.0-p_model)) - ln(least(p_market,1.0-1e-6)/(1.0-least(p_market,1.0-1e-6))) AS r FROM bets) SELECT year, count(r) AS n, " + _D.format(v="r", s="stddev_pop") + ", " + ", ".join(f"round(quantile_cont(r,{q}),6) AS p{int(round(q*100)):02d}" for q in (0.05, 0.5, 0.95)) + " FROM z GROUP BY 1",
    "mt12_segment_metrics": B + f""", l AS (SELECT label, p_model, p_market, unnest(['segment','status','year','odds_band']) AS segment, unnest([segment, status, cast(year AS varchar), {OB}]) AS value FROM bets)
 SELECT segment, value, count(*) AS rows, round(avg({ll('label','p_model')}),6) AS model_logloss, round(avg({ll('label','p_market')}),6) AS market_logloss,
 round(avg({ll('label','p_model')})-avg({ll('label','p_market')}),6) AS delta_logloss, round(avg((p_model-label)**2)-avg((p_market-label)**2),6) AS delta_brier, count(*)<5000 AS small_sample FROM l GROUP BY 1,2""",
    "mt13_cross_year": f"WITH {YEARLY} SELECT model, round(avg(logloss),6) AS mean, round(max(logloss),6) AS worst, round(min(logloss),6) AS best, round(stddev_pop(logloss),6) AS std, round(stddev_pop(logloss)/avg(logloss),6) AS cv, arg_max(year, logloss*1000000-year*1e-6) AS worst_year FROM yearly GROUP BY 1",
    "mt13_pooled_vs_year_mean": f"WITH {LONG}, y AS (SELECT model, year, sum({ll('label','p')}) AS s, count(*) AS n FROM long GROUP BY 1,2) SELECT model, round(sum(s)/sum(n),6) AS pooled, round(avg(s/n),6) AS year_mean, cast(sum(n) AS bigint) AS rows FROM y GROUP BY 1",
    "mt14_win_loss_matrix": f"WITH {YEARLY} SELECT a.model, count(*) FILTER (a.logloss<b.logloss) AS wins, count(*) FILTER (a.logloss>b.logloss) AS losses, count(*) FILTER (a.logloss=b.logloss) AS ties, arg_max(a.year, a.logloss*1000000-a.year*1e-6) AS worst_year FROM yearly a JOIN yearly b ON a.year=b.year AND b.model='p_market' WHERE a.model<>'p_market' GROUP BY 1",
    "mt15_psi_open": psi_sql("open"), "mt15_psi_closed": psi_sql("closed"),
    "mt16_drift_by_year": B + """, l AS (SELECT year, unnest(['odds','p_alt','ev']) AS "column", unnest([odds, p_alt, CASE WHEN odds>1.2 THEN ev END]) AS v FROM bets)
 SELECT "column", year, count(*) AS rows, count(*)-count(v) AS missing, count(DISTINCT v) AS distinct_values, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS std,
 round(quantile_cont(v,0.01),6) AS p01, round(quantile_cont(v,0.5),6) AS p50, round(quantile_cont(v,0.99),6) AS p99, round((count(*)-count(v))/count(*),6) AS missing_rate FROM l GROUP BY 1,2""",
    "mt16_unknown_categories": f"WITH {SCORED}, p AS (SELECT year, part_id||'-'||supp_id AS pair FROM scored) SELECT year, count(*) AS rows, count(*) FILTER (pair NOT IN (SELECT pair FROM p WHERE year<=1998)) AS unknown FROM p WHERE year>1998 GROUP BY 1",
    "mt16_year_correlation": B + f", l AS (SELECT year, unnest(['odds','p_alt','p_market']) AS feature, unnest([odds, p_alt, p_market]) AS value FROM bets), r AS (SELECT feature, value, year, {avgrank('value','feature')} AS a, {avgrank('year','feature')} AS b FROM l) SELECT feature, count(*) AS rows, round(corr(value,year),6) AS pearson, round(corr(a,b),6) AS spearman FROM r GROUP BY 1",
    "mt17_correlations": B + f", r AS (SELECT year, p_model, p_market, {avgrank('p_model','year')} AS a, {avgrank('p_market','year')} AS b FROM bets) SELECT year, count(*) AS rows, round(corr(p_model,p_market),6) AS pearson, round(corr(a,b),6) AS spearman FROM r GROUP BY 1",
    "mt17_top3_agreement": B + f""", r AS (SELECT split, contest_id, entry_id, row_number() OVER (PARTITION BY split, contest_id ORDER BY p_model DESC, entry_id) AS a, row_number() OVER (PARTITION BY split, contest_id ORDER BY p_market DESC, entry_id) AS b FROM bets),
 c AS (SELECT split, contest_id, count(*) FILTER (a<=3 AND b<=3) AS o, count(*) FILTER (a=1 AND b=1) AS s FROM r GROUP BY 1,2) SELECT split, count(*) AS contests, round(avg(s),6) AS same_top1_rate, round(avg(o),6) AS mean_top3_overlap FROM c GROUP BY 1""",
    "mt18_error_win_loss": B + f""", d AS (SELECT year, contest_id, {ll('label','p_model','1e-15')}-{ll('label','p_alt','1e-15')} AS d FROM bets), c AS (SELECT year, contest_id, avg(d) AS m, count(*) FILTER (d<0) AS ra, count(*) FILTER (d>0) AS rb, count(*) FILTER (abs(d)<=1e-8) AS rt FROM d GROUP BY 1,2)
 SELECT year, cast(sum(ra) AS bigint) AS a_better_rows, cast(sum(rb) AS bigint) AS b_better_rows, cast(sum(rt) AS bigint) AS tie_rows, count(*) FILTER (m<0) AS a_better_contests, count(*) FILTER (m>0) AS b_better_contests, count(*) FILTER (abs(m)<=1e-8) AS tie_contests FROM c GROUP BY 1""",
    "mt19_output_steps": B + """, h AS (SELECT split, floor(p_alt*40)/40.0 AS p, count(*) AS n FROM bets GROUP BY 1,2), l AS (SELECT *, p-lag(p) OVER (PARTITION BY split ORDER BY p) AS d FROM h)
 SELECT split, count(*) AS distinct_outputs, round(max(d),6) AS largest_step, max(n) AS largest_plateau, cast(coalesce(sum(n) FILTER (p<=0.01),0) AS bigint) AS at_or_below_001, cast(coalesce(sum(n) FILTER (p>=0.99),0) AS bigint) AS at_or_above_099 FROM l GROUP BY 1""",
    "mt20_probability_guard": B + "SELECT count(*) FILTER (ev-0.5<0 OR ev-0.5>1) AS invalid, count(*) AS rows FROM bets",
    "mt21_odds_band_calibration": B + """, l AS (SELECT CASE WHEN odds>=1 AND odds<1.5 THEN '[1,1.5)' WHEN odds>=1.5 AND odds<2 THEN '[1.5,2)' WHEN odds>=2 AND odds<3 THEN '[2,3)' WHEN odds>=3 AND odds<5 THEN '[3,5)' WHEN odds>=5 AND odds<10 THEN '[5,10)' ELSE '(none)' END AS odds_band,
 label, unnest(['p_model','p_market']) AS model, unnest([p_model,p_market]) AS p FROM bets) SELECT odds_band, model, count(*) AS rows, round(avg(label),6) AS positive_rate, round(avg(p),6) AS mean_p FROM l GROUP BY 1,2""",
    "mt22_same_sample_comparison": f"WITH {LONG}, a AS (SELECT {pm('p','split, model')} FROM long GROUP BY split, model), b AS (SELECT * FROM {top1('long', ['split','model'], 'p')}), c AS (SELECT split, model, round(avg(s),6) AS sum_mean, round(min(s),6) AS sum_min, round(max(s),6) AS sum_max FROM (SELECT split, model, contest_id, sum(p) AS s FROM long GROUP BY 1,2,3) GROUP BY 1,2) SELECT * FROM a JOIN b USING (split, model) JOIN c USING (split, model)",
    "mt23_recheck": B + f""", d AS (SELECT split, avg({ll('label','p_model')}) AS l, avg((p_model-label)*(p_model-label)) AS b FROM bets GROUP BY 1),
 y AS (SELECT split, year, avg({ll('label','p_model')}) AS l, avg((p_model-label)*(p_model-label)) AS b, count(*) AS n FROM bets GROUP BY 1,2),
 s AS (SELECT split, sum(l*n)/sum(n) AS l, sum(b*n)/sum(n) AS b FROM y GROUP BY 1)
 SELECT split, round(abs(d.l-s.l),6)+0.0 AS logloss_diff, round(abs(d.b-s.b),6)+0.0 AS brier_diff, greatest(abs(d.l-s.l),abs(d.b-s.b))<=1e-9 AS ok FROM d JOIN s USING (split)""",
}
