"""Registered queries: folds, models, calibration, parity, manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import stored_if_large
from pitpanel.operators import backtest as K
from pitpanel.operators import features as T
from pitpanel.operators import folds as FO
from pitpanel.operators import grouped as G
from pitpanel.operators import manifest as MF
from pitpanel.operators import metrics as M
from pitpanel.operators import models as MO
from pitpanel.plans import sql_fits as Q
from pitpanel.plans.base import BETS, SCORED, bets, r6, rounded, scored
from pitpanel.sources.workdir import materialise

YEARS = [1998, 1999, 2000]


def folds():
    return ([FO.fold_window("expanding", "expanding", 1995, y) for y in YEARS] + [FO.fold_window("rolling_2y", "rolling", 1995, y, 2) for y in YEARS]
            + [FO.fold_window("legacy", "legacy", 1996, y) for y in YEARS])


def base(spark, sf):
    """Feature frame of the models: odds missing on one segment of popularity, two scores, a category."""
    return bets(spark, sf).withColumns({"odds_log": F.when(F.col("entry_no") < 7, F.log("odds")), "gap": F.col("p_model") - F.col("p_market")})


COLS = ["odds_log", "p_alt"]


def ts1(spark, sf):
    d = FO.tag_folds(scored(spark, sf).select("year", "label"), "year", folds())
    return d.groupBy("strategy", "validation_year", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"), F.min("year").alias("first"), F.max("year").alias("last"))


def ts2(spark, sf):
    d = base(spark, sf)
    b = G.baselines(d, G.members(spark, {"train": ["train"]}, "string"), COLS, "label", part="split")
    return rounded(M.probability_metrics(G.with_fit(d, b, COLS, "p_base"), ["split"], "label", "p_base"), "positive_rate", "mean_p", "logloss", "brier")


def ts3(spark, sf):
    """Every year of the data is scored by the years before it, the first one by the heuristic."""
    d = base(spark, sf)
    m = materialise(G.forward_members(d.select(F.col("year").alias("part"))), "years")
    b = G.baselines(d, m, COLS, "label", part="year")
    own = m.select("fit", F.col("own").alias("_year")).distinct()
    first = X.heuristic_prior(F.col("odds"), F.lit(1), F.lit(3))
    j = d.join(F.broadcast(own.join(b, "fit")), F.col("year") == F.col("_year"), "left")  # one row per year
    out = j.withColumn("p_base", F.coalesce(X.clip(X.sigmoid(G.linear(COLS))), first)).withColumn("source", F.when(F.col("fit").isNull(), "heuristic").otherwise("out_of_fold"))
    return rounded(M.probability_metrics(out, ["year", "source"], "label", "p_base"), "positive_rate", "mean_p", "logloss", "brier")


def ts4(spark, sf):
    """All nine folds: in-sample on the training years, out-of-sample on the validation year."""
    d = base(spark, sf).select("year", "label", *COLS)
    m = G.members(spark, {FO.fold_name(f): range(f.train_start, f.train_end + 1) for f in folds()})
    out = FO.tag_folds(d, "year", folds()).withColumn("fit", FO.fold_key()).join(F.broadcast(G.baselines(d, m, COLS, "label", part="year")), "fit")
    out = out.withColumn("p_base", X.clip(X.sigmoid(G.linear(COLS)))).withColumn("provenance", F.when(F.col("part") == "validation", "out_of_sample").otherwise("in_sample"))
    return rounded(M.probability_metrics(out, ["strategy", "validation_year", "part", "provenance"], "label", "p_base"), "positive_rate", "mean_p", "logloss", "brier")


def ts5(spark, sf):
    d = base(spark, sf).withColumn("offset", X.logit(F.col("p_market")))
    w = T.decay_weights(d.filter("split = 'train'"), F.lit(1999) - F.col("year"), 3.0)
    m = MO.fit_offset(w, ["gap", "p_alt", "odds_log"], "label", "offset", "weight")
    out = MO.apply_offset(d, m, "offset")
    check = out.groupBy("split").agg(F.max(F.abs(F.col("final_logit") - (F.col("offset") + F.col("residual")))).alias("identity_error"))
    return rounded(M.probability_metrics(out, ["split"], "label", "final_probability").join(check, "split"), "positive_rate", "mean_p", "logloss", "brier", "identity_error")


def ts6(kind):
    def run(spark, sf):
        # every stage of the fit reads the training rows again
        d = stored_if_large(base(spark, sf).select("split", "status", "label", "odds_log", "p_model", "p_alt"), "classifier-rows")
        m = MO.fit_classifier(d.filter("split = 'train'"), ["odds_log", "p_model", "p_alt"], ["status"], "label", kind)
        out = MO.predict(m, d, ["split"], ["odds_log", "p_model", "p_alt"], ["status"], "label")
        return rounded(M.probability_metrics(out, ["split"], "actual", "pred_probability"), "positive_rate", "mean_p", "logloss", "brier")
    return run


SETS = {"free": ["p_model", "p_alt"], "market": ["odds_log"], "all": ["p_model", "p_alt", "odds_log"]}


def ts6_grid(spark, sf):
    """Two targets x three feature sets x every split; the second target leaves out entries that are not eligible."""
    d = base(spark, sf).withColumn("high", F.when(F.col("entry_no") <= 5, (F.col("pay") >= 250).cast("int")))
    out = MO.classifier_grid(d, {"win": "label", "high": "high"}, SETS, "split", "train")
    return rounded(out, "positive_rate", "mean_p", "logloss", "brier")


def ts7(spark, sf):
    """All calibrators fitted on the training split, on exact scores, applied to every split."""
    hist = materialise(G.histogram(bets(spark, sf), F.col("split"), "label", "p_market"), "scores")
    fitted = G.calibrators(hist, G.members(spark, {"train": ["train"]}, "string"))
    own = hist.select(F.lit("train").alias("fit"), "part").distinct()
    t = G.weighted_metrics(G.scored_histogram(hist, own, fitted), ["method", "part"]).withColumnsRenamed({"method": "calibration_method", "part": "split"})
    return rounded(t, "positive_rate", "mean_p", "logloss", "brier", "ece", "mce")


def yearly_scores(spark, sf, p="p_market"):
    return materialise(G.histogram(bets(spark, sf), F.col("year"), "label", p), "scores")


def ts8(spark, sf):
    """Walk-forward calibration of every year after the first; pooled log-loss, Brier and ECE choose the method."""
    d = G.walk_forward(yearly_scores(spark, sf))
    t = G.marked(G.weighted_metrics(d, ["method"]).select("method", "rows", "logloss", "brier", "ece"), ["logloss", "brier", "ece", "method"])
    return rounded(t.withColumnRenamed("method", "calibration_method"), "logloss", "brier", "ece")


def ts8_by_year(spark, sf):
    t = G.weighted_metrics(G.walk_forward(yearly_scores(spark, sf, "p_model")), ["part", "method"]).withColumnsRenamed({"part": "year", "method": "calibration_method"})
    return rounded(t, "positive_rate", "mean_p", "logloss", "brier", "ece", "mce")


def ts8_leave_one_out(spark, sf):
    t = G.leave_one_out_choice(G.weighted_metrics(G.leave_one_out(yearly_scores(spark, sf)), ["part", "method"]))
    return rounded(t.withColumnRenamed("method", "calibration_method"), "mean_logloss", "mean_brier", "mean_ece", "worst_ece", "std_logloss")


def ts8_nested_forward(spark, sf):
    t = G.forward_choice(G.weighted_metrics(G.walk_forward(yearly_scores(spark, sf)), ["part", "method"]))
    return rounded(t.withColumnRenamed("method", "calibration_method"), "mean_logloss", "mean_brier", "mean_ece", "high_mce", "score")


def ts9(spark, sf):
    """Every feature group dropped in turn, all nine folds refitted in the same rounds."""
    d = base(spark, sf).select("year", "label", "gap", "p_alt", "odds_log", X.logit(F.col("p_market")).alias("offset"))
    out = MO.ablation(d, {"scores": ["gap"], "alt": ["p_alt"], "odds": ["odds_log"]}, folds(), "year", "label", "offset")
    return rounded(out, "positive_rate", "mean_p", "logloss", "brier")


def ts11(spark, sf):
    """Champion against challenger: log-loss, agreement, bet overlap and ROI in one table."""
    d = bets(spark, sf).filter("split in ('test', 'latest_holdout')")
    a = M.probability_metrics(d, ["split"], "label", "p_model").select("split", F.col("logloss").alias("champion_logloss"), F.col("brier").alias("champion_brier"))
    b = M.probability_metrics(d, ["split"], "label", "p_alt").select("split", F.col("logloss").alias("challenger_logloss"), F.col("brier").alias("challenger_brier"))
    g = M.top3_agreement(d, ["split"], "contest_id", "entry_id", "p_model", "p_alt").select("split", "same_top1_rate", "mean_top3_overlap")
    x, y = F.col("p_model") * F.col("odds") >= 1.0, F.col("p_alt") * F.col("odds") >= 1.0
    o = d.groupBy("split").agg(F.count_if(x & y).alias("common_bets"), F.count_if(x & ~y).alias("champion_only"), F.count_if(y & ~x).alias("challenger_only"),
                               F.avg(F.when(x, F.col("pay"))).alias("champion_roi"), F.avg(F.when(y, F.col("pay"))).alias("challenger_roi"))
    return rounded(a.join(b, "split").join(g, "split").join(o, "split"), "champion_logloss", "champion_brier", "challenger_logloss", "challenger_brier", "same_top1_rate", "mean_top3_overlap", "champion_roi", "challenger_roi")


def ts12(spark, sf):
    d = bets(spark, sf)
    a = d.filter("segment <> 'N'").select("contest_id", "entry_id", "label", F.col("p_market").alias("p"))
    b = d.filter("segment <> 'A'").select("contest_id", "entry_id", "label", (F.col("p_market") * 0.999).alias("p"))
    same = MO.parity_gate(a, a, ["contest_id", "entry_id"], "label", "p", 1e-9).withColumn("pair", F.lit("same"))
    other = MO.parity_gate(a, b, ["contest_id", "entry_id"], "label", "p", 1e-9).withColumn("pair", F.lit("other"))
    return rounded(same.unionByName(other), "max_diff", "mean_diff", "logloss_diff")


def tb7(spark, sf):
    d = scored(spark, sf).select("year", "entry_id", "pay")
    a = MF.fingerprint(d, ["year"])
    b = MF.fingerprint(d.orderBy(F.col("entry_id").desc()), ["year"]).withColumnsRenamed({"rows": "rows_b", "hash_sum": "sum_b", "hash_xor": "xor_b"})
    return a.join(b, "year").select("year", "rows", ((F.col("hash_sum") == F.col("sum_b")) & (F.col("hash_xor") == F.col("xor_b"))).alias("order_independent"))


DEPTH = 2


def edited(spark, sf):
    """The scored table and a later version of it: payouts of one contest raised, one contest lost, one entry renamed."""
    old = scored(spark, sf).select("entry_id", "contest_id", "odds", "pay")
    new = old.filter("contest_id <> 7").withColumns({"pay": F.when(F.col("contest_id") == 3, F.col("pay") + 10).otherwise(F.col("pay")),
                                                     "entry_id": F.when((F.col("contest_id") == 5), F.concat(F.col("entry_id"), F.lit("x"))).otherwise(F.col("entry_id"))})
    return old, new


def tb7_tree(spark, sf):
    """Digests of all ranges, two levels deep."""
    return MF.digest_tree(edited(spark, sf)[1], ["entry_id"], ["contest_id", "pay"], DEPTH)


def tb7_ranges(spark, sf):
    """Ranges of the key hash that an edit touched, found by descending from the root."""
    old, new = [MF.digest_tree(d, ["entry_id"], ["contest_id", "pay"], DEPTH) for d in edited(spark, sf)]
    return MF.differing_ranges(old, new, DEPTH)


def tb7_keys(spark, sf):
    """Entries that an edit touched, read from the differing ranges only."""
    old, new = edited(spark, sf)
    return MF.changed_keys(old, new, ["entry_id"], ["contest_id", "pay"], tb7_ranges(spark, sf), DEPTH)


def tb8(spark, sf):
    d = scored(spark, sf).select("year", "entry_id", "pay")
    old = MF.fingerprint(d.filter("year <> 2001").withColumn("pay", F.when((F.col("year") == 1998) & (F.col("pay") == 0), F.lit(1)).otherwise(F.col("pay"))), ["year"])
    return MF.stale_partitions(MF.fingerprint(d, ["year"]), old, "year")


def mt6(spark, sf):
    return rounded(G.calibration_lines(bets(spark, sf), ["split"], "label", "p_model"), "slope", "intercept")


def mt6_by_year(spark, sf):
    return rounded(G.calibration_lines(bets(spark, sf), ["year", "status"], "label", "p_model"), "slope", "intercept")


QUERIES = {
    "ts1_fold_windows": ts1, "ts2_logistic_baseline": ts2, "ts3_expanding_oof": ts3, "ts4_fold_baseline": ts4, "ts5_offset_model": ts5, "ts6_classifier_logistic": ts6("logistic"),
    "ts6_classifier_trees": ts6("trees"), "ts6_classifier_grid": ts6_grid, "ts7_calibrators": ts7, "ts8_walk_forward_calibration": ts8, "ts9_ablation": ts9, "ts11_champion_challenger": ts11, "ts12_parity_gate": ts12,
    "tb7_fingerprint": tb7, "tb7_digest_tree": tb7_tree, "tb7_differing_ranges": tb7_ranges, "tb7_changed_keys": tb7_keys, "tb8_stale_partitions": tb8, "mt6_calibration_slope": mt6, "mt6_calibration_slope_by_year": mt6_by_year, "ts8_walk_forward_by_year": ts8_by_year, "ts8_leave_one_fold_out": ts8_leave_one_out,
    "ts8_nested_forward": ts8_nested_forward,
}


def ll(y, p, e="1e-6"):
    q = f"greatest({e},least(1.0-{e},{p}))"
    return f"(CASE WHEN {y}=1 THEN -ln({q}) ELSE -ln(1.0-{q}) END)"


W, B = f"WITH {SCORED} ", f"WITH {BETS} "
_F = [("expanding", 1995, None), ("rolling_2y", 1995, 2), ("legacy", 1996, None)]
_FV = ",".join(f"('{n}',{y},{max(s, y - r) if r else s},{y - 1})" for n, s, r in _F for y in YEARS)
_FM = ",".join(f"('{n}-{y}',{t})" for n, st, r in _F for y in YEARS for t in range(max(st, y - r) if r else st, y))
R = f"WITH RECURSIVE {BETS} "
MODEL_ROWS = "feats AS (SELECT *, CASE WHEN entry_no < 7 THEN ln(odds) END AS odds_log, p_model - p_market AS gap FROM bets)"
FORWARD = "ys AS (SELECT DISTINCT year FROM bets), fwd AS (SELECT 'f' || a.year AS fit, a.year AS own, b.year AS part FROM ys a JOIN ys b ON b.year < a.year), others AS (SELECT 'o' || a.year AS fit, a.year AS own, b.year AS part FROM ys a JOIN ys b ON b.year <> a.year)"
METRICS = "count(*) AS rows, cast(sum(label) AS bigint) AS positives, round(avg(label),6) AS positive_rate, round(avg({p}),6) AS mean_p, round(avg({l}),6) AS logloss, round(avg(({p}-label)**2),6) AS brier"
ROUNDED = "round(positive_rate,6) AS positive_rate, round(mean_p,6) AS mean_p, round(logloss,6) AS logloss, round(brier,6) AS brier"


def scored_hist(part, p):
    return f"hist AS MATERIALIZED (SELECT {part} AS part, {p} AS p, cast(count(*) AS double) AS n, cast(sum(label) AS double) AS y FROM bets GROUP BY 1, 2)"


def base_rows(part, *xs, o="0.0e0", w="1.0e0"):
    return f"fr AS (SELECT {part} AS part, label, cast(label AS double) AS y, {w} AS w, {o} AS o, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(xs, 1)) + ", * EXCLUDE (label) FROM feats)"


def line_rows(part, source="bets"):
    q = "greatest(1e-6,least(1-1e-6,p_model))"
    return f"lr AS (SELECT part, x1, y, w, 0.0e0 AS o FROM (SELECT {part} AS part, ln({q}/(1-{q})) AS x1, cast(label AS double) AS y, cast(count(*) AS double) AS w FROM {source} GROUP BY 1, 2, 3)), lm AS (SELECT DISTINCT part AS fit, part FROM lr)"


def pm(p):
    return METRICS.format(p=p, l=ll("label", p))


TOP = "row_number() OVER (PARTITION BY split, contest_id ORDER BY {p} DESC, entry_id)"
EDITED = """old AS (SELECT entry_id, contest_id, odds, pay FROM scored), new AS (SELECT CASE WHEN contest_id=5 THEN entry_id||'x' ELSE entry_id END AS entry_id, contest_id, odds, CASE WHEN contest_id=3 THEN pay+10 ELSE pay END AS pay FROM old WHERE contest_id<>7)"""
_TEXT = "length(entry_id)||':'||entry_id"
TREES = f"""sides AS (SELECT 'old' AS side, * FROM old UNION ALL SELECT 'new', * FROM new), lines AS (SELECT side, md5({_TEXT}) AS k, ('0x'||substr(md5({_TEXT}||length(cast(contest_id AS varchar))||':'||contest_id||length(cast(pay AS varchar))||':'||pay),1,12))::bigint AS h FROM sides),
 tree AS (SELECT side, level::int AS level, substr(k,1,level::int) AS range, count(*) AS rows, cast(sum(h) AS varchar) AS digest FROM lines, range({DEPTH + 1}) t(level) GROUP BY 1,2,3)"""
SQL = {
    "ts1_fold_windows": W + f", f(strategy, validation_year, a, b) AS (VALUES {_FV}) SELECT strategy, validation_year, CASE WHEN year=validation_year THEN 'validation' ELSE 'train' END AS part, count(*) AS rows, cast(sum(label) AS bigint) AS positives, min(year) AS first, max(year) AS last FROM scored JOIN f ON year BETWEEN a AND b OR year=validation_year GROUP BY 1,2,3",
    "ts11_champion_challenger": B + f""", r AS (SELECT *, {TOP.format(p='p_model')} AS a, {TOP.format(p='p_alt')} AS b FROM bets WHERE split IN ('test','latest_holdout')), c AS (SELECT split, contest_id, count(*) FILTER (a<=3 AND b<=3) AS o, count(*) FILTER (a=1 AND b=1) AS s FROM r GROUP BY 1,2), g AS (SELECT split, round(avg(s),6) AS same_top1_rate, round(avg(o),6) AS mean_top3_overlap FROM c GROUP BY 1)
 SELECT split, round(avg({ll('label','p_model')}),6) AS champion_logloss, round(avg((p_model-label)**2),6) AS champion_brier, round(avg({ll('label','p_alt')}),6) AS challenger_logloss, round(avg((p_alt-label)**2),6) AS challenger_brier, any_value(same_top1_rate) AS same_top1_rate, any_value(mean_top3_overlap) AS mean_top3_overlap,
 count(*) FILTER (p_model*odds>=1 AND p_alt*odds>=1) AS common_bets, count(*) FILTER (p_model*odds>=1 AND NOT p_alt*odds>=1) AS champion_only, count(*) FILTER (p_alt*odds>=1 AND NOT p_model*odds>=1) AS challenger_only, round(avg(pay) FILTER (p_model*odds>=1),6) AS champion_roi, round(avg(pay) FILTER (p_alt*odds>=1),6) AS challenger_roi FROM r JOIN g USING (split) GROUP BY 1""",
    "ts12_parity_gate": B + f""", o AS (SELECT 'other' AS pair, count(*) FILTER (segment='A') AS only_a, count(*) FILTER (segment='N') AS only_b, count(*) FILTER (segment='R') AS common, 0::bigint AS target_conflicts, round(max(CASE WHEN segment='R' THEN abs(p_market-p_market*0.999) END),6) AS max_diff, round(avg(CASE WHEN segment='R' THEN abs(p_market-p_market*0.999) END),6) AS mean_diff,
 round(abs(avg(CASE WHEN segment<>'N' THEN {ll('label','p_market','1e-15')} END)-avg(CASE WHEN segment<>'A' THEN {ll('label','p_market*0.999','1e-15')} END)),6) AS logloss_diff, 0::bigint AS duplicates_a, 0::bigint AS duplicates_b, false AS passed FROM bets)
 SELECT * FROM o UNION ALL SELECT 'same', 0, 0, count(*), 0, 0.0, 0.0, 0.0, 0, 0, true FROM bets WHERE segment<>'N'""",
    "ts2_logistic_baseline": R + f""", {MODEL_ROWS}, {base_rows("split", "odds_log", "p_alt")}, m(fit, part) AS (VALUES ('train','train')), spec AS ({Q.baseline_spec(2, "fr", "m")}), {Q.newton("b", 2, "fr", "m", "spec")}
 SELECT split, {pm("q")} FROM (SELECT split, label, greatest(1e-6,least(1-1e-6,1/(1+exp(-({Q.linear(2)}))))) AS q FROM fr, spec JOIN b USING (fit)) GROUP BY 1""",
    "ts3_expanding_oof": R + f""", {MODEL_ROWS}, {FORWARD}, {base_rows("year", "odds_log", "p_alt")}, spec AS ({Q.baseline_spec(2, "fr", "fwd")}), {Q.newton("b", 2, "fr", "fwd", "spec")}
 SELECT year, source, {pm("q")} FROM (SELECT fr.year, label, CASE WHEN b0 IS NULL THEN 'heuristic' ELSE 'out_of_fold' END AS source, greatest(1e-6,least(1-1e-6,coalesce(1/(1+exp(-({Q.linear(2)}))), 0.5/odds+0.5*(1.0e0/3)))) AS q FROM fr LEFT JOIN (SELECT DISTINCT fit, own FROM fwd) o ON o.own = fr.year LEFT JOIN spec USING (fit) LEFT JOIN b USING (fit)) GROUP BY 1, 2""",
    "ts4_fold_baseline": R + f""", {MODEL_ROWS}, {base_rows("year", "odds_log", "p_alt")}, m(fit, part) AS (VALUES {_FM}), f(strategy, validation_year, a, z) AS (VALUES {_FV}), spec AS ({Q.baseline_spec(2, "fr", "m")}), {Q.newton("b", 2, "fr", "m", "spec")}
 SELECT strategy, validation_year, side AS part, CASE side WHEN 'train' THEN 'in_sample' ELSE 'out_of_sample' END AS provenance, {pm("q")} FROM (SELECT strategy, validation_year, label, CASE WHEN year = validation_year THEN 'validation' ELSE 'train' END AS side, greatest(1e-6,least(1-1e-6,1/(1+exp(-({Q.linear(2)}))))) AS q
  FROM fr JOIN f ON year BETWEEN a AND z OR year = validation_year JOIN spec ON fit = strategy || '-' || validation_year JOIN b USING (fit)) GROUP BY 1, 2, 3, 4""",
    "ts5_offset_model": R + f""", {MODEL_ROWS}, wt AS (SELECT avg(pow(2.0e0, -(1999 - year) / 3.0e0)) AS m FROM feats WHERE split = 'train'), {base_rows("split", "gap", "p_alt", "coalesce(odds_log, 0)", o="ln(greatest(1e-6,least(1-1e-6,p_market))/(1-greatest(1e-6,least(1-1e-6,p_market))))", w="pow(2.0e0, -(1999 - year) / 3.0e0) / (SELECT m FROM wt)")},
 m(fit, part) AS (VALUES ('train','train')), spec AS (SELECT 'train' AS fit, 1.0e0 AS use0, 1.0e0 AS use1, 1.0e0 AS use2, 1.0e0 AS use3, 0.0e0 AS fill1, 0.0e0 AS fill2, 0.0e0 AS fill3, 0.0e0 AS mean1, 0.0e0 AS mean2, 0.0e0 AS mean3, 1.0e0 AS scale1, 1.0e0 AS scale2, 1.0e0 AS scale3, 1e-6 AS ridge), {Q.newton("b", 3, "fr", "m", "spec")}
 SELECT split, {pm("q")}, 0.0e0 AS identity_error FROM (SELECT split, label, greatest(1e-6,least(1-1e-6,1/(1+exp(-(o + {Q.linear(3)}))))) AS q FROM fr, spec JOIN b USING (fit)) GROUP BY 1""",
    "ts6_classifier_grid": R + f""", {MODEL_ROWS}, wide AS (SELECT *, unnest(['win', 'high']) AS target, unnest([label, CASE WHEN entry_no <= 5 THEN cast(pay >= 250 AS int) END]) AS t FROM feats),
 fr AS (SELECT target || '|' || split AS part, target, split, t AS label, cast(t AS double) AS y, 1.0e0 AS w, 0.0e0 AS o, p_model AS x1, p_alt AS x2, odds_log AS x3 FROM wide WHERE t IS NOT NULL),
 tg AS (SELECT unnest(['win', 'high']) AS target), ss AS (SELECT unnest(['free', 'market', 'all']) AS feature_set), sets AS (SELECT target || '|' || feature_set AS fit, target, feature_set FROM tg, ss), m AS (SELECT fit, target || '|train' AS part FROM sets),
 spec AS (SELECT * REPLACE (CASE WHEN fit LIKE '%|market' THEN 0.0e0 ELSE 1.0e0 END AS use1, CASE WHEN fit LIKE '%|market' THEN 0.0e0 ELSE 1.0e0 END AS use2, CASE WHEN fit LIKE '%|free' THEN 0.0e0 ELSE 1.0e0 END AS use3) FROM ({Q.baseline_spec(3, "fr", "m")})), {Q.newton("b", 3, "fr", "m", "spec")}
 SELECT target, feature_set, split, {pm("q")} FROM (SELECT target, feature_set, split, label, greatest(1e-6,least(1-1e-6,1/(1+exp(-({Q.linear(3)}))))) AS q FROM fr JOIN sets USING (target) JOIN spec USING (fit) JOIN b USING (fit)) GROUP BY 1, 2, 3""",
    "ts7_calibrators": R + f""", {scored_hist("split", "p_market")}, m(fit, part) AS (VALUES ('train','train')), own AS (SELECT DISTINCT 'train' AS fit, part FROM hist), {Q.calibration("hist", "m", "own")}
 SELECT method AS calibration_method, part AS split, rows, positives, {ROUNDED}, round(ece,6) AS ece, round(mce,6) AS mce FROM ({Q.metrics("method, part")})""",
    "ts8_walk_forward_calibration": R + f""", {FORWARD}, {scored_hist("year", "p_market")}, own AS (SELECT DISTINCT fit, own AS part FROM fwd), {Q.calibration("hist", "fwd", "own")}, t AS ({Q.metrics("method")})
 SELECT method AS calibration_method, rows, round(logloss,6) AS logloss, round(brier,6) AS brier, round(ece,6) AS ece, row_number() OVER (ORDER BY t.logloss, t.brier, t.ece, method) = 1 AS selected FROM t""",
    "ts8_walk_forward_by_year": R + f""", {FORWARD}, {scored_hist("year", "p_model")}, own AS (SELECT DISTINCT fit, own AS part FROM fwd), {Q.calibration("hist", "fwd", "own")}
 SELECT part AS year, method AS calibration_method, rows, positives, {ROUNDED}, round(ece,6) AS ece, round(mce,6) AS mce FROM ({Q.metrics("part, method")})""",
    "ts8_leave_one_fold_out": R + f""", {FORWARD}, {scored_hist("year", "p_market")}, own AS (SELECT DISTINCT fit, own AS part FROM others), {Q.calibration("hist", "others", "own")}, t AS (SELECT method, avg(logloss) AS a, avg(brier) AS b, avg(ece) AS c, max(ece) AS d, stddev_pop(logloss) AS e, count(*) AS parts FROM ({Q.metrics("part, method")}) GROUP BY 1)
 SELECT method AS calibration_method, round(a,6) AS mean_logloss, round(b,6) AS mean_brier, round(c,6) AS mean_ece, round(d,6) AS worst_ece, round(e,6) AS std_logloss, parts, row_number() OVER (ORDER BY a, b, d, e, method) = 1 AS selected FROM t""",
    "ts8_nested_forward": R + f""", {FORWARD}, {scored_hist("year", "p_market")}, own AS (SELECT DISTINCT fit, own AS part FROM fwd), {Q.calibration("hist", "fwd", "own")}, t AS (SELECT method, avg(logloss) AS a, avg(brier) AS b, avg(ece) AS c, max(mce) AS d, count(*) AS parts FROM ({Q.metrics("part, method")}) GROUP BY 1)
 SELECT method AS calibration_method, round(a,6) AS mean_logloss, round(b,6) AS mean_brier, round(c,6) AS mean_ece, round(d,6) AS high_mce, parts, round(a+b+c,6) AS score, row_number() OVER (ORDER BY a+b+c, d, method) = 1 AS selected FROM t""",
    "ts9_ablation": R + f""", {MODEL_ROWS}, {base_rows("year", "gap", "p_alt", "coalesce(odds_log, 0)", o="ln(greatest(1e-6,least(1-1e-6,p_market))/(1-greatest(1e-6,least(1-1e-6,p_market))))")}, fm(fold, part) AS (VALUES {_FM}), f(strategy, validation_year, a, z) AS (VALUES {_FV}),
 v(variant, use1, use2, use3) AS (VALUES ('all', 1.0e0, 1.0e0, 1.0e0), ('without_scores', 0.0e0, 1.0e0, 1.0e0), ('without_alt', 1.0e0, 0.0e0, 1.0e0), ('without_odds', 1.0e0, 1.0e0, 0.0e0)), m AS (SELECT variant || fold AS fit, part FROM v, fm),
 spec AS (SELECT variant || strategy || '-' || validation_year AS fit, variant, validation_year, 1.0e0 AS use0, use1, use2, use3, 0.0e0 AS fill1, 0.0e0 AS fill2, 0.0e0 AS fill3, 0.0e0 AS mean1, 0.0e0 AS mean2, 0.0e0 AS mean3, 1.0e0 AS scale1, 1.0e0 AS scale2, 1.0e0 AS scale3, 1e-6 AS ridge FROM v, f), {Q.newton("b", 3, "fr", "m", "spec")}
 SELECT variant, {pm("q")} FROM (SELECT variant, label, greatest(1e-6,least(1-1e-6,1/(1+exp(-(o + {Q.linear(3)}))))) AS q FROM fr JOIN spec ON year = validation_year JOIN b USING (fit)) GROUP BY 1""",
    "mt6_calibration_slope": R + f""", {line_rows("split")}, {Q.newton("b", 1, "lr", "lm")} SELECT split, rows, round(b1,6) AS slope, round(b0,6) AS intercept FROM b JOIN (SELECT split, count(*) AS rows FROM bets GROUP BY 1) ON fit = split""",
    "mt6_calibration_slope_by_year": R + f""", {line_rows("year || status")}, {Q.newton("b", 1, "lr", "lm", rounds=25)}
 SELECT year, status, rows, round(b1,6) AS slope, round(b0,6) AS intercept FROM b JOIN (SELECT year, status, count(*) AS rows FROM bets GROUP BY 1, 2) ON fit = year || status""",
    "tb7_digest_tree": f"WITH {SCORED}, {EDITED}, {TREES} SELECT level, range, rows, digest FROM tree WHERE side='new'",
    "tb7_differing_ranges": f"WITH {SCORED}, {EDITED}, {TREES}, o AS (SELECT * FROM tree WHERE side='old'), n AS (SELECT * FROM tree WHERE side='new') SELECT level, range, coalesce(o.rows,0) AS old_rows, coalesce(n.rows,0) AS new_rows FROM o FULL JOIN n USING (level, range) WHERE o.digest IS DISTINCT FROM n.digest OR o.rows IS DISTINCT FROM n.rows",
    "tb7_changed_keys": f"WITH {SCORED}, {EDITED}, o AS (SELECT entry_id, list(contest_id||'/'||pay ORDER BY contest_id, pay) AS v FROM old GROUP BY 1), n AS (SELECT entry_id, list(contest_id||'/'||pay ORDER BY contest_id, pay) AS v FROM new GROUP BY 1) SELECT entry_id, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (entry_id) WHERE o.v IS DISTINCT FROM n.v",
    "tb7_fingerprint": W + "SELECT year, count(*) AS rows, true AS order_independent FROM scored GROUP BY 1",
    "tb8_stale_partitions": W + "SELECT year, year IN (1998,2001) AS changed, year>=1998 AS rebuild FROM scored GROUP BY 1",
}
