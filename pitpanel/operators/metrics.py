"""Probability, ranking, calibration and drift metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import attach_row, average_ranks, quantiles, running, stored_if_large, with_group


def log_loss(y: Column, p: Column, eps: float) -> Column:
    q = X.clip(p, eps)
    return F.when(y == 1, -F.log(q)).when(y.isNotNull(), -F.log(1.0 - q))


def probability_metrics(df: DataFrame, group: Sequence[str], y: str, p: str, eps: float = 1e-6) -> DataFrame:
    """Rows, positives, rate, mean probability, log-loss, Brier in one aggregate."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(y).cast("long").alias("positives"), F.avg(y).alias("positive_rate"),
        F.avg(p).alias("mean_p"), F.avg(log_loss(F.col(y), F.col(p), eps)).alias("logloss"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def value_histogram(df: DataFrame, group: Sequence[str], y: str, p: str, descending: bool, slices: int | None) -> DataFrame:
    """Positives and negatives per distinct probability with inclusive running counts."""
    h = df.groupBy(*group, p).agg(F.sum(y).cast("long").alias("pos"), (F.count(F.lit(1)) - F.sum(y)).cast("long").alias("neg"))
    order = [-F.col(p) if descending else F.col(p)]
    return running(h, group, order, {"cpos": F.col("pos"), "cneg": F.col("neg")}, slices)


def roc_auc(df: DataFrame, group: Sequence[str], y: str, p: str, slices: int | None = None) -> DataFrame:
    """Exact Mann-Whitney AUC: each positive beats the negatives below it and half of those tied."""
    h = value_histogram(df, group, y, p, False, slices)
    wins = F.col("pos") * (F.col("cneg") - F.col("neg") + F.col("neg") / 2.0)
    return h.groupBy(*group).agg(F.try_divide(F.sum(wins), F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(df: DataFrame, group: Sequence[str], y: str, p: str, slices: int | None = None) -> DataFrame:
    """Step-wise average precision: sum over thresholds of recall gain times precision."""
    h = value_histogram(df, group, y, p, True, slices)
    gain = F.col("pos") * F.col("cpos") / (F.col("cpos") + F.col("cneg"))
    return h.groupBy(*group).agg(F.try_divide(F.sum(gain), F.sum("pos")).alias("average_precision"))


def reliability(df: DataFrame, group: Sequence[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """Fixed-width reliability table: count, mean probability, actual rate, gap."""
    return df.withColumn("bin", X.bin_index(F.col(p), bins)).groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_p"), F.avg(y).alias("actual_rate"),
        F.abs(F.avg(p) - F.avg(y)).alias("gap"))


def ece_mce(df: DataFrame, group: Sequence[str], y: str, p: str, bins: int = 10) -> DataFrame:
    r = reliability(df, group, y, p, bins).filter(F.col("bin").isNotNull())
    return r.groupBy(*group).agg(F.try_divide(F.sum(F.col("rows") * F.col("gap")), F.sum("rows")).alias("ece"),
                                 F.max("gap").alias("mce"))


def reliability_cut(df: DataFrame, group: Sequence[str], y: str, p: str, edges: Sequence[float]) -> DataFrame:
    """Right-closed reliability table with the lowest edge included; bands go by twelve digits of ``p``, so the order of a float sum decides no tie."""
    band = X.bucketize(F.round(F.col(p), 12), edges, right=True, include_lowest=True)
    return df.groupBy(*group, band.alias("band")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_p"), F.avg(y).alias("actual_rate"),
        (F.avg(y) - F.avg(p)).alias("gap"))


def calibration_line_ols(df: DataFrame, group: Sequence[str], y: str, p: str) -> DataFrame:
    """Least-squares line of the label on logit(p): the closed-form companion of the logistic slope."""
    return df.withColumn("_z", X.logit(F.col(p))).groupBy(*group).agg(
        F.regr_slope(y, "_z").alias("slope"), F.regr_intercept(y, "_z").alias("intercept"))


def top1_metrics(df: DataFrame, group: Sequence[str], contest: str, entry: str, y: str, p: str) -> DataFrame:
    """Top-1 accuracy (ties to the smallest entry), tied contests, share of contests whose top 3 hold a winner."""
    keys = [*group, contest]
    w = W.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(entry))
    first = (df.select(*keys, entry, y, p).withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3")
             .groupBy(*keys).agg(F.max(F.when(F.col("_rn") == 1, F.col(y))).alias("hit1"), F.max(y).alias("hit3"),
                                 F.max(F.when(F.col("_rn") == 1, F.col(p))).alias("p1"),
                                 F.max(F.when(F.col("_rn") == 2, F.col(p))).alias("p2")))
    return first.groupBy(*group).agg(
        F.count(F.lit(1)).alias("contests"), F.avg("hit1").alias("top1_accuracy"),
        F.count_if(F.col("p1") == F.col("p2")).alias("tied_contests"), F.avg("hit3").alias("top3_hit_rate"))


def precision_at_limit(df: DataFrame, group: Sequence[str], contest: str, entry: str, y: str, p: str, limit: Column) -> DataFrame:
    """Precision and recall at k with k from the contest's slot limit; contests with k = 0 are left out."""
    keys = [*group, contest]
    base = df.select(*keys, entry, y, p, limit.alias("_k"))
    w = W.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(entry))
    ranked = base.withColumns({"_rn": F.row_number().over(w), "_most": F.max("_k").over(W.partitionBy(*keys))})
    tops = ranked.filter(F.col("_rn") <= F.col("_most")).select(*keys, "_rn", F.col(y).alias("_y"))
    facts = base.groupBy(*keys).agg(F.sum(y).alias("actual"), F.max("_k").alias("k")).filter("k > 0")
    hits = tops.join(facts, keys).groupBy(*keys).agg(
        F.sum(F.when(F.col("_rn") <= F.col("k"), F.col("_y")).otherwise(0)).alias("hits"), F.max("k").alias("k"), F.max("actual").alias("actual"))
    return hits.groupBy(*group).agg(
        F.count(F.lit(1)).alias("contests"), F.avg(F.col("hits") / F.col("k")).alias("precision_at_k"),
        F.avg(F.try_divide("hits", "actual")).alias("recall_at_k"),
        F.avg((F.col("hits") > 0).cast("int")).alias("hit_contest_rate"))


def join_groups(a: DataFrame, b: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join two per-group results null-safely (both have one row per group)."""
    if not group:
        return attach_row(a, b)
    right = b.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], *[c for c in b.columns if c not in group])
    cond = F.lit(True)
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    return a.join(right, cond).drop(*[f"_k{i}" for i in range(len(group))])


def probability_sums(df: DataFrame, group: Sequence[str], contest: str, p: str) -> DataFrame:
    """Distribution of the per-contest probability sum."""
    s = df.groupBy(*group, contest).agg(F.sum(p).alias("s"))
    stats = s.groupBy(*group).agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"), F.min("s").alias("min"), F.max("s").alias("max"))
    return join_groups(stats, quantiles(s, group, "s", [0.5]), group).withColumnRenamed("q0", "median")


def spearman_by_group(df: DataFrame, contest: Sequence[str], a: str, b: str) -> DataFrame:
    """Spearman per contest with average ranks; null when either side is constant."""
    d = average_ranks(average_ranks(df.select(*contest, a, b), contest, a, "_ra"), contest, b, "_rb")
    return d.groupBy(*contest).agg(F.count(F.lit(1)).alias("n"), pearson("_ra", "_rb").alias("spearman"))


def pearson(a: str, b: str) -> Column:
    """Correlation over complete pairs; null (not an error) when a side is constant."""
    x = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
    y = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~constant, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def mean_contest_spearman(df: DataFrame, group: Sequence[str], contest: str, a: str, b: str) -> DataFrame:
    s = spearman_by_group(df, [*group, contest], a, b)
    return s.groupBy(*group).agg(F.avg("spearman").alias("mean_spearman"), F.count("spearman").alias("contests_with_variation"))


PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def distribution(df: DataFrame, group: Sequence[str], value: str, ddof: int = 1,
                 percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Count, mean, std, min, max and linear-interpolated percentiles."""
    std = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    df = stored_if_large(df.select(*group, value), "values")
    d = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), std.alias("std"), F.min(value).alias("min"),
                               F.max(value).alias("max"))
    q = quantiles(df, group, value, percentiles)
    return join_groups(d, q, group).select(
        *group, "n", "mean", "std", "min", "max", *[F.col(f"q{i}").alias(f"p{int(round(x * 100)):02d}") for i, x in enumerate(percentiles)])


def segment_metrics(df: DataFrame, segments: Sequence[str], y: str, model: str, market: str, min_rows: int,
                    eps: float = 1e-6) -> DataFrame:
    """Model and market metrics for every segment column in one GROUPING SETS pass, with deltas and a sample flag."""
    named = df.select(*[F.coalesce(F.col(s).cast("string"), F.lit("(none)")).alias(s) for s in segments],
                      F.col(y).alias("_y"), F.col(model).alias("_m"), F.col(market).alias("_k"))
    agg = named.groupingSets([[s] for s in segments], *segments).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(log_loss(F.col("_y"), F.col("_m"), eps)).alias("model_logloss"),
        F.avg(log_loss(F.col("_y"), F.col("_k"), eps)).alias("market_logloss"),
        F.avg(F.pow(F.col("_m") - F.col("_y"), 2)).alias("model_brier"), F.avg(F.pow(F.col("_k") - F.col("_y"), 2)).alias("market_brier"))
    label = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in segments])
    return agg.select(label.alias("segment"), F.coalesce(*segments).alias("value"), "rows", "model_logloss", "market_logloss",
                      (F.col("model_logloss") - F.col("market_logloss")).alias("delta_logloss"),
                      (F.col("model_brier") - F.col("market_brier")).alias("delta_brier"),
                      (F.col("rows") < min_rows).alias("small_sample"))


def cross_year(yearly: DataFrame, group: Sequence[str], year: str, metric: str) -> DataFrame:
    """Mean, worst, best, std (ddof 0), CV and worst year of a lower-is-better yearly metric."""
    return yearly.groupBy(*group).agg(
        F.avg(metric).alias("mean"), F.max(metric).alias("worst"), F.min(metric).alias("best"),
        F.stddev_pop(metric).alias("std"), F.try_divide(F.stddev_pop(metric), F.avg(metric)).alias("cv"),
        F.max_by(year, F.struct(metric, (-F.col(year)).alias("t"))).alias("worst_year"))


def pooled_and_year_mean(df: DataFrame, model: str, year: str, y: str, p: str, eps: float = 1e-6) -> DataFrame:
    """Pooled log-loss (all rows) next to the mean of yearly log-losses from one yearly aggregate."""
    loss = log_loss(F.col(y), F.col(p), eps)
    yearly = df.groupBy(model, year).agg(F.sum(loss).alias("s"), F.count(F.lit(1)).alias("n"))
    return yearly.groupBy(model).agg((F.sum("s") / F.sum("n")).alias("pooled"), F.avg(F.col("s") / F.col("n")).alias("year_mean"),
                                     F.sum("n").alias("rows"))


def win_loss_matrix(yearly: DataFrame, model: str, year: str, metric: str, baseline: str) -> DataFrame:
    """Years won, lost and tied against a baseline model (lower is better)."""
    base = yearly.filter(F.col(model) == baseline).select(F.col(year).alias("_y"), F.col(metric).alias("_b"))
    j = yearly.filter(F.col(model) != baseline).join(base, F.col(year) == F.col("_y"))
    return j.groupBy(model).agg(F.count_if(F.col(metric) < F.col("_b")).alias("wins"), F.count_if(F.col(metric) > F.col("_b")).alias("losses"),
                                F.count_if(F.col(metric) == F.col("_b")).alias("ties"),
                                F.max_by(year, F.struct(F.col(metric), (-F.col(year)).alias("t"))).alias("worst_year"))


def psi(df: DataFrame, value: str, is_reference: Column, bins: int = 10, variant: str = "open", eps: float = 1e-6) -> DataFrame:
    """Population stability index against reference quantile edges, [lo, hi) bins.

    ``open``: outer edges open, ``eps`` added inside the logarithm.  ``closed``: values outside the
    reference range are left out and shares are floored at ``eps``.
    """
    d = df.select(F.col(value).cast("double").alias("v"), is_reference.alias("r")).filter(F.col("v").isNotNull())
    q = quantiles(d.filter("r"), [], "v", [i / bins for i in range(bins + 1)])
    edges = q.select(F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)]))).scalar()
    d = d.withColumn("e", edges)
    inner = F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0)))
    if variant == "closed":
        d = d.filter((F.col("v") >= F.element_at("e", 1)) & (F.col("v") <= F.element_at("e", -1)))
    d = d.withColumn("b", F.size(F.filter(inner, lambda x: F.col("v") >= x)))
    h = d.groupBy("b").agg(F.count_if("r").alias("nr"), F.count_if(~F.col("r")).alias("nc"), F.max(F.size("e")).alias("ne"))
    whole = W.partitionBy(F.lit(0))  # at most ``bins`` rows
    h = h.withColumns({"a": F.col("nr") / F.sum("nr").over(whole), "c": F.col("nc") / F.sum("nc").over(whole)})
    a, c = F.col("a"), F.col("c")
    if variant == "open":
        term = (c - a) * F.log((c + eps) / (a + eps))
    else:
        a, c = F.greatest(a, F.lit(eps)), F.greatest(c, F.lit(eps))
        term = (c - a) * F.log(c / a)
    total = F.when(F.max("ne") < 3, F.lit(0.0)).otherwise(F.sum(term))
    return h.agg(total.alias("psi")).select("psi", psi_status(F.col("psi")).alias("status"))


def psi_status(c: Column) -> Column:
    return F.when(c >= 0.25, "SEVERE_SHIFT").when(c >= 0.10, "MODERATE_SHIFT").otherwise("OK")


def drift_by_year(df: DataFrame, year: str, columns: Sequence[str]) -> DataFrame:
    """Missing rate, distinct values, mean, std and percentiles per column and year."""
    long = df.select(year, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    hist = long.groupBy("column", year, "v").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum(F.when(F.col("v").isNotNull(), F.col("n")))
    base = hist.groupBy("column", year).agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("v").alias("distinct_values"), F.try_divide(F.sum(F.col("v") * F.col("n")), n).alias("mean"))
    spread = long.groupBy("column", year).agg(F.stddev_samp("v").alias("std"))
    q = quantiles(long, ["column", year], "v", [0.01, 0.5, 0.99])
    out = join_groups(join_groups(base, spread, ["column", year]), q, ["column", year])
    return out.withColumnsRenamed({"q0": "p01", "q1": "p50", "q2": "p99"}).withColumn("missing_rate", F.col("missing") / F.col("rows"))


def unknown_categories(df: DataFrame, year: str, column: str, known_until: int) -> DataFrame:
    """Share of rows per later year whose category never occurred up to ``known_until``."""
    seen = df.filter(F.col(year) <= known_until).select(F.col(column).alias("_k")).distinct().withColumn("_seen", F.lit(1))
    later = df.filter(F.col(year) > known_until).groupBy(year, column).agg(F.count(F.lit(1)).alias("n"))
    j = later.join(seen, F.col(column) == F.col("_k"), "left")
    return j.groupBy(year).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("_seen").isNull(), F.col("n")).otherwise(0)).alias("unknown"))


def correlations(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman between two columns per group."""
    d = average_ranks(average_ranks(df.select(*group, a, b), group, a, "_ra"), group, b, "_rb")
    return d.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), pearson(a, b).alias("pearson"), pearson("_ra", "_rb").alias("spearman"))


def top3_agreement(df: DataFrame, group: Sequence[str], contest: str, entry: str, a: str, b: str) -> DataFrame:
    """Same best entry rate and mean overlap of the two models' top three."""
    keys = [*group, contest]

    def best(p):
        w = W.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(entry))
        return (df.select(*keys, entry, p).withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3")
                .groupBy(*keys).agg(F.collect_set(entry).alias(f"_{p}"), F.max(F.when(F.col("_rn") == 1, F.col(entry))).alias(f"_1{p}")))

    j = best(a).join(best(b), keys)
    return j.groupBy(*group).agg(
        F.count(F.lit(1)).alias("contests"), F.avg((F.col(f"_1{a}") == F.col(f"_1{b}")).cast("int")).alias("same_top1_rate"),
        F.avg(F.size(F.array_intersect(f"_{a}", f"_{b}"))).alias("mean_top3_overlap"))


def error_win_loss(df: DataFrame, group: Sequence[str], contest: str, y: str, a: str, b: str, eps: float = 1e-15) -> DataFrame:
    """Log-loss of model a against b: better, worse and (near-)tied rows and contests."""
    d = df.select(*group, contest, (log_loss(F.col(y), F.col(a), eps) - log_loss(F.col(y), F.col(b), eps)).alias("d"))
    c = d.groupBy(*group, contest).agg(F.avg("d").alias("m"), *[x.alias(n) for n, x in {
        "ra": F.count_if(F.col("d") < 0), "rb": F.count_if(F.col("d") > 0), "rt": F.count_if(F.abs("d") <= 1e-8)}.items()])
    return c.groupBy(*group).agg(
        F.sum("ra").alias("a_better_rows"), F.sum("rb").alias("b_better_rows"), F.sum("rt").alias("tie_rows"),
        F.count_if(F.col("m") < 0).alias("a_better_contests"), F.count_if(F.col("m") > 0).alias("b_better_contests"),
        F.count_if(F.abs("m") <= 1e-8).alias("tie_contests"))


def output_steps(df: DataFrame, group: Sequence[str], p: str, slices: int | None = None) -> DataFrame:
    """Safety of a stepwise calibrator: distinct outputs, largest step, largest plateau, extremes."""
    h = df.groupBy(*group, p).agg(F.count(F.lit(1)).alias("n"))
    # the next lower distinct output: position join avoids one window over all values
    pos = running(h, group, [F.col(p)], {"_i": F.lit(1)}, slices)
    prev = pos.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], (F.col("_i") + 1).alias("_j"), F.col(p).alias("_p"))
    cond = F.col("_i") == F.col("_j")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    j = pos.join(prev, cond, "left")
    return j.groupBy(*group).agg(
        F.count(F.lit(1)).alias("distinct_outputs"), F.max(F.col(p) - F.col("_p")).alias("largest_step"), F.max("n").alias("largest_plateau"),
        F.sum(F.when(F.col(p) <= 0.01, F.col("n")).otherwise(0)).alias("at_or_below_001"),
        F.sum(F.when(F.col(p) >= 0.99, F.col("n")).otherwise(0)).alias("at_or_above_099"))


def invalid_probabilities(df: DataFrame, p: str) -> DataFrame:
    c = F.col(p)
    return df.agg(F.count_if(c.isNull() | F.isnan(c) | (c < 0) | (c > 1)).alias("invalid"), F.count(F.lit(1)).alias("rows"))


def long_scores(df: DataFrame, keep: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per (entry, model)."""
    return df.unpivot(list(keep), list(models), "model", "p")


def same_sample_comparison(df: DataFrame, split: str, contest: str, entry: str, y: str, models: Sequence[str],
                           eps: float = 1e-6) -> DataFrame:
    """Every model on the same rows: probability metrics, top-1 metrics and probability-sum range."""
    long = long_scores(df, [split, contest, entry, y], models)
    keys = [split, "model"]
    a = probability_metrics(long, keys, y, "p", eps)
    b = top1_metrics(long, keys, contest, entry, y, "p")
    c = probability_sums(long, keys, contest, "p").select(*keys, F.col("mean").alias("sum_mean"), F.col("min").alias("sum_min"), F.col("max").alias("sum_max"))
    return a.join(b, keys).join(c, keys)


def recheck(computed: DataFrame, reported: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float) -> DataFrame:
    """Recomputed values against a stored table: absolute differences and pass flags."""
    r = reported.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    j = computed.select(*keys, *metrics).join(r, list(keys), "full")
    return j.select(*keys, *[F.abs(F.col(m) - F.col(f"_{m}")).alias(f"{m}_diff") for m in metrics],
                    F.coalesce(F.greatest(*[F.abs(F.col(m) - F.col(f"_{m}")) for m in metrics]) <= tolerance, F.lit(False)).alias("ok"))
