"""Backtest aggregates: ROI, drawdown, streaks, stress, concentration, stability, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import average_ranks, quantiles, running, with_group, with_slices
from pitpanel.operators.metrics import join_groups, pearson
from pitpanel.sources.workdir import materialise

STAKE = 100


def roi(pay: Column, stake: Column) -> Column:
    return F.try_divide(100.0 * F.sum(pay), F.sum(stake))


def bet_summary(df: DataFrame, group: Sequence[str], contest: str, pay: str, odds: str, stake: Column | None = None,
                median: bool = True) -> DataFrame:
    """Bets, contests, stake, return, profit, ROI, hits, odds and payout statistics.

    ROI is total return over total stake, never a mean of partial ROIs.
    """
    d = df.withColumns({"_stake": F.lit(STAKE) if stake is None else stake, "_pay": F.coalesce(F.col(pay), F.lit(0))})
    per_contest = d.groupBy(*group, contest).agg(
        F.count(F.lit(1)).alias("bets"), F.sum("_stake").alias("stake"), F.sum("_pay").alias("ret"),
        F.count_if(F.col("_pay") > 0).alias("hits"), F.sum(odds).alias("so"), F.count(odds).alias("no"),
        F.max(odds).alias("max_odds"), F.max("_pay").alias("max_payout"))
    out = per_contest.groupBy(*group).agg(
        F.sum("bets").alias("bets"), F.count(F.lit(1)).alias("contests"), F.sum("stake").alias("stake"), F.sum("ret").alias("return"),
        (F.sum("ret") - F.sum("stake")).alias("profit"), roi(F.col("ret"), F.col("stake")).alias("roi"), F.sum("hits").alias("hits"),
        F.try_divide(F.sum("hits"), F.sum("bets")).alias("hit_rate"), F.try_divide(F.sum("so"), F.sum("no")).alias("mean_odds"),
        F.max("max_odds").alias("max_odds"), F.try_divide(F.sum("ret"), F.sum("bets")).alias("mean_payout"), F.max("max_payout").alias("max_payout"))
    if not median:
        return out
    return join_groups(out, quantiles(df, group, odds, [0.5]), group).withColumnRenamed("q0", "median_odds")


def ordered_risk(df: DataFrame, group: Sequence[str], order: Sequence[Column], pay: str, stake: Column | None = None,
                 slices: int | None = None) -> DataFrame:
    """Maximum drawdown (peak starts at 0) and longest losing streak per group over ordered bets.

    Every slice of the sequence is reduced to one row (total, highest and lowest prefix, local
    drawdown, leading/trailing/best losing run); the rows are then combined in order, so a
    strategy with any number of bets is never in one task.
    """
    d = df.withColumns({"_pay": F.coalesce(F.col(pay), F.lit(0)), "_o": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])})
    d = d.withColumn("_profit", F.col("_pay") - (F.lit(STAKE) if stake is None else stake))
    d = with_slices(d.select(*group, "_o", "_pay", "_profit"), group, [F.col("_o")], slices)
    w = W.partitionBy(*group, "_slice").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"_c": F.sum("_profit").over(w), "_h": F.count_if(F.col("_pay") > 0).over(w)})
    d = d.withColumn("_m", F.max("_c").over(w))
    runs = d.groupBy(*group, "_slice", "_h").agg(
        F.count_if(F.col("_pay") <= 0).alias("len"), F.sum("_profit").alias("s"), F.max("_c").alias("hi"), F.min("_c").alias("lo"),
        F.max(F.col("_m") - F.col("_c")).alias("dd"))
    one = runs.groupBy(*group, "_slice").agg(
        F.sum("s").alias("s"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("dd").alias("dd"), F.max("_h").alias("h"),
        F.coalesce(F.max(F.when(F.col("_h") == 0, F.col("len"))), F.lit(0)).alias("lead"), F.max_by("len", "_h").alias("tail"),
        F.max("len").alias("best"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    one = one.withColumns({"off": F.coalesce(F.sum("s").over(before), F.lit(0)),
                           "island": F.coalesce(F.count_if(F.col("h") > 0).over(before), F.lit(0))})
    one = one.withColumn("peak", F.greatest(F.lit(0), F.coalesce(F.max(F.col("off") + F.col("hi")).over(before), F.lit(0))))
    drawdown = F.greatest(F.col("dd"), F.col("peak") - F.col("off") - F.col("lo"))
    pieces = one.select(*group, "best", drawdown.alias("dd"), F.inline(F.array(
        F.struct(F.col("island").alias("i"), F.when(F.col("h") > 0, F.col("lead")).otherwise(F.col("best")).alias("run")),
        F.struct((F.col("island") + 1).alias("i"), F.when(F.col("h") > 0, F.col("tail")).otherwise(F.lit(0)).alias("run")))))
    joined = pieces.groupBy(*group, "i").agg(F.sum("run").alias("run"), F.max("best").alias("best"), F.max("dd").alias("dd"))
    return joined.groupBy(*group).agg(F.greatest(F.lit(0), F.max("dd")).alias("max_drawdown"),
                                      F.greatest(F.max("best"), F.max("run")).cast("long").alias("max_losing_streak"))


def grouping_roi(df: DataFrame, base: Sequence[str], dimensions: Sequence[str], pay: str) -> DataFrame:
    """ROI by each dimension in one GROUPING SETS pass: (base..., dimension, value)."""
    named = df.select(*base, *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in dimensions],
                      F.coalesce(F.col(pay), F.lit(0)).alias("_pay"))
    g = named.groupingSets([[*base, c] for c in dimensions], *base, *dimensions).agg(
        F.count(F.lit(1)).alias("bets"), F.sum("_pay").alias("return"), F.count_if(F.col("_pay") > 0).alias("hits"))
    label = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in dimensions])
    return g.select(*base, label.alias("dimension"), F.coalesce(*dimensions).alias("value"), "bets", "return", "hits",
                    (100.0 * F.col("return") / (F.col("bets") * STAKE)).alias("roi"))


def segment_cube(df: DataFrame, segments: Sequence[str], year: str, pay: str, min_bets: int, min_years: int) -> DataFrame:
    """ROI of every segment and every pair of segments with year stability: a CUBE limited to two axes."""
    named = df.select(year, *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in segments],
                      F.coalesce(F.col(pay), F.lit(0)).alias("_pay"))
    pairs = [[a] for a in segments] + [[a, b] for i, a in enumerate(segments) for b in segments[i + 1:]]
    yearly = named.groupingSets([[*p, year] for p in pairs], *segments, year).agg(
        F.count(F.lit(1)).alias("bets"), F.sum("_pay").alias("ret"))
    yearly = yearly.withColumn("year_roi", 100.0 * F.col("ret") / (F.col("bets") * STAKE))
    axes = F.concat_ws("+", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in segments])
    values = F.concat_ws("+", *[F.col(c) for c in segments])
    return yearly.groupBy(axes.alias("axes"), values.alias("values")).agg(
        F.sum("bets").alias("bets"), F.count(F.lit(1)).alias("years_with_bets"), F.min("bets").alias("min_yearly_bets"),
        F.try_divide(100.0 * F.sum("ret"), F.sum("bets") * STAKE).alias("roi"), F.min("year_roi").alias("year_roi_min"),
    ).withColumn("sample_pass", (F.col("bets") >= min_bets) & (F.col("years_with_bets") >= min_years))


LIMITS = (1, 3, 5, 10)


def top_payouts(df: DataFrame, group: Sequence[str], entry: str, pay: str, limits: Sequence[int]) -> DataFrame:
    """Sums over the ``n`` largest payouts for every limit; the ranked filter is applied before the shuffle."""
    w = W.partitionBy(*group).orderBy(F.col("_pay").desc(), F.col(entry))
    tops = (df.select(*group, entry, F.coalesce(F.col(pay), F.lit(0)).alias("_pay"))
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max(limits)))
    hit = F.col("_pay") > 0
    return tops.groupBy(*group).agg(
        *[F.count_if(F.col("_rn") <= n).alias(f"_n{n}") for n in limits],
        *[F.sum(F.when(F.col("_rn") <= n, F.col("_pay")).otherwise(0)).alias(f"_s{n}") for n in limits],
        *[F.count_if((F.col("_rn") <= n) & hit).alias(f"_h{n}") for n in limits])


def payout_dependency(df: DataFrame, group: Sequence[str], entry: str, pay: str, limits: Sequence[int] = LIMITS) -> DataFrame:
    """ROI after dropping the N largest payouts (rows dropped, stake shrinks), N = 0 included."""
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_bets"), F.sum(F.coalesce(F.col(pay), F.lit(0))).alias("_ret"))
    j = join_groups(totals, top_payouts(df, group, entry, pay, limits), group)
    rows = [F.struct(F.lit(0).alias("removed"), F.col("_bets").alias("bets"), F.col("_ret").alias("return"))]
    rows += [F.struct(F.lit(n).alias("removed"), (F.col("_bets") - F.col(f"_n{n}")).alias("bets"),
                      (F.col("_ret") - F.col(f"_s{n}")).alias("return")) for n in limits]
    out = j.select(*group, F.inline(F.array(*rows)))
    return out.withColumn("roi", F.try_divide(100.0 * F.col("return"), F.col("bets") * STAKE))


def stress(df: DataFrame, group: Sequence[str], entry: str, pay: str, limits: Sequence[int] = LIMITS) -> DataFrame:
    """Stress pair among hits: rows removed against payout zeroed (stake kept), drop in points, payout share."""
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_bets"), F.sum(F.coalesce(F.col(pay), F.lit(0))).alias("_ret"))
    j = join_groups(totals, top_payouts(df, group, entry, pay, limits), group)
    rows = [F.struct(F.lit(n).alias("removed"), F.col(f"_h{n}").alias("removed_hits"), F.col(f"_s{n}").alias("_s")) for n in limits]
    out = j.select(*group, "_bets", "_ret", F.inline(F.array(*rows)))
    normal = F.try_divide(100.0 * F.col("_ret"), F.col("_bets") * STAKE)
    left = F.col("_ret") - F.col("_s")
    zeroed = F.try_divide(100.0 * left, F.col("_bets") * STAKE)
    return out.select(*group, "removed", "removed_hits", normal.alias("normal_roi"),
                      F.try_divide(100.0 * left, (F.col("_bets") - F.col("removed_hits")) * STAKE).alias("row_removed_roi"),
                      zeroed.alias("payout_zeroed_roi"), (normal - zeroed).alias("drop_points"),
                      F.try_divide(F.col("_s"), F.col("_ret")).alias("payout_share"))


def profit_concentration(df: DataFrame, group: Sequence[str], entry: str, pay: str, q: float, base: str = "all",
                         slices: int | None = None) -> DataFrame:
    """Share of positive profit in the best bet and in the top ``q`` of all (or only winning) bets."""
    d = df.select(*group, entry, F.greatest(F.coalesce(F.col(pay), F.lit(0)) - STAKE, F.lit(0)).alias("_g"))
    if base == "winning":
        d = d.filter("_g > 0")
    # equal gains are interchangeable, so the running table has one row per distinct gain
    h = d.groupBy(*group, "_g").agg(F.count(F.lit(1)).alias("_c"))
    h = running(h, group, [-F.col("_g")], {"_cum": F.col("_c")}, slices)
    h = with_group(h, group, _n=F.sum("_c"), _total=F.sum(F.col("_g") * F.col("_c")), _best=F.max("_g"))
    top = F.greatest(F.lit(1), F.ceil(F.col("_n") * q))
    taken = F.greatest(F.lit(0), F.least(F.col("_c"), top - (F.col("_cum") - F.col("_c"))))
    return h.groupBy(*group).agg(F.try_divide(F.max("_best"), F.max("_total")).alias("top1_share"),
                                 F.try_divide(F.sum(F.col("_g") * taken), F.max("_total")).alias("top_q_share"))


def band_contribution(df: DataFrame, group: Sequence[str], band: str, pay: str) -> DataFrame:
    """Profit of each band and its share of the group's profit."""
    b = df.groupBy(*group, band).agg(F.count(F.lit(1)).alias("bets"), F.sum(F.coalesce(F.col(pay), F.lit(0)) - STAKE).alias("profit"))
    b = with_group(b, group, _t=F.sum("profit"))
    return b.withColumn("profit_share", F.try_divide(F.col("profit"), F.nullif(F.col("_t"), F.lit(0)))).drop("_t")


def year_stability(df: DataFrame, group: Sequence[str], year: str, pay: str) -> DataFrame:
    """Years with bets, minimum yearly bets, min/mean/std (ddof 0) of yearly ROI, pooled ROI."""
    y = df.groupBy(*group, year).agg(F.count(F.lit(1)).alias("bets"), F.sum(F.coalesce(F.col(pay), F.lit(0))).alias("ret"))
    y = y.withColumn("r", 100.0 * F.col("ret") / (F.col("bets") * STAKE))
    return y.groupBy(*group).agg(
        F.count(F.lit(1)).alias("years_with_bets"), F.sum("bets").alias("bets"), F.min("bets").alias("min_yearly_bets"),
        F.min("r").alias("year_roi_min"), F.avg("r").alias("year_roi_mean"), F.stddev_pop("r").alias("year_roi_std"),
        F.count_if(F.col("r") >= 90.0).alias("years_roi_ge_90"), F.try_divide(100.0 * F.sum("ret"), F.sum("bets") * STAKE).alias("roi"))


# Weights of the reliability score (name -> (column, weight, higher is better)).
RELIABILITY = {
    "combined_roi": ("roi", 0.15, True),
    "minimum_year_roi": ("year_roi_min", 0.25, True),
    "bootstrap_lower": ("bootstrap_lower", 0.20, True),
    "top5_removed_roi": ("top5_removed_roi", 0.20, True),
    "sample_size": ("bets", 0.10, True),
    "roi_stability": ("year_roi_std", 0.05, False),
    "drawdown": ("max_drawdown", 0.05, False),
}


def min_max(c: str, higher_better: bool = True) -> Column:
    """Min-max score over the (tiny, one row per band) table; constant column gives 0.5, null gives 0."""
    w = W.partitionBy(F.lit(0))
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    s = F.when(lo.isNull() | (lo == hi), 0.5).otherwise((F.col(c) - lo) / (hi - lo))
    return F.coalesce(s if higher_better else 1.0 - s, F.lit(0.0))


def band_reliability(bands: DataFrame, weights: dict = RELIABILITY, main_roi: float = 95.0, main_removed: float = 90.0,
                     min_bets: int = 300, min_years: int = 4, min_yearly: int = 30) -> DataFrame:
    """Weighted reliability score, class main/support/exclude and derived thresholds per band."""
    score = F.lit(0.0)
    for column, weight, up in weights.values():
        score = score + weight * min_max(column, up)
    main = ((F.col("years_with_bets") >= min_years) & (F.col("bets") >= min_bets) & (F.col("min_yearly_bets") >= min_yearly)
            & (F.col("roi") >= main_roi) & (F.col("top5_removed_roi") >= main_removed))
    cls = F.when(main, "main").when((F.col("bets") >= min_bets) & (F.col("roi") >= 85), "support").otherwise("exclude")
    out = bands.withColumn("reliability_score", score).withColumn("band_class", cls)
    by_class = {"main": (0.90, -0.15), "support": (0.85, -0.20)}
    inf = F.lit(float("inf"))
    for i, name in enumerate(("ev_threshold", "edge_threshold")):
        out = out.withColumn(name, F.when(F.col("band_class") == "main", by_class["main"][i])
                             .when(F.col("band_class") == "support", by_class["support"][i]).otherwise(inf))
    return out


# EV band edges, left closed.
EV_EDGES = (float("-inf"), 0.85, 0.90, 0.95, 1.00, 1.02, 1.05, 1.10, float("inf"))


def ev_band_order(ev: Column, edges: Sequence[float] = EV_EDGES) -> Column:
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (ev >= e).cast("int")
    return F.when(X.is_finite(ev), out)


def ev_band_roi(df: DataFrame, group: Sequence[str], ev: Column, pay: str) -> DataFrame:
    """ROI per EV band with a flag whether it is at least that of the band below."""
    b = df.withColumn("ev_band", ev_band_order(ev)).filter("ev_band is not null").groupBy(*group, "ev_band").agg(
        F.count(F.lit(1)).alias("bets"), F.sum(F.coalesce(F.col(pay), F.lit(0))).alias("return"))
    b = b.withColumn("roi", 100.0 * F.col("return") / (F.col("bets") * STAKE))
    prev = F.lag("roi").over(W.partitionBy(*group).orderBy("ev_band"))  # at most eight rows per group
    return b.withColumn("monotone", prev.isNull() | (F.col("roi") >= prev))


def ev_spearman(bands: DataFrame, group: Sequence[str]) -> DataFrame:
    # a few bands: once written their size is known, and both rankings stay in one task
    bands = materialise(bands.select(*group, "ev_band", "roi"), "ev-bands")
    d = average_ranks(average_ranks(bands, group, "ev_band", "_a"), group, "roi", "_b")
    return d.groupBy(*group).agg(F.count(F.lit(1)).alias("bands"), pearson("_a", "_b").alias("spearman"))


def ev_crossing(df: DataFrame, group: Sequence[str], base_ev: Column, model_ev: Column) -> DataFrame:
    a, b = X.at_least(base_ev, 1.0), X.at_least(model_ev, 1.0)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(a).alias("base_ge_1"), F.count_if(b).alias("model_ge_1"),
        F.count_if(~a & b).alias("up_crossings"), F.count_if(a & ~b).alias("down_crossings"), F.avg(b.cast("int")).alias("model_ge_1_rate"))


def pick_frequency(df: DataFrame, group: Sequence[str], day: str, ev: Column, thresholds: Sequence[float]) -> DataFrame:
    """Picks per year, month and active day at every threshold.

    Rows are first reduced to one per (group, day, threshold step), so thresholds never multiply raw rows.
    """
    step = F.lit(0)
    for t in thresholds:
        step = step + X.at_least(ev, t).cast("int")
    d = df.withColumn("_step", step).filter("_step > 0").groupBy(*group, day, "_step").agg(F.count(F.lit(1)).alias("n"))
    levels = F.transform(F.sequence(F.lit(1), F.col("_step")), lambda i: i)
    d = d.select(*group, day, "n", F.explode(levels).alias("_i")).groupBy(*group, "_i", day).agg(F.sum("n").alias("n"))
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    out = d.groupBy(*group, "_i").agg(F.sum("n").alias("picks"), F.count(F.lit(1)).alias("active_days"),
                                      F.count_distinct(F.date_trunc("month", day)).alias("active_months"))
    return out.select(*group, F.element_at(values, F.col("_i")).alias("threshold"), "picks", "active_days", "active_months",
                      (F.col("picks") / F.col("active_days")).alias("picks_per_active_day"),
                      (F.col("picks") / F.col("active_months")).alias("picks_per_active_month"))


def staked_summary(df: DataFrame, group: Sequence[str], methods: dict[str, Column], pay: str) -> DataFrame:
    """Stake comparison: one summary row per (group, method); payout scales with the stake."""
    long = df.select(*group, F.coalesce(F.col(pay), F.lit(0)).alias("_pay"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("stake_method"), c.cast("double").alias("_stake")) for n, c in methods.items()]))).filter("_stake > 0")
    return long.groupBy(*group, "stake_method").agg(
        F.count(F.lit(1)).alias("bets"), F.sum("_stake").alias("stake"), F.sum(F.col("_pay") * F.col("_stake") / STAKE).alias("return"),
        F.try_divide(100.0 * F.sum(F.col("_pay") * F.col("_stake") / STAKE), F.sum("_stake")).alias("roi"))


def strategy_bets(df: DataFrame, strategies: dict[str, Column]) -> DataFrame:
    """Rows tagged with every named strategy they satisfy (one map-side explode, no join)."""
    tags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in strategies.items()]))
    return df.withColumn("strategy", F.explode(tags))


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], pay: str) -> DataFrame:
    """Common / only-a / only-b bets with Jaccard and the ROI of each part (one row)."""
    x = a.select(*keys, F.coalesce(F.col(pay), F.lit(0)).alias("_pa"))
    y = b.select(*keys, F.coalesce(F.col(pay), F.lit(0)).alias("_pb"))
    j = x.join(y, list(keys), "full")
    ina, inb = F.col("_pa").isNotNull(), F.col("_pb").isNotNull()
    pay_of = F.coalesce("_pa", "_pb")

    def part(cond, name):
        return [F.count_if(cond).alias(f"{name}_bets"),
                F.try_divide(100.0 * F.sum(F.when(cond, pay_of)), F.count_if(cond) * STAKE).alias(f"{name}_roi")]

    return j.agg(*part(ina & inb, "common"), *part(ina & ~inb, "only_a"), *part(~ina & inb, "only_b"),
                 F.try_divide(F.count_if(ina & inb), F.count(F.lit(1))).alias("jaccard"))
