"""Operators within a contest: normalisation, ranks, confidence, complete contests, binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.functions.ordered import HOT_ROWS, by_group, is_sliced, join_stats, quantiles, row_numbers, running, with_group
from pitpanel.sources.workdir import materialise


def normalise(df: DataFrame, group: Sequence[str], value: Column, name: str, hot_rows: int | None = None) -> DataFrame:
    """value / sum(value) in the group, as a window after one shuffle by group; hot groups through a balanced join."""
    d = df.withColumn("_v", value)

    def whole(d: DataFrame) -> DataFrame:
        return d.withColumn("_sum", F.sum("_v").over(W.partitionBy(*group)))

    def sliced(d: DataFrame) -> DataFrame:
        return with_group(d, group, hot_rows=hot_rows or HOT_ROWS, _sum=F.sum("_v"))

    out = by_group(d, group, whole, sliced, hot_rows) if group else sliced(d)
    return out.withColumn(name, F.try_divide("_v", "_sum")).drop("_v", "_sum")


def ratios(df: DataFrame, group: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Ratio to the group minimum and mean; zero denominators give null."""
    out = with_group(df, group, _min=F.min(value), _avg=F.avg(value))
    return out.withColumns({f"{prefix}_ratio_min": F.try_divide(F.col(value), F.nullif(F.col("_min"), F.lit(0.0))),
                            f"{prefix}_ratio_mean": F.try_divide(F.col(value), F.nullif(F.col("_avg"), F.lit(0.0)))}).drop("_min", "_avg")


def fill_rank(df: DataFrame, group: Sequence[str], rank: str, value: str, tie: str, name: str) -> DataFrame:
    """Given rank, else the rank of ``value`` ascending in the group (ties by ``tie``, nulls last)."""
    order = [F.col(value).isNull(), F.col(value), F.col(tie)]
    out = row_numbers(df, group, order, "_rn")
    return out.withColumn(name, F.coalesce(F.col(rank), F.when(F.col(value).isNotNull(), F.col("_rn")))).drop("_rn")


def model_rank(df: DataFrame, group: Sequence[str], p: str, tie: str, name: str = "model_rank",
               slices: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Position by probability descending, tie-breaker ascending: a window after one shuffle by group; hot groups go by slices."""
    order = [-F.col(p), F.col(tie)]

    def whole(d: DataFrame) -> DataFrame:
        return d.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long"))

    def sliced(d: DataFrame) -> DataFrame:
        return row_numbers(fixed(d, slices), group, order, name, slices)

    return sliced(df) if slices is not None or not group else by_group(df, group, whole, sliced, hot_rows)


def fixed(df: DataFrame, slices: int | None = None) -> DataFrame:
    """Rows that are ranked by slices, written first: a probability that comes from a float sum can differ in its last digit from one
    evaluation to the next, and the edges, the slices and their offsets must all read the same one."""
    return materialise(df, "ranked-rows") if is_sliced(df, slices) else df


def contest_view(df: DataFrame, group: Sequence[str], p: str, value: Column, share: str, tie: str, others: dict[str, str] | None = None,
                 hot_rows: int | None = None) -> DataFrame:
    """``share`` = value / sum(value), ``model_rank`` by ``p``, ``market_rank`` by the share, ranks by ``others``, margin and entropy of ``p``.

    All of them are windows after one shuffle by group; hot groups go by slices.  Probabilities descend, nulls last, ties by ``tie``.
    """
    ranks = {"model_rank": p, "market_rank": share, **(others or {})}

    def whole(d: DataFrame) -> DataFrame:
        g = W.partitionBy(*group)
        d = d.withColumn("_v", value).withColumns({"_sum": F.sum("_v").over(g), "_all": F.sum(p).over(g), "_size": F.count(F.lit(1)).over(g)})
        d = d.withColumn(share, F.try_divide("_v", "_sum")).withColumn("_q", F.try_divide(p, "_all"))
        for name, by in reversed(list(ranks.items())):
            d = d.withColumn(name, F.row_number().over(g.orderBy(F.col(by).desc_nulls_last(), F.col(tie))).cast("long"))
        best = [F.max(F.when(F.col("model_rank") == k, F.col(p))).over(g) for k in (1, 2)]
        h = F.sum(F.when(F.col("_q") > 0, -F.col("_q") * F.log("_q")).otherwise(0.0)).over(g)
        d = d.withColumns({"margin": best[0] - F.coalesce(best[1], F.lit(0.0)), "entropy": h / F.log(F.greatest(F.col("_size"), F.lit(2)).cast("double"))})
        return d.drop("_v", "_sum", "_all", "_size", "_q")

    def sliced(d: DataFrame) -> DataFrame:
        out = fixed(normalise(d, group, value, share))
        for name, by in ranks.items():
            # ascending keys: numbers before nulls, NaN above all numbers
            out = row_numbers(out, group, [F.col(by).isNull(), ~F.isnan(by), -F.col(by), F.col(tie)], name)
        conf = confidence_by_group(d, group, p, tie).select(*group, "size", "margin", "entropy")
        return join_stats(out, conf, group, ["margin", "entropy"], "size")

    return by_group(df, group, whole, sliced, hot_rows)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark limits every group before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def one_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Best row per group by a tie chain, as one map-side combined aggregate."""
    rest = [c for c in df.columns if c not in group]
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*group).agg(F.min_by(F.struct(*rest), o).alias("_r"))
    return best.select(*group, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def confidence_by_group(df: DataFrame, group: Sequence[str], p: str, tie: str) -> DataFrame:
    """Per group: best three values, margin (missing second counts 0), top-3 sum, normalised entropy, best entry.

    The best three come from a ranked filter, entropy and size from a plain aggregate: no group is collected.
    """
    best = (df.select(*group, p, tie)
            .withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(F.col(p).desc(), F.col(tie))))
            .filter("_rn <= 3").groupBy(*group).agg(
                *[F.max(F.when(F.col("_rn") == k, F.col(p))).alias(f"top{k}") for k in (1, 2, 3)],
                F.max(F.when(F.col("_rn") == 1, F.col(tie))).alias("top_entry")))
    q = F.try_divide(p, "_sum")
    totals = df.groupBy(*group).agg(F.sum(p).alias("_sum"), F.count(F.lit(1)).alias("size"))
    norm = with_group(df.select(*group, p), group, _sum=F.sum(p))
    ent = norm.groupBy(*group).agg(F.sum(F.when(q > 0, -q * F.log(q)).otherwise(0.0)).alias("_h"))
    out = totals.join(ent, list(group)).join(best, list(group))
    return out.select(*group, "size", "top1", "top2", "top3", "top_entry",
                      (F.col("top1") - F.coalesce("top2", F.lit(0.0))).alias("margin"),
                      (F.col("top1") + F.coalesce("top2", F.lit(0.0)) + F.coalesce("top3", F.lit(0.0))).alias("top3_sum"),
                      (F.col("_h") / F.log(F.greatest(F.col("size"), F.lit(2)).cast("double"))).alias("entropy"))


def agreement(top: DataFrame, group: Sequence[str], model: str, entry: str) -> DataFrame:
    """Per (group, model): how many models pick the same best entry."""
    votes = top.groupBy(*group, entry).agg(F.count(F.lit(1)).alias("agreement"))
    return top.join(votes, [*group, entry]).select(*group, model, entry, "agreement")


def cumulative(df: DataFrame, group: Sequence[str], order: Sequence[Column], stake: str, pay: str,
               slices: int | None = None) -> DataFrame:
    """Running stake, return, profit and ROI over ordered bets of each strategy."""
    out = running(df, group, order, {"cum_stake": F.col(stake), "cum_return": F.col(pay)}, slices)
    return out.withColumns({"cum_profit": F.col("cum_return") - F.col("cum_stake"),
                            "cum_roi": F.try_divide(100.0 * F.col("cum_return"), F.col("cum_stake"))})


def year_over_year(yearly: DataFrame, group: Sequence[str], year: str, value: str) -> DataFrame:
    """Ratio and absolute delta to the previous year (one row per group and year)."""
    prev = F.lag(value).over(W.partitionBy(*(group or [F.lit(0)])).orderBy(year))
    return yearly.withColumns({f"{value}_ratio": F.try_divide(F.col(value), prev), f"{value}_delta": F.abs(F.col(value) - prev)})


# Reasons in priority order.
REASONS = ("duplicate_entry_id", "invalid_actual", "missing_winner", "missing_odds_runner", "invalid_odds_runner",
           "missing_model_prediction", "runner_count_mismatch")


def contest_reasons(df: DataFrame, contest: str, entry: str, actual: str, odds: str, models: Sequence[str],
                    eligible: str | None = None) -> DataFrame:
    """Per contest: first reason why it is not complete, '' when it is."""
    ok_odds = F.coalesce(F.col(odds) > 0, F.lit(False))
    missing = [F.col(m).isNull() for m in models]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    ok_actual = F.coalesce(F.col(actual).isin(0, 1), F.lit(False))
    expected = F.coalesce(F.col(eligible), F.lit(False)) if eligible else F.lit(True)
    per_entry = df.groupBy(contest, entry).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ok_actual).alias("bad"), F.count_if(F.col(actual) == 1).alias("pos"),
        F.count_if(F.col(odds).isNull()).alias("no_odds"), F.count_if(F.col(odds).isNotNull() & ~ok_odds).alias("bad_odds"),
        F.count_if(any_missing).alias("no_pred"), F.count_if(ok_odds & ~any_missing & ok_actual).alias("valid"),
        F.count_if(expected).alias("expected"))
    c = per_entry.groupBy(contest).agg(F.count_if(F.col("n") > 1).alias("dup"), *[
        F.sum(x).alias(x) for x in ("bad", "pos", "no_odds", "bad_odds", "no_pred", "valid", "expected")])
    checks = [F.col("dup") > 0, F.col("bad") > 0, F.col("pos") < 1, F.col("no_odds") > 0, F.col("bad_odds") > 0,
              F.col("no_pred") > 0, F.col("valid") != F.col("expected")]
    out = F.when(checks[0], REASONS[0])
    for cond, name in list(zip(checks, REASONS))[1:]:
        out = out.when(cond, name)
    return c.select(contest, out.otherwise("").alias("reason"))


def complete_contests(df: DataFrame, reasons: DataFrame, contest: str) -> DataFrame:
    return df.join(reasons.filter(F.col("reason") == ""), contest, "left_semi")


def rank_bins(df: DataFrame, value: str, tie: str, bins: int, slices: int | None = None) -> DataFrame:
    """Equal-population bins by global position: floor((rn-1)*bins/n)."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = row_numbers(df.withColumn("_g", F.lit(0)), ["_g"], [F.col(value), F.col(tie)], "_rn", slices)
    return out.withColumn("bin", F.floor((F.col("_rn") - 1) * bins / n).cast("int")).drop("_g", "_rn")


def value_bins(df: DataFrame, value: str, bins: int, slices: int | None = None) -> DataFrame:
    """Bins over the distinct values, larger parts first; equal values share a bin, null has none."""
    distinct = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.lit(0))
    m = distinct.agg(F.count(F.lit(1)).alias("m")).scalar()
    out = row_numbers(distinct, ["_g"], [F.col(value)], "_rn", slices)
    small, extra = F.floor(m / bins), m % bins
    cut = extra * (small + 1)
    i = F.col("_rn") - 1
    b = F.when(i < cut, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - cut) / F.greatest(small, F.lit(1))))
    lookup = out.select(value, "_n", b.cast("int").alias("bin"))
    return join_stats(df, lookup, [value], ["bin"], "_n", split=None if slices is None else True, nulls_match=False)


def quantile_bins(df: DataFrame, value: str, bins: int, slices: int | None = None) -> DataFrame:
    """Bins between linear-interpolated quantile edges (closed right, lowest included, duplicate edges dropped)."""
    q = quantiles(df, [], value, [i / bins for i in range(bins + 1)], slices)
    edges = q.select(F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)]))).scalar()
    inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
    return df.withColumn("_e", edges).withColumn("bin", F.size(F.filter(inner, lambda e: F.col(value) > e))).drop("_e")
