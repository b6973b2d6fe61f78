"""Labels, eligibility and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import with_group
from pitpanel.spec import PanelSpec


def group_flags(df: DataFrame, s: PanelSpec = PanelSpec()) -> DataFrame:
    """Contest-level flags on every entry."""
    def any_positive(c):
        return F.max(F.coalesce(F.col(c), F.lit(0))) > 0

    out = with_group(df, [s.contest], has_result=any_positive(s.rank), has_win_payout=any_positive(s.win_pay),
                     has_place_payout=any_positive(s.place_pay))
    return out.withColumn("is_finalized", F.expr("has_result and (has_win_payout or has_place_payout)"))


def place_limit(field_size: Column, rule: str = "standard") -> Column:
    """Paid ranks: standard <=4 -> 0, <=7 -> 2, else 3 (null -> 3); simple >=8 -> 3 else 2."""
    if rule == "simple":
        return F.when(field_size >= 8, 3).otherwise(2)
    return F.when(field_size <= 4, 0).when(field_size <= 7, 2).otherwise(3)


def split_name(year: Column, splits: dict[int, str], default: str = "out_of_scope") -> Column:
    """Year -> split as one map lookup."""
    pairs = [F.lit(v) for kv in splits.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), year), F.lit(default))


def exclusion_reason(kind: str, s: PanelSpec = PanelSpec()) -> Column:
    """First reason that excludes an entry from training of the kind; '' when eligible."""
    out = F.when(~F.coalesce(F.col("has_result"), F.lit(False)), "no_result")
    if kind in ("win", "place"):
        out = out.when(~F.coalesce(F.col(f"has_{kind}_payout"), F.lit(False)), f"no_{kind}_payout")
    out = out.when(~F.col(s.status).eqNullSafe(F.lit("0")), "abnormal_or_cancelled")
    if kind == "ranking":
        out = out.when(~F.coalesce(X.is_positive(F.col(s.rank)), F.lit(False)), "missing_rank")
    return (out.when(~F.coalesce(F.col(s.number) > 0, F.lit(False)), "invalid_entry_no")
            .when(~X.is_valid_id(F.col(s.runner)), "invalid_runner_id").otherwise(""))


def rank_targets(s: PanelSpec = PanelSpec()) -> dict[str, Column]:
    status, rank = F.col(s.status), F.col(s.rank)
    normal = (status == "0") & (rank > 0)
    limit = place_limit(F.col(s.field_size))
    by_rule = F.col(s.field_size) >= 5
    return {
        "place_rank_limit": limit,
        "place_bet_by_rule": by_rule,
        "is_normal": normal.cast("byte"),
        "target_win_rank": (normal & (rank == 1)).cast("byte"),
        "target_top2_rank": (normal & (rank <= 2)).cast("byte"),
        "target_top3_rank": (normal & (rank <= 3)).cast("byte"),
        "target_win_paid": (F.coalesce(F.col(s.win_pay), F.lit(0)) > 0).cast("byte"),
        "target_place_paid": (F.coalesce(F.col(s.place_pay), F.lit(0)) > 0).cast("byte"),
        "target_place_by_rule": (normal & by_rule & (rank <= limit)).cast("byte"),
    }


def add_targets(df: DataFrame, s: PanelSpec = PanelSpec()) -> DataFrame:
    """Group flags, rank and paid targets, availability, exclusion reasons and eligibility."""
    out = group_flags(df, s).withColumns(rank_targets(s))
    out = out.withColumn("win_odds_available", X.is_positive(F.col(s.win_odds)))
    out = out.withColumns({f"{k}_exclusion": exclusion_reason(k, s) for k in ("win", "place", "ranking")})
    return out.withColumns({f"eligible_{k}": F.col(f"{k}_exclusion") == "" for k in ("win", "place", "ranking")})


def split_overlap(df: DataFrame, split: str, ids: Sequence[str]) -> DataFrame:
    """Number of ids that occur in more than one split, per id column; min/max need no distinct set."""
    parts = None
    for c in ids:
        part = (df.groupBy(c).agg((F.min(split) != F.max(split)).alias("_multi"))
                .agg(F.lit(c).alias("id_column"), F.count_if("_multi").alias("overlapping_ids")))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def class_balance(df: DataFrame, split: str, targets: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows, positives and rate by target and split; ``targets`` maps name -> (label, eligibility)."""
    long = df.select(split, F.inline(F.array(*[
        F.struct(F.lit(n).alias("target"), F.col(y).cast("int").alias("y"), F.col(e).alias("ok"))
        for n, (y, e) in targets.items()]))).filter("ok")
    return long.groupBy("target", split).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positive"),
        (F.count(F.lit(1)) - F.sum("y")).alias("negative"), F.avg("y").alias("positive_rate"))


def target_frame(df: DataFrame, label: str, eligible: str) -> DataFrame:
    return df.filter(F.col(eligible)).withColumn("target", F.col(label).cast("byte"))


def positives_without_payout(df: DataFrame, label: str, pay: str) -> DataFrame:
    """Guard: number of positive labels whose payout is missing or zero (must be 0 for paid targets)."""
    return df.agg(F.count_if((F.col(label) == 1) & ~F.coalesce(F.col(pay) > 0, F.lit(False))).alias("violations"))


def yearly_summary(df: DataFrame, s: PanelSpec = PanelSpec(), cutoff: str = "cutoff_day") -> DataFrame:
    """Rows, contests, finalised contests, duplicates, cutoff violations and training rows by year.

    Contests and entries are first reduced to one row each, so no task holds a distinct set.
    """
    per_entry = df.groupBy(s.year, s.contest, s.entry).agg(
        F.count(F.lit(1)).alias("n"), F.max("is_finalized").alias("fin"),
        F.count_if(F.col(cutoff) >= F.col(s.day)).alias("bad"),
        *[F.count_if(F.col(f"eligible_{k}")).alias(k) for k in ("win", "place", "ranking")])
    per_contest = per_entry.groupBy(s.year, s.contest).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("entries"), F.max("fin").alias("fin"), F.sum("bad").alias("bad"),
        *[F.sum(k).alias(k) for k in ("win", "place", "ranking")])
    return per_contest.groupBy(s.year).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("contests"), F.count_if("fin").alias("finalized"),
        (F.count(F.lit(1)) - F.count_if("fin")).alias("unfinalized"), (F.sum("n") - F.sum("entries")).alias("entry_duplicates"),
        F.sum("bad").alias("cutoff_violations"),
        *[F.sum(k).alias(f"{k}_training_rows") for k in ("win", "place", "ranking")])


def feature_inventory(df: DataFrame, sets: dict[str, Sequence[str]]) -> DataFrame:
    """Every feature of every set: whether the frame has it, its type, rows, nulls and null rate, in one pass over the frame."""
    wanted = sorted({f for fs in sets.values() for f in fs})
    kinds = dict(df.dtypes)
    nulls = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f).isNull()).alias(f) for f in wanted if f in kinds])
    items = [F.struct(F.lit(s).alias("feature_set"), F.lit(f).alias("feature"), F.lit(f in kinds).alias("present"), F.lit(kinds.get(f)).cast("string").alias("dtype"),
                      (F.col(f) if f in kinds else F.lit(None).cast("long")).alias("nulls")) for s, fs in sets.items() for f in fs]
    return nulls.select("rows", F.inline(F.array(*items))).select("feature_set", "feature", "present", "dtype", "rows", "nulls", F.try_divide("nulls", "rows").alias("null_rate"))
