"""Integration: slot unpivot, wide left joins, validated joins, comparison joins, settlement joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.functions.sizes import broadcast_if_small


def slot_unpivot(df: DataFrame, keys: Sequence[str], slots: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Wide payout slots (number, pay, popularity) to rows in one scan; blank numbers are dropped."""
    items = [F.struct(F.lit(i + 1).alias("slot"), F.col(n).cast("string").alias("number"), F.col(p).cast("string").alias("pay"),
                      F.col(q).cast("string").alias("popularity")) for i, (n, p, q) in enumerate(slots)]
    long = df.select(*keys, F.inline(F.array(*items))).filter(~X.is_blank(F.col("number")))
    return long.select(*keys, "slot", F.col("number").try_cast("int").alias("number"), F.col("pay").try_cast("long").alias("pay"),
                       F.col("popularity").try_cast("int").alias("popularity"))


def combine_slots(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (contest, number): of duplicate slots the largest payout counts and their number is kept, so a join cannot fan out."""
    return long.groupBy(*keys, "number").agg(F.max("pay").alias("pay"), F.min("popularity").alias("pay_popularity"),
                                             F.count(F.lit(1)).alias("slot_count"))


def left_found(left: DataFrame, right: DataFrame, keys: Sequence[str], found: str) -> DataFrame:
    """Left equi-join on a composite key with a found flag; a side below the checked bound is broadcast."""
    r = broadcast_if_small(right.withColumn(found, F.lit(True)))
    return left.join(r, list(keys), "left").withColumn(found, F.coalesce(F.col(found), F.lit(False)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_check(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicates on each side and rows without partner, as one row (contract of a validated join)."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, list(keys), "full").agg(
        F.count_if(F.col("a") > 1).alias("left_duplicates"), F.count_if(F.col("b") > 1).alias("right_duplicates"),
        F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "m:1", require_all: bool = True) -> DataFrame:
    """Left join that raises inside the job when the key contract is broken (no extra pass on the driver)."""
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in right.columns if c not in keys])).alias("_r"))
    r = r.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key on the right side"))).otherwise(F.col("_n")))
    if validate == "1:1":
        left = left.join(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ln")), list(keys))
        left = left.filter(F.when(F.col("_ln") > 1, F.raise_error(F.lit("duplicate key on the left side"))).otherwise(F.lit(True))).drop("_ln")
    j = left.join(r, list(keys), "left")
    if require_all:
        j = j.filter(F.when(F.col("_n").isNull(), F.raise_error(F.lit("missing partner"))).otherwise(F.col("_n") == 1))
    return j.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in right.columns if c not in keys])


def compare_full(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes=("_left", "_right")) -> DataFrame:
    """Full outer comparison join with a side indicator."""
    def side(df, s):
        return df.select(*keys, *[F.col(c).alias(c + s) for c in df.columns if c not in keys], F.lit(True).alias("_in" + s))

    a, b = suffixes
    j = side(left, a).join(side(right, b), list(keys), "full")
    ina, inb = F.col("_in" + a).isNotNull(), F.col("_in" + b).isNotNull()
    return j.withColumn("side", F.when(ina & inb, "both").when(ina, "left_only").otherwise("right_only")).drop("_in" + a, "_in" + b)


def missing_both_ways(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = left.join(right, list(keys), "left_anti").select(*keys, F.lit("missing_in_right").alias("status"))
    b = right.join(left, list(keys), "left_anti").select(*keys, F.lit("missing_in_left").alias("status"))
    return a.unionByName(b)


def model_columns(predictions: DataFrame, entry: str, model: str, p: str, models: Sequence[str]) -> DataFrame:
    """N prediction sets to one row per entry with a single shuffle (pivot over a known model list)."""
    return predictions.groupBy(entry).pivot(model, list(models)).agg(F.max(p))


def payout_match(entries: DataFrame, slots: DataFrame, keys: Sequence[str], number: str, rank: Column, limit: Column,
                 by: Sequence[str] = ()) -> DataFrame:
    """Entries within the rank limit against payout slots: eligible, matched, missing and slots paid outside the limit."""
    s = combine_slots(slots, keys).withColumnRenamed("number", number)
    j = entries.withColumn("_ok", F.coalesce((rank >= 1) & (rank <= limit), F.lit(False))).join(s, [*keys, number], "left")
    hit = F.col("slot_count").isNotNull()
    out = j.groupBy(*by).agg if by else j.agg
    return out(F.count_if("_ok").alias("eligible"), F.count_if(F.col("_ok") & hit).alias("matched"),
               F.count_if(F.col("_ok") & ~hit).alias("missing"), F.count_if(~F.col("_ok") & hit).alias("paid_outside_limit"),
               F.coalesce(F.sum(F.when(F.col("_ok"), F.col("pay"))), F.lit(0)).alias("matched_pay"))


def contest_sample(contests: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` contests of a report (top-k, at most ``k`` rows, so safe to broadcast)."""
    return F.broadcast(contests.select(key, *[o.alias(f"_o{i}") for i, o in enumerate(order)]).distinct()
                       .orderBy(*[f"_o{i}" for i in range(len(order))], key).limit(k).select(key))


def joined_sample(entries: DataFrame, order: Sequence[Column], k: int, sources: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """The first ``k`` entries of a report left-joined to every source by its own keys, with a ``joined_<name>`` flag (0 or 1) each.

    The sample has at most ``k`` rows, so its keys are broadcast and every source is cut to them before the join; no source is
    shuffled.  A source with several rows for a key repeats the entry; columns of a source must not clash with the entry's.
    """
    out = F.broadcast(entries.orderBy(*order).limit(k))
    for name, (df, keys) in sources.items():
        mine = df.join(F.broadcast(out.select(*keys).distinct()), list(keys), "left_semi").withColumn(f"joined_{name}", F.lit(1))
        out = out.join(mine, list(keys), "left").fillna(0, [f"joined_{name}"])
    return out


def quote_relation(first: Column, second: Column, tolerance: float = 1e-4) -> Column:
    """How two quotes of one entry relate: missing_or_zero, same, first_10x, second_10x or different."""
    def near(x: Column, y: Column) -> Column:
        return F.abs(x - y) < tolerance

    absent = first.isNull() | second.isNull() | F.isnan(first) | F.isnan(second) | (first == 0) | (second == 0)
    return (F.when(absent, "missing_or_zero").when(near(first, second), "same").when(near(first / 10, second), "first_10x")
            .when(near(first, second / 10), "second_10x").otherwise("different"))


def settle(tiers: DataFrame, predictions: DataFrame, settlements: DataFrame, keys: Sequence[str], key_of_settlement: Sequence[str]) -> DataFrame:
    """Tiers with their prediction, left-joined to settlements; unmatched rows are pending."""
    s = settlements.withColumn("_hit", F.lit(1))
    j = tiers.join(predictions, list(keys)).join(s, list(key_of_settlement), "left")
    return j.withColumn("status", F.when(F.col("_hit").isNull(), "pending").otherwise("settled")).drop("_hit")
