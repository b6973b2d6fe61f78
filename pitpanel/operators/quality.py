"""Data-quality audits: coverage, missingness, encodings, patterns, profiles, diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import quantiles, running, stored_if_large, with_group
from pitpanel.operators.metrics import join_groups


def count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def pair_valid(low: Column, high: Column) -> Column:
    return X.is_valid_quote(low) & X.is_valid_quote(high)


def coverage(joined: DataFrame, by: Sequence[Column], found: str, win: str, low: str, high: str) -> DataFrame:
    """Matched, missing, valid, null and invalid rows for two quote types with coverage rates."""
    f, w = F.col(found), F.col(win)
    a, b = F.col(low), F.col(high)
    n = F.count(F.lit(1))
    valid_win, valid_place = F.count_if(f & X.is_valid_quote(w)), F.count_if(f & pair_valid(a, b))
    return joined.groupBy(*by).agg(
        n.alias("rows"), count(f, "matched"), count(~f, "missing"), valid_win.alias("valid_win"),
        count(f & X.is_blank(w), "null_win"), count(f & X.is_invalid_quote(w), "invalid_win"), valid_place.alias("valid_place"),
        count(f & (X.is_blank(a) | X.is_blank(b)), "null_place"), count(f & (X.is_invalid_quote(a) | X.is_invalid_quote(b)), "invalid_place"),
        F.try_divide(F.count_if(f), n).alias("match_rate"), F.try_divide(valid_win, n).alias("win_rate"), F.try_divide(valid_place, n).alias("place_rate"))


def dimension_missingness(joined: DataFrame, dimensions: dict[str, Column], found: str, valid: Column, top: int | None = None) -> DataFrame:
    """Missingness along all dimensions in one GROUPING SETS pass; every value, or only the ``top`` most frequent of each if asked."""
    names = list(dimensions)
    d = joined.select(*[F.coalesce(c.cast("string"), F.lit("(null)")).alias(n) for n, c in dimensions.items()],
                      F.col(found).alias("_f"), valid.alias("_v"))
    g = d.groupingSets([[n] for n in names], *names).agg(F.count(F.lit(1)).alias("rows"), count(~F.col("_f"), "missing"), count(F.col("_f") & F.col("_v"), "valid"))
    out = g.select(F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]).alias("dimension"), F.coalesce(*names).alias("value"),
                   "rows", "missing", "valid", F.try_divide("valid", "rows").alias("valid_rate"))
    if top is None:
        return out
    w = W.partitionBy("dimension").orderBy(F.col("rows").desc(), F.col("value"))
    return out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top).drop("_rn")


def value_encoding(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null, empty, zero, negative, sentinel, min and max of each column in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        x, v = F.col(c), X.number(F.col(c))
        empty = x.isNotNull() & (X.text(x) == "")
        aggs += [count(x.isNull(), f"a{i}"), count(empty, f"b{i}"), count(x.isNotNull() & ~empty & (v == 0), f"c{i}"), count(v < 0, f"d{i}"),
                 count(v.isin(*X.SENTINELS), f"e{i}"), F.min(v).alias(f"f{i}"), F.max(v).alias(f"g{i}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    names = ("null_count", "empty_count", "zero_count", "negative_count", "sentinel_count", "min_value", "max_value")
    return one.select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{x}{i}").alias(n) for x, n in zip("abcdefg", names)]) for i, c in enumerate(columns)])))


def missing_contest_samples(joined: DataFrame, contest: str, order: Sequence[Column], missing: Column, k: int) -> DataFrame:
    """Entries of the first ``k`` contests with at least one missing quote (a top-k report)."""
    g = joined.groupBy(contest, *[o.alias(f"_o{i}") for i, o in enumerate(order)]).agg(
        F.count_if(missing).alias("missing_rows"), F.count(F.lit(1)).alias("entries")).filter("missing_rows > 0")
    top = g.orderBy(*[f"_o{i}" for i in range(len(order))], contest).limit(k).select(contest, "missing_rows", "entries")
    return joined.join(F.broadcast(top), contest)


def schema_summary(df: DataFrame, table: str) -> DataFrame:
    """Column names and types with null counts."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(t).alias("dtype"),
                                                  F.col(c).alias("nulls")) for c, t in df.dtypes])))


def duplicate_key_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(count(F.col("n") > 1, "duplicate_keys"), F.sum("n").alias("rows"),
                                                                    F.count(F.lit(1)).alias("distinct_keys"))


def status_cross(joined: DataFrame, by: Sequence[Column], contest: str, measures: dict[str, Column]) -> DataFrame:
    """Cross-tab with row counts, contest counts (two-level, no distinct sets) and conditional counts."""
    names = [f"k{i}" for i in range(len(by))]
    first = joined.groupBy(*[c.alias(n) for c, n in zip(by, names)], contest).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(m) for m, c in measures.items()])
    return first.groupBy(*names).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("contests"), *[F.sum(m).alias(m) for m in measures])


def flag_values(df: DataFrame, flags: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    d = df.select(*[c.alias(m) for m, c in measures.items()], F.inline(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in flags])))
    return d.groupBy("flag", "value").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(m).alias(m) for m in measures])


def contest_patterns(joined: DataFrame, by: Sequence[str], found: str, win: str, low: str, high: str, missing_policy: str = "any") -> DataFrame:
    """all_valid / all_null / partially_valid / missing_rows per contest for both quote types.

    ``missing_policy``: 'any' names a contest missing when one row is missing, 'all' only when all are.
    """
    f = F.col(found)
    g = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"), count(~f, "missing"), count(f & X.is_valid_quote(F.col(win)), "win_valid"),
        count(f & X.is_blank(F.col(win)), "win_null"), count(f & pair_valid(F.col(low), F.col(high)), "place_valid"),
        count(f & (X.is_blank(F.col(low)) | X.is_blank(F.col(high))), "place_null"))
    gone = F.col("missing") > 0 if missing_policy == "any" else F.col("missing") == F.col("entries")

    def pattern(v):
        return (F.when(gone, "missing_rows").when(F.col(v) == F.col("entries"), "all_valid").when(F.col(v) == 0, "all_null").otherwise("partially_valid"))

    same = (F.col("win_valid") == F.col("place_valid")) & (F.col("win_null") == F.col("place_null"))
    return g.withColumns({"win_pattern": pattern("win_valid"), "place_pattern": pattern("place_valid"), "same": same})


def pattern_summary(patterns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return patterns.groupBy(*by, "win_pattern", "place_pattern").agg(
        F.count(F.lit(1)).alias("contests"), F.sum("entries").alias("entries"), F.count_if("same").alias("same_contests"))


def count_consistency(entries: DataFrame, quotes: DataFrame, contests: DataFrame, contest: str, number: str, declared: str) -> DataFrame:
    """Distinct entry numbers on both sides against the declared field size, with an anomaly flag."""
    a = entries.select(contest, number).distinct().groupBy(contest).agg(F.count(F.lit(1)).alias("entry_rows"))
    b = (quotes.select(contest, number).distinct().join(entries.select(contest, number).distinct(), [contest, number])
         .groupBy(contest).agg(F.count(F.lit(1)).alias("quote_rows")))
    d = contests.groupBy(contest).agg(F.max(declared).alias("declared"))
    j = a.join(b, contest, "left").join(d, contest, "left").withColumn("quote_rows", F.coalesce("quote_rows", F.lit(0)))
    bad = (F.col("quote_rows") != F.col("entry_rows")) | F.coalesce(F.col("declared") != F.col("entry_rows"), F.lit(False))
    return j.withColumn("anomaly", bad)


# Scale hypotheses (name, divisor left, divisor right).
HYPOTHESES = (("as_is", 1, 1), ("left_div10", 10, 1), ("right_div10", 1, 10), ("left_div100", 100, 1), ("right_div100", 1, 100))


def two_source_comparison(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Exact and tolerance matches, mean, median, nearest-rank p95/p99 and maximum under five scale hypotheses."""
    d = df.select(left.alias("l"), right.alias("r")).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("comparison"), F.abs(F.col("l") / float(a) - F.col("r") / float(b)).alias("d")) for n, a, b in HYPOTHESES])))
    g = ["comparison"]
    stats = d.groupBy(*g).agg(F.count("d").alias("compared"), count(F.col("d") == 0, "exact"), count(F.col("d") <= 1e-9, "within_tolerance"),
                              F.avg("d").alias("mean_diff"), F.max("d").alias("max_diff"))
    med = quantiles(d, g, "d", [0.5]).withColumnRenamed("q0", "median_diff")
    near = nearest_rank(d, g, "d", (0.95, 0.99)).withColumnsRenamed({"q0": "p95_diff", "q1": "p99_diff"})
    return join_groups(join_groups(stats, med, g), near, g).withColumn("exact_rate", F.try_divide("exact", "compared"))


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, qs: Sequence[float], slices: int | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at position round-half-even((n-1)*q)."""
    h = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    h = with_group(running(h, group, [F.col(value)], {"_cum": F.col("_n")}, slices), group, _t=F.sum("_n"))
    return h.groupBy(*group).agg(*[
        F.min(F.when(F.col("_cum") > F.bround((F.col("_t") - 1) * F.lit(float(q))), F.col(value))).alias(f"q{i}") for i, q in enumerate(qs)])


def timing_bucket(days: Column) -> Column:
    return (F.when(days.isNull(), "unknown").when(days < 0, "before_event").when(days == 0, "same_day").when(days == 1, "day_after")
            .when(days <= 7, "2_to_7_days_after").otherwise("more_than_7_days_after"))


def make_date_timing(joined: DataFrame, by: Sequence[str], event_day: Column, make_date: str, measures: dict[str, Column]) -> DataFrame:
    made = F.try_to_timestamp(F.col(make_date), F.lit("yyyyMMdd")).cast("date")
    d = joined.withColumn("_days", F.datediff(made, event_day))
    return d.groupBy(*by, timing_bucket(F.col("_days")).alias("timing_bucket")).agg(
        F.count(F.lit(1)).alias("rows"), count(X.is_blank(F.col(make_date)), "missing_make_date"), F.min("_days").alias("min_days"),
        F.max("_days").alias("max_days"), *[F.count_if(c).alias(m) for m, c in measures.items()])


def preflight(tables: dict[str, DataFrame], checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row counts of required tables and named one-row checks as (check, value)."""
    parts = [df.agg(F.lit(f"rows:{n}").alias("check"), F.count(F.lit(1)).cast("double").alias("value")) for n, df in tables.items()]
    parts += [df.select(F.lit(n).alias("check"), F.col(c).cast("double").alias("value")) for n, (df, c) in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_profile(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Nulls, missing rate and distinct values (null counts as a value) per column from one value histogram."""
    types = dict(df.dtypes)
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                                                      F.col(c).cast("string").alias("v")) for c in columns])))
    h = long.groupBy(*by, "column_name", "dtype", "v").agg(F.count(F.lit(1)).alias("n"))
    nulls = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
    return h.groupBy(*by, "column_name", "dtype").agg(nulls.alias("null_count"), (nulls / F.sum("n")).alias("missing_rate"),
                                                      F.count(F.lit(1)).alias("unique_count"))


def frequent_values(df: DataFrame, by: Sequence[str], column: str, share: float) -> DataFrame:
    """Values that hold at least ``share`` of their group's rows, with exact counts; all others together in one row.

    The counts are one aggregation with map-side combining, so a hot value is one row per task and a column of any number of
    distinct values is never in one place.  ``value`` is null and ``kept`` false in the row of the rest, which also says how many
    distinct values it holds.  Nulls count as a value named ``None``; a group has at most 1 / ``share`` rows and one.
    """
    c = df.groupBy(*by, F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    c = with_group(c, by, _all=F.sum("rows")).withColumn("kept", F.col("rows") >= F.col("_all") * share)
    return c.groupBy(*by, "kept", F.when(F.col("kept"), F.col("value")).alias("value")).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("distinct_values"))


def counts_map(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Value counts as a map; the map is built from the aggregated counts only."""
    c = df.groupBy(*by, F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n")))).alias("counts"))


def extrapolation_audit(df: DataFrame, by: str, p: Column, first_trained: int, qs: Sequence[float] = (0.01, 0.99)) -> DataFrame:
    """Mean, deviation and outer quantiles of the market logit per period, and whether the period lies before the trained ones.

    Logits that are null, NaN or infinite take no part; a period without any has no row.  One value has no deviation.
    """
    d = df.select(by, F.log(F.try_divide(p, 1.0 - p)).alias("_l")).filter(X.is_finite(F.col("_l")))
    sums = d.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.avg("_l").alias("mean"), F.stddev_samp("_l").alias("std"))
    out = join_groups(sums, quantiles(d, [by], "_l", qs), [by]).withColumn("extrapolation", F.col(by) < first_trained)
    return out.withColumnsRenamed({f"q{i}": f"p{round(100 * q):02d}" for i, q in enumerate(qs)})


def special_cases(df: DataFrame, status: str, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Abnormal rows and label/paid mismatches with the first matching note."""
    note = F.when(~F.col(status).eqNullSafe(F.lit("0")), "abnormal_or_refund")
    for a, b, name in pairs:
        note = note.when(F.col(a) != F.col(b), name)
    return df.withColumn("note", note).filter("note is not null")


def dataset_diff(old: DataFrame, new: DataFrame, key: str, by: str, shared: Sequence[str]) -> DataFrame:
    """Rows, key intersection, agreement and null transitions by group, from one full join."""
    a = old.select(key, F.col(by).alias("_ba"), F.struct(*shared).alias("a"))
    b = new.select(key, F.col(by).alias("_bb"), F.struct(*shared).alias("b"))
    j = a.join(b, key, "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    agree = F.lit(True)
    for c in shared:
        agree = agree & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return j.groupBy(F.coalesce("_ba", "_bb").alias(by)).agg(
        count(F.col("a").isNotNull(), "old_rows"), count(F.col("b").isNotNull(), "new_rows"), count(both, "shared_keys"), count(both & agree, "agreeing_rows"),
        *[count(both & F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNotNull(), f"{c}_filled") for c in shared],
        *[count(both & F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNull(), f"{c}_lost") for c in shared])


def prediction_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], by: Sequence[str], p: str, tolerance: float) -> DataFrame:
    """Max, mean and p99 absolute difference, mismatches and keys missing on either side."""
    a = old.select(*keys, *by, F.col(p).alias("_a"))
    b = new.select(*keys, *by, F.col(p).alias("_b"))
    j = a.join(b, [*keys, *by], "full").withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    j = stored_if_large(j.select(*by, "_a", "_b", "_d"), "differences")
    stats = j.groupBy(*by).agg(
        F.count("_d").alias("compared"), F.max("_d").alias("max_diff"), F.avg("_d").alias("mean_diff"), count(F.col("_d") > tolerance, "mismatches"),
        count(F.col("_b").isNull(), "missing_in_new"), count(F.col("_a").isNull(), "missing_in_old"))
    return join_groups(stats, quantiles(j, by, "_d", [0.99]), by).withColumnRenamed("q0", "p99_diff")


def target_integrity(df: DataFrame, by: Sequence[str], label: str, pay: str, field_size: str, rank: str) -> DataFrame:
    """Label equals payout > 0; third place in a small field is never paid."""
    paid = F.coalesce(F.col(pay), F.lit(0)) > 0
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), count((F.col(label) == 1) != paid, "label_payout_mismatch"),
        count((F.col(label) == 1) & ~paid, "positive_without_payout"), count((F.col(field_size) <= 7) & (F.col(rank) == 3) & paid, "small_field_third_paid"))
