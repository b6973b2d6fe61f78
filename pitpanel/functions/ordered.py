"""Skew-proof ordered computations: ranks and running totals in groups of any size.

A plain window puts a whole group in one task.  Here the sequence ``(group, order)`` is cut
into contiguous *slices* of about equal size, so a hot group spans many slices while an
ordinary group lies in one.  The window runs per ``(group, slice)``; what earlier slices of
the same group contribute is added from a table of slice totals.  Only the first group of a
slice can continue from the slice before it, so that table has fewer rows than there are
slices and is broadcast with a proven bound.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window as W

from pitpanel.functions.sizes import fits_one_task
from pitpanel.sources.workdir import materialise

SAMPLE_PER_SLICE = 20


def key_column(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> Column:
    named = [F.col(g).alias(f"g{i}") for i, g in enumerate(group)]
    named += [o.alias(f"o{i}") for i, o in enumerate(order)]
    return F.struct(*named)


def slice_edges(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame | None:
    """One sorted array ``edges`` that balances ``n`` slices, from a hash-ordered sample of bounded size.

    The sample only balances the work; results do not depend on it.  The edges are fixed here, once, so that every
    branch of a plan and every recomputed task cuts alike.
    """
    key = df.select(key_column(df, group, order).alias("k"))
    rows = key.orderBy(F.xxhash64("k")).limit(n * SAMPLE_PER_SLICE).orderBy("k").collect()
    edges = []
    for i in range(1, n):
        if rows:
            row = rows[min(len(rows) - 1, i * len(rows) // n)]["k"]
            if not edges or row != edges[-1]:
                edges.append(row)
    if not edges:
        return None
    kind = StructType([StructField("edges", ArrayType(key.schema["k"].dataType))])
    return df.sparkSession.createDataFrame([(edges,)], kind)


def slice_number(key: Column, edges: Column, n: int) -> Column:
    """Number of the at most ``n`` sorted edges at or below ``key``: binary search by halving steps."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n).bit_length()))])

    def move(at: Column, step: Column) -> Column:
        return F.when(F.get(edges, at + step - 1) <= key, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), move)


def with_slices(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                slices: int | None = None, name: str = "_slice") -> DataFrame:
    """Add the slice number; 0 everywhere when the frame fits one task."""
    if slices is None:
        if fits_one_task(df):
            return df.withColumn(name, F.lit(0))
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = slice_edges(df, group, order, slices)
    if edges is None:
        return df.withColumn(name, F.lit(0))
    keyed = df.withColumns({"_edges": edges.scalar(), "_key": key_column(df, group, order)})
    return keyed.select(*df.columns, slice_number(F.col("_key"), F.col("_edges"), slices).alias(name))


def is_sliced(df: DataFrame, slices: int | None) -> bool:
    return slices is not None or not fits_one_task(df)


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column],
            totals: dict[str, Column], slices: int | None = None) -> DataFrame:
    """Inclusive running sums of ``totals`` in each group, ordered by ``order`` (ascending).

    Negate a numeric column for descending order.  ``order`` must be unique in the group.
    """
    if not is_sliced(df, slices):
        w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in totals.items()})
    cut = with_slices(df, group, order, slices)
    w = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({n: F.sum(c).over(w) for n, c in totals.items()})
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*group, "_slice")
        .agg(*[F.sum(c).alias(n) for n, c in totals.items()])
        .select(*group, "_slice", F.count(F.lit(1)).over(before).alias("_earlier"),
                *[F.sum(n).over(before).alias(f"_off_{n}") for n in totals])
        .filter("_earlier > 0")
    )
    offsets = offsets.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)],
                             F.col("_slice").alias("_ks"), *[f"_off_{n}" for n in totals])
    cond = F.col("_slice") == F.col("_ks")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(F.broadcast(offsets), cond, "left")
    return out.select(*df.columns, *[
        (F.when(F.col(n).isNull() & F.col(f"_off_{n}").isNull(), None)
         .otherwise(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_off_{n}"), F.lit(0)))).alias(n)
        for n in totals])


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str,
                slices: int | None = None) -> DataFrame:
    """Unique 1-based position in the group (``order`` must be unique in the group)."""
    if not is_sliced(df, slices):
        return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long"))
    return running(df, group, order, {name: F.lit(1).cast("long")}, slices)


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a one-row frame to every row as a scalar subquery: no join, no shuffle of ``df``."""
    packed = one.select(F.struct(*one.columns)).scalar()
    return df.withColumn("_row", packed).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in one.columns])


def null_safe(group: Sequence[str]) -> Column:
    cond = F.lit(True)
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    return cond


def stored_if_large(df: DataFrame, name: str) -> DataFrame:
    """A frame that is read more than once: written to the shared folder unless it fits one task."""
    return df if fits_one_task(df) else materialise(df, name)


HOT_KEYS = 2000  # at most this many keys can hold more than 1/HOT_KEYS of the rows
HOT_ROWS = 1_000_000
SALTS = 4096


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], columns: Sequence[str], rows: str,
               split: bool | None = None, hot_rows: int = HOT_ROWS, nulls_match: bool = True) -> DataFrame:
    """Left join of rows to per-key statistics that stays balanced whatever share one key holds.

    ``stats`` has one row per key with its row count in ``rows``.  Keys above 1/HOT_KEYS of all rows
    (at most HOT_KEYS of them, so the list is broadcast with a proven bound) are joined map-side and
    spread by a salt over the shuffle that joins the ordinary keys.  Where null keys have no statistics
    (``nulls_match=False``) rows with a null key are spread as well.
    """
    if split is None:
        split = not fits_one_task(df)
    right = stats.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns, F.col(rows).alias("_rows"))
    if not split:
        return df.join(right.drop("_rows"), null_safe(keys), "left").select(*df.columns, *columns)
    right = materialise(right, "statistics")  # read by the limit, the hot keys and the ordinary ones
    limit = stats.agg(F.greatest(F.lit(hot_rows).cast("double"), F.sum(rows) / HOT_KEYS)).scalar()
    hot = right.filter(F.col("_rows") > limit).select(*[F.col(f"_k{i}") for i in range(len(keys))],
                                                      *[F.col(c).alias(f"_hot_{c}") for c in columns], F.lit(True).alias("_hot"))
    d = df.join(F.broadcast(hot), null_safe(keys), "left").drop(*[f"_k{i}" for i in range(len(keys))])
    ordinary = F.col("_hot").isNull()
    for k in [] if nulls_match else keys:
        ordinary = ordinary & F.col(k).isNotNull()
    salt = F.when(ordinary, 0).otherwise(1 + F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    d = d.withColumn("_salt", salt)
    j = d.join(right.drop("_rows").withColumn("_s", F.lit(0).cast("long")), null_safe(keys) & (F.col("_salt") == F.col("_s")), "left")
    return j.select(*df.columns, *[F.when(F.col("_hot").isNull(), F.col(c)).otherwise(F.col(f"_hot_{c}")).alias(c) for c in columns])


HOT_BUCKETS = 1 << 16


def hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys that hold more than ``hot_rows`` rows and 1/HOT_KEYS of all (at most HOT_KEYS of them), or None when there are none.

    Rows are counted by key hash first, which shuffles a bounded number of counts; no key has more rows than its bucket, so
    keys are counted only in buckets above the limit.
    """
    bucket = F.pmod(F.xxhash64(*group), F.lit(HOT_BUCKETS))
    counts = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    one = counts.agg(F.max("_n").alias("top"), F.sum("_n").alias("rows")).first()
    limit = max(hot_rows, (one["rows"] or 0) / HOT_KEYS)
    if (one["top"] or 0) <= limit:
        return None
    keys = df.join(F.broadcast(counts.filter(F.col("_n") > limit).select("_b")), bucket == F.col("_b"), "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialise(keys.filter(F.col("_n") > limit).select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)]), "hot-groups")
    return None if hot.isEmpty() else hot


def by_group(df: DataFrame, group: Sequence[str], whole: Callable[[DataFrame], DataFrame], sliced: Callable[[DataFrame], DataFrame],
             hot_rows: int | None = None) -> DataFrame:
    """``whole`` on the rows of ordinary groups, ``sliced`` on those of hot ones: the same columns from one shuffle by group, and from slices.

    Without ``hot_rows`` a frame that fits one task goes to ``whole`` as it is.
    """
    if hot_rows is None and fits_one_task(df):
        return whole(df)
    hot = hot_groups(df, group, HOT_ROWS if hot_rows is None else hot_rows)
    if hot is None:
        return whole(df)
    few = F.broadcast(hot)
    a, b = whole(df.join(few, null_safe(group), "left_anti")), sliced(df.join(few, null_safe(group), "left_semi"))
    return a.unionByName(b.select(*a.columns))


def with_group(df: DataFrame, group: Sequence[str], split: bool | None = None, hot_rows: int = HOT_ROWS, **aggs: Column) -> DataFrame:
    """Attach group aggregates: partial aggregation plus a balanced join instead of a window."""
    if not group:
        return attach_row(df, df.agg(*[c.alias(n) for n, c in aggs.items()]))
    stats = df.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()], F.count(F.lit(1)).alias("_cnt"))
    return join_stats(df, stats, group, list(aggs), "_cnt", split, hot_rows)


def average_ranks(df: DataFrame, group: Sequence[str], value: str, name: str,
                  slices: int | None = None) -> DataFrame:
    """Average rank (ties share the mean rank) of ``value`` per group, via the value histogram."""
    large = is_sliced(df, slices)
    if large:
        df = materialise(df, "ranked-rows")  # read by the histogram and by the join with it
    hist = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    if large:
        hist = materialise(hist, "histogram")
    hist = running(hist, group, [F.col(value)], {"_cum": F.col("_n")}, slices)
    hist = hist.select(*group, value, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(name), "_n")
    return join_stats(df, hist, [*group, value], [name], "_n", split=None if slices is None else True)


def quantiles(df: DataFrame, group: Sequence[str], value: str, qs: Sequence[float], slices: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles ``q0, q1, ...`` per group from a running value histogram.

    Works for groups of any size: no task ever holds the values of a group.
    """
    base = df.select(*group, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    keys = [*group]
    hist = base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if is_sliced(hist, slices):
        hist = materialise(hist, "histogram")  # read by the edges, the slices, their offsets and the totals
    totals = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_cnt"))
    cum = running(hist, keys, [F.col("_v")], {"_cum": F.col("_n")}, slices)
    if keys:
        cum = join_stats(cum, totals, keys, ["_total"], "_cnt")
    else:
        cum = attach_row(cum, totals.select("_total"))

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_cum") > index, F.col("_v")))

    out = []
    for i, q in enumerate(qs):
        h = (F.col("_total") - 1) * F.lit(float(q))
        lo = at(F.floor(h))
        out.append((lo + (at(F.ceil(h)) - lo) * F.max(h - F.floor(h))).alias(f"q{i}"))
    return cum.groupBy(*keys).agg(*out)
