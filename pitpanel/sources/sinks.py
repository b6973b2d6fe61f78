"""Sinks: partition overwrite, CSV reports, keyed upsert, relaxed append, append-only ledger insert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.history import keep_last
from pitpanel.sources.readers import union_relaxed


def overwrite_years(df: DataFrame, path: str, year: str = "year") -> None:
    """Replace exactly the years present in ``df``; the committer makes the replacement atomic per job."""
    (df.repartition(F.col(year), F.pmod(F.xxhash64(*[c for c in df.columns if c != year]), F.lit(8)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(year).parquet(path))


def write_report(df: DataFrame, path: str) -> None:
    """Small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of old and new rows, the new batch wins per key."""
    both = union_relaxed([old.withColumn("_batch", F.lit(0)), new.withColumn("_batch", F.lit(1))])
    return keep_last(both, keys, [F.col("_batch")]).drop("_batch")


def replace_years(old: DataFrame, new: DataFrame, year: str = "year") -> DataFrame:
    """Old rows of years that the new batch does not hold, plus the new batch (the year list is tiny)."""
    years = new.select(year).distinct()
    return union_relaxed([old.join(years, year, "left_anti"), new])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def new_runs_only(incoming: DataFrame, existing: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows whose run id is not in the ledger yet."""
    return incoming.join(existing.select(run).distinct(), run, "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    from pitpanel.operators.contest import one_per_group
    return one_per_group(df, keys, order)
