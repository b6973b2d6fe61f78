"""Time folds: expanding, rolling and legacy windows that end before the validation year."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    strategy: str
    validation_year: int
    train_start: int
    train_end: int
    half_life: float | None = None


def fold_window(name: str, mode: str, start: int, year: int, rolling_years: int | None = None, half_life: float | None = None) -> Fold:
    """Training window of one validation year; it always ends the year before."""
    if mode not in ("expanding", "legacy", "rolling"):
        raise ValueError(f"unknown mode {mode}")
    first = max(start, year - rolling_years) if mode == "rolling" else start
    if first > year - 1:
        raise ValueError(f"empty training window for {name} {year}")
    return Fold(name, year, first, year - 1, half_life)


def fold_name(f: Fold) -> str:
    return f"{f.strategy}-{f.validation_year}"


def fold_key() -> Column:
    """Name of the fold of a row that ``tag_folds`` made."""
    return F.concat_ws("-", "strategy", F.col("validation_year").cast("string"))


def fold_table(spark, folds: Sequence[Fold]) -> DataFrame:
    return spark.createDataFrame([(f.strategy, f.validation_year, f.train_start, f.train_end) for f in folds],
                                 "strategy string, validation_year int, train_start int, train_end int")


def tag_folds(df: DataFrame, year: str, folds: Sequence[Fold]) -> DataFrame:
    """One row per (row, fold, part); the fold list is expanded map-side, no join."""
    items = []
    for f in folds:
        part = (F.when(F.col(year).between(f.train_start, f.train_end), "train").when(F.col(year) == f.validation_year, "validation"))
        items.append(F.when(part.isNotNull(), F.struct(F.lit(f.strategy).alias("strategy"), F.lit(f.validation_year).alias("validation_year"), part.alias("part"))))
    return df.select("*", F.inline(F.array_compact(F.array(*items))))
