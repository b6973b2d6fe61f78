"""Feature transforms that need statistics of a training part: winsorising, smoothing, decay weights, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import attach_row, quantiles


def market_features(df: DataFrame, low: str, high: str) -> DataFrame:
    """Width, mid, log(clip >= 1), inverse and mid-inverse of an odds band."""
    a, b = F.col(low), F.col(high)
    mid = (a + b) / 2.0
    return df.withColumns({"odds_width": b - a, "odds_mid": mid, "log_low": X.log_clip1(a), "log_high": X.log_clip1(b),
                           "inv_low": F.try_divide(F.lit(1.0), a), "inv_high": F.try_divide(F.lit(1.0), b), "inv_mid": F.try_divide(F.lit(1.0), mid)})


def winsorise(df: DataFrame, value: str, is_train: Column, q: float = 0.99) -> DataFrame:
    """Clip at the training quantile, log1p, and both."""
    cap = quantiles(df.filter(is_train), [], value, [q]).select(F.col("q0").alias("_cap"))
    d = attach_row(df, cap)
    clipped = F.least(F.col(value).cast("double"), F.col("_cap"))
    return d.withColumns({f"{value}_clip": clipped, f"{value}_log1p": F.log1p(F.col(value).cast("double")), f"{value}_clip_log1p": F.log1p(clipped)}).drop("_cap")


def smooth_rate(df: DataFrame, rate: str, count: str, is_train: Column, strength: float, name: str) -> DataFrame:
    """Empirical-Bayes rate: (k + s*prior)/(n + s) with k = round-half-even(rate*n); n = 0 gives the prior.

    ``rate`` may be null where ``count`` is zero.
    """
    n = F.coalesce(F.col(count).cast("double"), F.lit(0.0))
    k = F.bround(F.coalesce(F.col(rate), F.lit(0.0)) * n)
    prior = df.filter(is_train).agg(F.try_divide(F.sum(k), F.sum(n)).alias("_prior"))
    d = attach_row(df, prior)
    s = F.lit(float(strength))
    return d.withColumn(name, F.when(n <= 0, F.col("_prior")).otherwise((k + s * F.col("_prior")) / (n + s))).drop("_prior")


def count_reconstruction_error(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Largest |rate*n - round(rate*n)| per (rate, count) pair, one pass."""
    one = df.agg(*[F.max(F.abs(F.col(r) * F.col(n) - F.bround(F.col(r) * F.col(n)))).alias(f"e{i}") for i, (r, n) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(n).alias("count_column"), F.col(f"e{i}").alias("max_error"))
                                         for i, (r, n) in enumerate(pairs)])))


def decay_weights(df: DataFrame, age: Column, half_life: float, name: str = "weight") -> DataFrame:
    """2^(-age/half-life), scaled to mean 1 over the frame."""
    raw = df.withColumn("_raw", F.pow(F.lit(2.0), -age / half_life))
    d = attach_row(raw, raw.agg(F.avg("_raw").alias("_mean")))
    return d.withColumn(name, F.col("_raw") / F.col("_mean")).drop("_raw", "_mean")


def effective_sample_size(df: DataFrame, weight: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("sum_w"),
                  F.try_divide(F.sum(weight) * F.sum(weight), F.sum(F.col(weight) * F.col(weight))).alias("ess"),
                  F.min(weight).alias("min_w"), F.max(weight).alias("max_w"))


def add_segments(df: DataFrame, track: str, distance: str, name: str, day: str, venue: str, field_size: str) -> DataFrame:
    """Surface by code, distance group, handicap by name pattern, field-size band, month and venue as text."""
    code = X.surface_code(F.col(track))
    return df.withColumns({
        "surface": F.when(code == "1", "turf").when(code == "2", "dirt").when(code.isNull(), "(none)").otherwise("other"),
        "distance_group": X.bucketize(F.col(distance), [0, 1400, 1800, 2200, 9999], ["sprint", "mile", "middle", "long"]),
        "handicap_flag": F.when(F.col(name).rlike("(?i)ring|bolt"), "handicap").otherwise("normal"),
        "field_size_band": X.bucketize(F.col(field_size), [0, 7, 10, 99], ["small", "medium", "large"]),
        "month": F.date_format(day, "MM"), "venue_text": F.lpad(F.col(venue).cast("string"), 2, "0")})
