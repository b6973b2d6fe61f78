"""Scalar column functions: keys, bands, validity, probability and market transforms."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Odds sentinels, tier thresholds, missing-category token.
SENTINELS = (9999.0, 999.9, 99999.0)
TIERS = (("CORE", 1.00), ("MARGIN", 1.05), ("HIGH", 1.10), ("VERY_HIGH", 1.15))
MISSING = "__MISSING__"


def text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def is_finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite; Spark orders NaN above every number, so thresholds must ask this first."""
    v = c.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def at_least(c: Column, threshold: Column | float) -> Column:
    """c >= threshold for finite c; false for null, NaN and infinities."""
    return is_finite(c) & F.coalesce(c >= threshold, F.lit(False))


def above(c: Column, threshold: Column | float) -> Column:
    return is_finite(c) & F.coalesce(c > threshold, F.lit(False))


def number(c: Column) -> Column:
    """Lenient numeric reading: text that is not a finite number counts as 0, null stays null."""
    v = c.cast("string").try_cast("double")
    return F.when(c.isNull(), None).otherwise(F.when(is_finite(v), v).otherwise(F.lit(0.0)))


def is_blank(c: Column) -> Column:
    return c.isNull() | (text(c) == "")


def is_valid_quote(c: Column) -> Column:
    v = number(c)
    return ~is_blank(c) & (v > 0) & ~v.isin(*SENTINELS)


def is_invalid_quote(c: Column) -> Column:
    v = number(c)
    return ~is_blank(c) & ((v <= 0) | v.isin(*SENTINELS))


def quote_class(c: Column, found: Column | None = None) -> Column:
    """valid / null_or_empty / zero_or_sentinel / row_missing."""
    out = F.when(is_blank(c), "null_or_empty").when(is_invalid_quote(c), "zero_or_sentinel").otherwise("valid")
    return out if found is None else F.when(~found, "row_missing").otherwise(out)


def is_valid_id(c: Column) -> Column:
    """At least one character that is not '0' after trimming; null is invalid."""
    return F.coalesce(F.translate(text(c), "0", "") != "", F.lit(False))


def is_positive(c: Column) -> Column:
    """Null for null, else whether the number is above zero."""
    return F.when(c.isNull(), None).otherwise((number(c) > 0))


def contest_key(date: Column, venue: Column, *numbers: Column) -> Column:
    """YYYYMMDD + venue code + zero-padded two-digit numbers."""
    return F.concat(F.date_format(date, "yyyyMMdd"), venue.cast("string"),
                    *[F.format_string("%02d", n.cast("int")) for n in numbers])


def mmdd_date(year: Column, mmdd: Column) -> Column:
    return F.make_date(year.cast("int"), F.floor(mmdd / 100).cast("int"), (mmdd % 100).cast("int"))


def sort_key(year: Column, mmdd: Column, *parts: Column) -> Column:
    """One BIGINT that sorts like (year, mmdd, parts...), two digits per part."""
    return functools.reduce(lambda acc, p: acc * 100 + p.cast("long"), parts,
                            year.cast("long") * 10000 + mmdd.cast("long"))


def width_band(c: Column, width: int) -> Column:
    """Lower edge of the band of the given width."""
    return (F.floor(c / width) * width).cast("int")


def surface_code(c: Column) -> Column:
    """First character of the track code; null when blank."""
    return F.when(~is_blank(c), F.substring(c.cast("string"), 1, 1))


def going_code(track: Column, turf: Column, dirt: Column) -> Column:
    """Turf code on surface 1, dirt code on surface 2, else the first one that is not blank."""
    surface = F.substring(F.coalesce(track.cast("string"), F.lit("")), 1, 1)
    return (F.when(surface == "1", turf).when(surface == "2", dirt)
            .otherwise(F.coalesce(F.nullif(turf, F.lit("")), dirt)))


def bucketize(c: Column, edges: Sequence[float], labels: Sequence[str] | None = None,
              right: bool = True, include_lowest: bool = False, other: str | None = "(none)") -> Column:
    """Band label; ``right`` closes (a,b], otherwise [a,b).  Outside or null gives ``other``."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        label = labels[i] if labels else (f"({lo:g},{hi:g}]" if right else f"[{lo:g},{hi:g})")
        if right:
            above = (c >= lo) if (i == 0 and include_lowest) else (c > lo)
            cond = above & (c <= hi)
        else:
            cond = (c >= lo) & (c < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(other))


def bin_index(p: Column, bins: int = 10) -> Column:
    """Fixed-width bin on [0,1] with literal edges; the last bin is closed."""
    out = F.lit(0)
    for i in range(1, bins):
        out = out + (p >= F.lit(i / bins)).cast("int")
    return F.when(p.isNull() | (p < 0) | (p > 1), None).otherwise(out)


def config_band(c: Column, bands: Sequence[tuple[str, float | None, float | None]],
                keep: str = "last", other: str | None = None) -> Column:
    """Exclusive [min, max) bands from configuration; the last (or first) match wins."""
    ordered = list(reversed(bands)) if keep == "last" else list(bands)
    out = None
    for name, lo, hi in ordered:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (c >= lo)
        if hi is not None:
            cond = cond & (c < hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.lit(other))


def coalesce_columns(df: DataFrame, names: Sequence[str], default=None) -> Column:
    """First non-null of those alternative names that the frame has."""
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(default)) if present else F.lit(default)


def tier(ev: Column) -> Column:
    out = F.when(~is_finite(ev), "NONE")
    for name, threshold in reversed(TIERS):
        out = out.when(ev >= threshold, name)
    return out.otherwise("NONE")


def clip(p: Column, eps: float = 1e-6) -> Column:
    """Null and NaN stay as they are."""
    return F.when(F.isnan(p.cast("double")), p).when(p.isNotNull(), F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps)
    return F.log(q / (1.0 - q))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def log_clip1(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log(F.greatest(c, F.lit(1.0))))


def blend(p: Column, q: Column, alpha: float) -> Column:
    return alpha * p + (1.0 - alpha) * q


def heuristic_prior(odds: Column, slots: Column, field: Column, eps: float = 1e-6) -> Column:
    """0.5/odds + 0.5*slots/field, clipped."""
    p = 0.5 / F.greatest(odds, F.lit(1.0)) + 0.5 * slots / F.greatest(field, F.lit(1))
    return clip(F.when(odds.isNotNull() & field.isNotNull(), p), eps)


def finite(c: Column) -> Column:
    """Numeric reading with NaN and +-inf as null."""
    v = c.cast("string").try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def category(c: Column) -> Column:
    t = c.cast("string")
    return F.when(t.isNull() | t.isin("", "nan", "None"), MISSING).otherwise(t)


def linear_score(coefficients: dict[str, float], intercept: float, means: dict[str, float] | None = None,
                 scales: dict[str, float] | None = None) -> Column:
    """Frozen scaler + logistic as one column expression."""
    z = F.lit(intercept)
    for name, beta in coefficients.items():
        x = F.col(name)
        if means:
            x = (x - means[name]) / scales[name]
        z = z + beta * x
    return z


def platt(p: Column, slope: float, intercept: float, eps: float = 1e-6) -> Column:
    """Frozen Platt calibrator on the logit, clipped in and out."""
    return clip(sigmoid(slope * logit(p, eps) + intercept), eps)


def pick_mask(p: Column, odds: Column, ev_min: float, lo: float | None = None, hi: float | None = None) -> Column:
    cond = at_least(p * odds, ev_min)
    if lo is not None:
        cond = cond & (odds >= lo)
    if hi is not None:
        cond = cond & (odds < hi)
    return F.coalesce(cond, F.lit(False))


# Rule condition name -> (frame column, comparison).
RULE_CONDITIONS = {
    "model_rank_max": ("model_rank", "<="),
    "market_rank_min": ("market_rank", ">="),
    "rank_gap_min": ("rank_gap", ">="),
    "edge_min": ("edge", ">="),
    "ev_min": ("ev", ">="),
    "odds_min": ("odds", ">="),
    "odds_max": ("odds", "<"),
    "margin_min": ("margin", ">="),
    "entropy_max": ("entropy", "<="),
    "place_edge_low_min": ("place_edge_low", ">="),
    "place_ev_low_min": ("place_ev_low", ">="),
}
_OPS = {"<=": operator.le, ">=": operator.ge, "<": operator.lt}
# Named strategy macros.
STRATEGY_MACROS = {
    "win_core": "model_rank = 1",
    "win_value": "model_rank between 2 and 3 and market_rank >= 4",
    "win_rank_reversal": "model_rank <= 3 and rank_gap >= 2",
    "win_longshot": "model_rank <= 3 and odds >= 20",
    "place_core": "model_rank = 1",
}


def rule_mask(rule: dict) -> Column:
    """Predicate of one rule: optional range conditions, segment equality, strategy macro."""
    cond = F.lit(True)
    if rule.get("strategy_type") in STRATEGY_MACROS:
        cond = cond & F.expr(STRATEGY_MACROS[rule["strategy_type"]])
    for name, (column, op) in RULE_CONDITIONS.items():
        if rule.get(name) is not None:
            cond = cond & ~F.isnan(F.col(column).cast("double")) & _OPS[op](F.col(column), F.lit(float(rule[name])))
    if rule.get("dynamic_low_odds_edge"):
        floor = F.when(F.col("odds") < 1.3, 0.05).when(F.col("odds") < 1.8, 0.03).otherwise(0.02)
        cond = cond & (F.col("place_edge_low") >= floor)
    for name, value in rule.items():
        if name.startswith("segment_") and value not in (None, ""):
            cond = cond & (F.col(name[len("segment_"):]).cast("string") == str(value))
    return F.coalesce(cond, F.lit(False))


def iso_day(c: Column) -> Column:
    """Any date, timestamp or text representation to a DATE; unreadable gives null."""
    return F.coalesce(c.try_cast("date"), F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("date"))


def paid_flag(df: DataFrame, labels: Sequence[str], pays: Sequence[str]) -> Column:
    """A label column that the frame has decides (null is false); only without one the payout does."""
    lab = [F.col(c) == 1 for c in labels if c in df.columns]
    pay = [F.col(c) > 0 for c in pays if c in df.columns]
    return F.coalesce(*(lab or pay), F.lit(False))
