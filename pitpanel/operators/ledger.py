"""Forward ledger: frozen scoring, nested tiers, time guards, settlement, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.operators.history import keep_last

STAKE = 100


def score_frozen(df: DataFrame, offset: Column, residual: Column, slope: float, intercept: float, odds: str) -> DataFrame:
    """Offset model + frozen Platt + EV with a finite/range flag per row."""
    raw = X.sigmoid(offset + residual)
    out = df.withColumn("probability_raw", raw).withColumn("probability_calibrated", X.platt(F.col("probability_raw"), slope, intercept))
    out = out.withColumn("expected_value", F.col("probability_calibrated") * F.col(odds))
    c = F.col("probability_calibrated")
    # asked of the inputs too: the sigmoid turns an infinite sum into a probability
    sound = X.is_finite(offset) & X.is_finite(residual) & X.is_finite(F.col("probability_raw")) & X.is_finite(F.col("expected_value"))
    return out.withColumn("valid", F.coalesce(sound & (c > 0) & (c < 1) & (F.col(odds) > 0), F.lit(False)))


def run_id(df: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Order-independent run id per group from the hashes of its keys; no key list is ever collected."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("_s")).select(
        *by, "rows", F.md5(F.concat_ws("|", F.col("_s").cast("string"), F.col("rows").cast("string"))).alias("run_id"))


def tier_rows(df: DataFrame, keys: Sequence[str], ev: str, tiers=X.TIERS, stake: int = STAKE) -> DataFrame:
    """Entry x nested tier with flag and stake (a fixed four-way map-side expansion)."""
    items = [F.struct(F.lit(n).alias("tier"), F.lit(float(t)).alias("threshold"), (X.is_finite(F.col(ev)) & (F.col(ev) >= t)).alias("selected"))
             for n, t in tiers]
    out = df.select(*keys, ev, F.inline(F.array(*items)))
    return out.withColumn("stake", F.when(F.col("selected"), stake).otherwise(0))


def nesting_violations(tiers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries flagged at a higher threshold but not at a lower one."""
    g = tiers.groupBy(*keys).agg(F.max(F.when(F.col("selected"), F.col("threshold"))).alias("hi"),
                                 F.min(F.when(~F.col("selected"), F.col("threshold"))).alias("lo"))
    return g.agg(F.count_if(F.col("lo") < F.col("hi")).alias("violations"), F.count(F.lit(1)).alias("entries"))


def time_guard(cutoff: Column, observed: Column, generated: Column, settled: Column, event_day: Column) -> Column:
    """First broken time rule of a row, null when fine."""
    return (F.when(cutoff > generated, "cutoff_after_generation").when(observed > generated, "odds_after_generation")
            .when(settled <= generated, "settled_before_generation").when(cutoff.cast("date") >= event_day, "history_reaches_event_day"))


def latest_settlements(settlements: DataFrame, keys: Sequence[str], settled_at: str, tie: Sequence[str] = ()) -> DataFrame:
    """Re-settling appends again; the latest version per key counts."""
    return keep_last(settlements, keys, [F.col(settled_at), *[F.col(t) for t in tie]])


def settle(tiers: DataFrame, settlements: DataFrame, keys: Sequence[str], pay: str) -> DataFrame:
    """Selected tier rows with result; unmatched rows stay pending with null payout."""
    s = settlements.select(*keys, F.col(pay).alias("_pay"), F.lit(True).alias("_hit"))
    j = tiers.filter("selected").join(s, list(keys), "left")
    return j.select(*tiers.columns, F.when(F.col("_hit").isNull(), "pending").otherwise("settled").alias("status"),
                    F.when(F.col("_hit").isNotNull(), F.coalesce(F.col("_pay"), F.lit(0))).alias("payout"))


def reports(settled: DataFrame, day: str, contest: str, fixture: Column | None = None) -> DataFrame:
    """Daily, monthly and cumulative ROI by tier in one GROUPING SETS pass over settled bets; fixtures are left out."""
    d = settled if fixture is None else settled.filter(~F.coalesce(fixture, F.lit(False)))
    d = d.select("tier", F.date_format(day, "yyyy-MM-dd").alias("day"), F.date_format(day, "yyyy-MM").alias("month"), contest, "stake",
                 "payout", "status")
    done = F.col("status") == "settled"
    g = d.groupingSets([["tier", "day"], ["tier", "month"], ["tier"]], "tier", "day", "month").agg(
        F.count(F.lit(1)).alias("bets"), F.count_if(~done).alias("pending"), F.coalesce(F.sum(F.when(done, F.col("stake"))), F.lit(0)).alias("stake"),
        F.coalesce(F.sum("payout"), F.lit(0)).alias("payout"))
    level = F.when(F.col("day").isNotNull(), "daily").when(F.col("month").isNotNull(), "monthly").otherwise("cumulative")
    return g.select(level.alias("level"), F.coalesce("day", "month", F.lit("all")).alias("period"), "tier", "bets", "pending", "stake", "payout",
                    (F.col("payout") - F.col("stake")).alias("profit"), F.try_divide(100.0 * F.col("payout"), F.col("stake")).alias("roi"))


def read_ledger(runs: DataFrame, predictions: DataFrame, tiers: DataFrame, settlements: DataFrame) -> DataFrame:
    """Four ledger tables to one frame: predictions with run, tier rows and the settlement of the same tier."""
    keys = ["run_id", "entry_id"]
    s = settlements.select(*keys, "tier", "payout", F.lit(True).alias("_hit"))
    j = predictions.join(runs, "run_id").join(tiers, keys).join(s, [*keys, "tier"], "left")
    return j.withColumn("status", F.when(F.col("_hit").isNull(), "pending").otherwise("settled")).drop("_hit")


# Normalised contract (column -> alternative input names, type, default).
NORMALISED = {
    "race_date": (("race_date", "event_date"), "date", None),
    "race_id": (("race_id", "contest_id"), "string", None),
    "entry_id": (("entry_id",), "string", ""),
    "venue": (("venue", "JyoCD"), "string", None),
    "race_no": (("race_no", "RaceNum"), "int", None),
    "entry_no": (("entry_no", "Umaban"), "int", None),
    "name": (("name", "horse_name", "Bamei"), "string", None),
    "runner": (("runner", "KettoNum"), "string", ""),
    "strategy": (("strategy",), "string", "ROLLING_10Y"),
    "retrospective_only": (("retrospective_only",), "boolean", None),
    "odds_snapshot_type": (("odds_snapshot_type",), "string", "saved"),
    "prediction_created_at": (("prediction_created_at", "prediction_generated_at"), "string", ""),
    "odds_observed_at": (("odds_observed_at",), "string", ""),
    "probability_market": (("probability_market", "p_market"), "double", None),
    "probability_raw": (("probability_raw", "probability_used_for_selection"), "double", None),
    "probability_calibrated": (("probability_calibrated", "probability_official_platt"), "double", None),
    "odds_low": (("odds_low", "fuku_odds_low", "FukuOddsLow", "fuku_odds_low_at_prediction"), "double", None),
    "odds_high": (("odds_high", "fuku_odds_high", "FukuOddsHigh"), "double", None),
    "win_popularity": (("win_popularity", "tan_ninki", "TanNinki", "Ninki"), "int", None),
    "place_popularity": (("place_popularity", "fuku_ninki", "FukuNinki"), "int", None),
    "distance": (("distance", "Kyori"), "double", None),
    "track": (("track", "TrackCD"), "string", ""),
    "field_size": (("field_size", "SyussoTosu"), "int", None),
    "finish": (("finish", "actual_finish_position", "KakuteiJyuni", "NyusenJyuni"), "int", None),
    "pay": (("pay", "fuku_pay"), "double", 0.0),
}


def normalise_predictions(df: DataFrame, source_path: Column, source_type: Column, venues: dict[str, str], stake: int = STAKE) -> DataFrame:
    """Heterogeneous prediction frames to the 38-column contract, de-duplicated per (source, strategy, contest, entry)."""
    def pick(name):
        names, kind, default = NORMALISED[name]
        c = X.coalesce_columns(df, names)
        c = X.iso_day(c) if kind == "date" else c.cast("string").try_cast(kind) if kind != "string" else c.cast("string")
        return F.coalesce(c, F.lit(default).cast(kind)) if default is not None else c

    d = df.select(*[pick(n).alias(n) for n in NORMALISED], X.coalesce_columns(df, ["expected_value", "ev_at_prediction"]).cast("double").alias("_ev"),
                  X.paid_flag(df, ["target_place_paid", "label"], ["fuku_pay", "pay"]).cast("int").alias("target_place_paid"),
                  source_path.alias("source_path"), source_type.alias("source_type"))
    code = F.lpad(F.col("venue"), 2, "0")
    lookup = F.create_map(*[F.lit(x) for kv in venues.items() for x in kv])
    d = d.withColumns({"venue": code, "venue_name": F.coalesce(F.try_element_at(lookup, code), F.concat(F.lit("venue "), code)),
                       "name": F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("no "), F.coalesce(F.col("entry_no").cast("string"), F.lit("?")), F.lit(" / "), F.col("runner"))),
                       "fixture": F.col("source_type") == "FIXTURE",
                       "retrospective_only": F.coalesce("retrospective_only", F.col("source_type").isin("RETROSPECTIVE_VALIDATION", "BACKTEST")),
                       "ev_probability_source": F.when(F.col("probability_calibrated").isNotNull(), "probability_calibrated").otherwise("probability_raw"),
                       "expected_value": F.coalesce(F.col("_ev"), F.coalesce("probability_calibrated", "probability_raw") * F.col("odds_low"))}).drop("_ev")
    d = d.withColumns({"tier": X.tier(F.col("expected_value")), "selected_for_bet": X.is_finite(F.col("expected_value")) & (F.col("expected_value") >= X.TIERS[0][1])})
    d = d.withColumns({"stake": F.when(F.col("selected_for_bet"), stake).otherwise(0),
                       "payout": F.when(F.col("selected_for_bet") & (F.col("target_place_paid") == 1), F.col("pay")).otherwise(0.0)})
    d = d.withColumns({"profit": F.col("payout") - F.col("stake"), "validation_year": F.year("race_date")})
    return d.dropDuplicates(["source_path", "strategy", "race_id", "entry_id"])


def keep_contests_with_tier(df: DataFrame, contest: str, tier: str, wanted: Sequence[str]) -> DataFrame:
    """All rows of contests in which any entry has a wanted tier (semi-join on contest ids)."""
    ids = df.filter(F.col(tier).isin(*wanted)).select(contest).distinct()
    return df.join(ids, contest, "left_semi")
