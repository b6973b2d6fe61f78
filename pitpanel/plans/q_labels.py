"""Registered queries: labels, eligibility, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.operators import labels as L
from pitpanel.plans.base import PANEL, panel, r6
from pitpanel.spec import PanelSpec

SPEC = PanelSpec()
SPLITS = {**{y: "train" for y in range(1995, 1999)}, 1999: "validation", 2000: "test", 2001: "latest_holdout"}
SPLIT_SQL = ("CASE WHEN year BETWEEN 1995 AND 1998 THEN 'train' WHEN year = 1999 THEN 'validation' "
             "WHEN year = 2000 THEN 'test' WHEN year = 2001 THEN 'latest_holdout' ELSE 'out_of_scope' END")

LABELED = PANEL + """, flagged AS (
 SELECT panel.*, max(coalesce(rank,0)) OVER g > 0 AS has_result, max(coalesce(win_pay,0)) OVER g > 0 AS has_win_payout,
  max(coalesce(place_pay,0)) OVER g > 0 AS has_place_payout
 FROM panel WINDOW g AS (PARTITION BY contest_id)),
targeted AS (
 SELECT *, has_result AND (has_win_payout OR has_place_payout) AS is_finalized,
  CASE WHEN field_size<=4 THEN 0 WHEN field_size<=7 THEN 2 ELSE 3 END AS place_rank_limit,
  cast(status='0' AND rank>0 AS int) AS is_normal,
  cast(status='0' AND rank=1 AS int) AS target_win_rank,
  cast(status='0' AND rank>0 AND rank<=2 AS int) AS target_top2_rank,
  cast(status='0' AND rank>0 AND rank<=3 AS int) AS target_top3_rank,
  cast(coalesce(win_pay,0)>0 AS int) AS target_win_paid,
  cast(coalesce(place_pay,0)>0 AS int) AS target_place_paid,
  win_odds>0 AS win_odds_available,
  regexp_matches(trim(runner),'[^0]') AS runner_ok
 FROM flagged),
labeled AS (
 SELECT *, cast(is_normal=1 AND field_size>=5 AND rank<=place_rank_limit AS int) AS target_place_by_rule,
  CASE WHEN NOT has_result THEN 'no_result' WHEN NOT has_win_payout THEN 'no_win_payout' WHEN status<>'0' THEN 'abnormal_or_cancelled'
   WHEN NOT entry_no>0 THEN 'invalid_entry_no' WHEN NOT runner_ok THEN 'invalid_runner_id' ELSE '' END AS win_exclusion,
  CASE WHEN NOT has_result THEN 'no_result' WHEN NOT has_place_payout THEN 'no_place_payout' WHEN status<>'0' THEN 'abnormal_or_cancelled'
   WHEN NOT entry_no>0 THEN 'invalid_entry_no' WHEN NOT runner_ok THEN 'invalid_runner_id' ELSE '' END AS place_exclusion,
  CASE WHEN NOT has_result THEN 'no_result' WHEN status<>'0' THEN 'abnormal_or_cancelled' WHEN NOT rank>0 THEN 'missing_rank'
   WHEN NOT entry_no>0 THEN 'invalid_entry_no' WHEN NOT runner_ok THEN 'invalid_runner_id' ELSE '' END AS ranking_exclusion
 FROM targeted)"""
WITH = "WITH " + LABELED + " "


def labeled(spark, sf):
    return L.add_targets(panel(spark, sf), SPEC)


def lb1(spark, sf):
    return L.group_flags(panel(spark, sf), SPEC).groupBy("has_result", "has_win_payout", "has_place_payout", "is_finalized").agg(
        F.count(F.lit(1)).alias("entries"))


def lb2(spark, sf):
    return panel(spark, sf).groupBy("field_size").agg(
        F.max(L.place_limit(F.col("field_size"))).alias("limit_standard"),
        F.max(L.place_limit(F.col("field_size"), "simple")).alias("limit_simple"), F.count(F.lit(1)).alias("entries"))


TARGET_COLS = ["is_normal", "target_win_rank", "target_top2_rank", "target_top3_rank", "target_win_paid",
               "target_place_paid", "target_place_by_rule"]


def lb3(spark, sf):
    return labeled(spark, sf).select("entry_id", *[F.col(c).cast("int").alias(c) for c in TARGET_COLS])


def lb4(spark, sf):
    return labeled(spark, sf).groupBy(F.when(F.col("win_odds_available").isNull(), "null")
                                      .otherwise(F.col("win_odds_available").cast("string")).alias("available")).agg(
        F.count(F.lit(1)).alias("entries"))


def lb5(spark, sf):
    return labeled(spark, sf).groupBy("win_exclusion", "place_exclusion", "ranking_exclusion").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if("eligible_win").alias("eligible_win"), F.count_if("eligible_place").alias("eligible_place"),
        F.count_if("eligible_ranking").alias("eligible_ranking"))


def lb6(spark, sf):
    df = panel(spark, sf).withColumn("split", L.split_name(F.col("year"), SPLITS))
    return df.groupBy("year", "split").agg(F.count(F.lit(1)).alias("entries"))


def lb7(spark, sf):
    df = panel(spark, sf).withColumn("split", L.split_name(F.col("year"), SPLITS))
    return L.split_overlap(df, "split", ["contest_id", "entry_id", "runner"])


def lb8(spark, sf):
    df = labeled(spark, sf).withColumn("split", L.split_name(F.col("year"), SPLITS))
    out = L.class_balance(df, "split", {"win": ("target_win_paid", "eligible_win"), "place": ("target_place_paid", "eligible_place")})
    return out.withColumn("positive_rate", r6("positive_rate"))


def lb9(spark, sf):
    f = L.target_frame(labeled(spark, sf), "target_place_paid", "eligible_place")
    g = L.target_frame(labeled(spark, sf), "target_top3_rank", "eligible_place")
    return (L.positives_without_payout(f, "target", "place_pay").withColumn("target", F.lit("paid"))
            .unionByName(L.positives_without_payout(g, "target", "place_pay").withColumn("target", F.lit("top3"))))


def lb12(spark, sf):
    from pitpanel.operators.history import with_cutoff
    return L.yearly_summary(with_cutoff(labeled(spark, sf), "event_date"), SPEC)


FEATURE_SETS = {"context": ["distance", "field_size", "venue", "carried"], "market": ["win_odds", "popularity", "win_pay"], "entity": ["body", "runner", "final_time", "sire"]}


def lb11(spark, sf):
    d = L.feature_inventory(panel(spark, sf), FEATURE_SETS).drop("dtype")
    return d.withColumn("null_rate", F.round("null_rate", 6))


QUERIES = {
    "lb1_contest_flags": lb1, "lb2_place_limit": lb2, "lb3_targets": lb3, "lb4_availability": lb4,
    "lb5_exclusion_reasons": lb5, "lb6_year_split": lb6, "lb7_split_overlap": lb7, "lb8_class_balance": lb8,
    "lb9_target_guard": lb9, "lb11_feature_inventory": lb11, "lb12_yearly_summary": lb12,
}
SQL = {
    "lb1_contest_flags": WITH + "SELECT has_result, has_win_payout, has_place_payout, is_finalized, count(*) AS entries FROM labeled GROUP BY ALL",
    "lb2_place_limit": WITH + "SELECT field_size, max(place_rank_limit) AS limit_standard, max(CASE WHEN field_size>=8 THEN 3 ELSE 2 END) AS limit_simple, count(*) AS entries FROM labeled GROUP BY 1",
    "lb3_targets": WITH + "SELECT entry_id, " + ", ".join(TARGET_COLS) + " FROM labeled",
    "lb4_availability": WITH + "SELECT coalesce(cast(win_odds_available AS varchar),'null') AS available, count(*) AS entries FROM labeled GROUP BY 1",
    "lb5_exclusion_reasons": WITH + """SELECT win_exclusion, place_exclusion, ranking_exclusion, count(*) AS entries,
 count(*) FILTER (win_exclusion='') AS eligible_win, count(*) FILTER (place_exclusion='') AS eligible_place,
 count(*) FILTER (ranking_exclusion='') AS eligible_ranking FROM labeled GROUP BY 1,2,3""",
    "lb6_year_split": f"WITH {PANEL} SELECT year, {SPLIT_SQL} AS split, count(*) AS entries FROM panel GROUP BY 1,2",
    "lb7_split_overlap": f"""WITH {PANEL}, s AS (SELECT *, {SPLIT_SQL} AS split FROM panel)
 SELECT 'contest_id' AS id_column, (SELECT count(*) FROM (SELECT contest_id FROM s GROUP BY 1 HAVING count(DISTINCT split)>1)) AS overlapping_ids
 UNION ALL SELECT 'entry_id', (SELECT count(*) FROM (SELECT entry_id FROM s GROUP BY 1 HAVING count(DISTINCT split)>1))
 UNION ALL SELECT 'runner', (SELECT count(*) FROM (SELECT runner FROM s GROUP BY 1 HAVING count(DISTINCT split)>1))""",
    "lb8_class_balance": WITH + f""", l AS (SELECT 'win' AS target, {SPLIT_SQL} AS split, target_win_paid AS y FROM labeled WHERE win_exclusion=''
 UNION ALL SELECT 'place', {SPLIT_SQL}, target_place_paid FROM labeled WHERE place_exclusion='')
 SELECT target, split, count(*) AS rows, cast(sum(y) AS bigint) AS positive, cast(count(*)-sum(y) AS bigint) AS negative, round(avg(y),6) AS positive_rate FROM l GROUP BY 1,2""",
    "lb9_target_guard": WITH + """SELECT 'paid' AS target, count(*) FILTER (target_place_paid=1 AND coalesce(place_pay,0)<=0) AS violations FROM labeled WHERE place_exclusion=''
 UNION ALL SELECT 'top3', count(*) FILTER (target_top3_rank=1 AND coalesce(place_pay,0)<=0) FROM labeled WHERE place_exclusion=''""",
    "lb12_yearly_summary": WITH + """, c AS (SELECT d, lag(d) OVER (ORDER BY d) AS cutoff FROM (SELECT DISTINCT event_date AS d FROM panel))
 SELECT year, count(*) AS rows, count(DISTINCT contest_id) AS contests, count(DISTINCT contest_id) FILTER (is_finalized) AS finalized,
 count(DISTINCT contest_id) - count(DISTINCT contest_id) FILTER (is_finalized) AS unfinalized, count(*)-count(DISTINCT entry_id) AS entry_duplicates,
 count(*) FILTER (cutoff >= event_date) AS cutoff_violations, count(*) FILTER (win_exclusion='') AS win_training_rows,
 count(*) FILTER (place_exclusion='') AS place_training_rows, count(*) FILTER (ranking_exclusion='') AS ranking_training_rows
 FROM labeled JOIN c ON d = event_date GROUP BY year""",
}
SQL["lb11_feature_inventory"] = f"WITH {PANEL} " + " UNION ALL ".join(
    f"SELECT '{s}' AS feature_set, '{c}' AS feature, {'false' if c == 'sire' else 'true'} AS present, count(*) AS rows, "
    + ("cast(NULL AS bigint) AS nulls, cast(NULL AS double) AS null_rate" if c == "sire" else f"count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL)/count(*),6) AS null_rate") + " FROM panel"
    for s, cs in FEATURE_SETS.items() for c in cs)
