"""Registered queries: data-quality audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.operators import quality as Q
from pitpanel.plans.base import AUDIT, BETS, JOINED, PANEL, audit_rows, bets, entries, joined, panel, quotes, r6, rounded, table
from pitpanel.plans.q_labels import LABELED, labeled


def valid_win():
    return X.is_valid_quote(F.col("win_q"))


def valid_place():
    return Q.pair_valid(F.col("low_q"), F.col("high_q"))


RATES = ("match_rate", "win_rate", "place_rate")


def dq1(spark, sf):
    return rounded(Q.coverage(joined(spark, sf), [F.col("year")], "found", "win_q", "low_q", "high_q"), *RATES)


def dq2(spark, sf):
    return rounded(Q.coverage(joined(spark, sf), [F.coalesce("status", F.lit("")).alias("status")], "found", "win_q", "low_q", "high_q"), *RATES)


DIMS = ["year", "month", "venue", "entry_no", "status", "record_kind", "make_date"]


def dq3(spark, sf):
    return rounded(Q.dimension_missingness(joined(spark, sf), {d: F.col(d) for d in DIMS}, "found", valid_win()), "valid_rate")


def dq4(spark, sf):
    return Q.value_encoding(quotes(spark, sf), ["win_q", "low_q", "high_q", "quote_popularity"])


def dq5(spark, sf):
    j = joined(spark, sf)
    missing = ~F.col("found") | ~valid_win()
    return Q.missing_contest_samples(j, "contest_id", [], missing, 50).select("contest_id", "entry_id", "missing_rows", "entries", "win_q", "found")


def dq6(spark, sf):
    return Q.duplicate_key_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def dq6_schema(spark, sf):
    d = Q.schema_summary(audit_rows(spark, sf).select("status", "win_q", "low_q", "flag_a", "make_date"), "audit")
    return d.select("table_name", "column_name", "nulls")


def quote_status(valid, null, invalid):
    return F.when(~F.col("found"), "missing_row").when(valid, "valid").when(null, "null").when(invalid, "zero_or_invalid").otherwise("conversion_unknown")


def dq7(spark, sf):
    j = joined(spark, sf)
    low, high, win = F.col("low_q"), F.col("high_q"), F.col("win_q")
    by = [F.col("year"), F.coalesce("record_kind", F.lit("missing_row")), F.coalesce("flag_a", F.lit("missing_row")),
          quote_status(valid_win(), X.is_blank(win), X.is_invalid_quote(win)),
          quote_status(valid_place(), X.is_blank(low) | X.is_blank(high), X.is_invalid_quote(low) | X.is_invalid_quote(high))]
    d = Q.status_cross(j, by, "contest_id", {"valid_win": valid_win(), "valid_place": valid_place()})
    return d.withColumnsRenamed({"k0": "year", "k1": "record_kind", "k2": "flag", "k3": "win_status", "k4": "place_status"})


def dq8(spark, sf):
    return Q.flag_values(quotes(spark, sf), ["record_kind", "flag_a", "flag_b"], {"valid_win": valid_win(), "valid_place": valid_place()})


def dq9(policy):
    def run(spark, sf):
        p = Q.contest_patterns(joined(spark, sf), ["contest_id"], "found", "win_q", "low_q", "high_q", policy)
        return Q.pattern_summary(p)
    return run


def dq9_samples(spark, sf):
    p = Q.contest_patterns(joined(spark, sf), ["contest_id"], "found", "win_q", "low_q", "high_q")
    return p.filter("win_pattern = 'partially_valid' or place_pattern = 'partially_valid'").select(
        "contest_id", "entries", "win_valid", "place_valid", "win_pattern", "place_pattern")


def dq10(spark, sf):
    contests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest_id"), (F.lit(2) + F.col("o_custkey") % 4).alias("declared"))
    return Q.count_consistency(entries(spark, sf), quotes(spark, sf), contests, "contest_id", "entry_no", "declared").select(
        "contest_id", "entry_rows", "quote_rows", "declared", "anomaly")


def compared(spark, sf):
    return joined(spark, sf).filter(F.col("found") & valid_win() & X.is_valid_quote(F.col("entry_odds")))


def dq11(spark, sf):
    d = Q.two_source_comparison(compared(spark, sf), F.col("entry_odds"), X.number(F.col("win_q")))
    return rounded(d, "mean_diff", "median_diff", "p95_diff", "p99_diff", "max_diff", "exact_rate")


def dq11_year(spark, sf):
    d = compared(spark, sf).withColumn("d", F.abs(F.col("entry_odds") - X.number(F.col("win_q")) / 10.0))
    return rounded(d.groupBy("year").agg(
        F.count(F.lit(1)).alias("compared"), F.avg((F.col("d") == 0).cast("int")).alias("exact_rate"), F.avg("d").alias("mean_diff"),
        F.avg((F.col("entry_popularity") == F.col("quote_popularity")).cast("int")).alias("rank_match_rate")), "exact_rate", "mean_diff", "rank_match_rate")


def dq12(spark, sf):
    return Q.make_date_timing(joined(spark, sf), ["year"], F.col("event_date"), "make_date", {"valid_win": valid_win(), "valid_place": valid_place()})


def dq14(spark, sf):
    by = [F.coalesce(c, F.lit("")) for c in ("record_kind", "flag_a", "flag_b")]
    d = Q.status_cross(quotes(spark, sf), by, "contest_id", {"valid_win": valid_win(), "valid_place": valid_place()})
    return d.withColumnsRenamed({"k0": "record_kind", "k1": "flag_a", "k2": "flag_b"})


def dq15(spark, sf):
    cov = Q.coverage(joined(spark, sf), [], "found", "win_q", "low_q", "high_q")
    pat = Q.contest_patterns(joined(spark, sf), ["contest_id"], "found", "win_q", "low_q", "high_q", "all")
    pat = pat.agg(F.count_if(F.col("win_pattern") == "missing_rows").alias("n"))
    dup = Q.duplicate_key_count(quotes(spark, sf), ["contest_id", "entry_id"])
    checks = {"coverage:match_rate": (cov, "match_rate"), "coverage:win_rate": (cov, "win_rate"), "contests_without_quotes": (pat, "n"),
              "duplicate_quote_keys": (dup, "duplicate_keys")}
    return rounded(Q.preflight({"entries": entries(spark, sf), "quotes": quotes(spark, sf), "orders": table(spark, sf, "orders")}, checks), "value")


def dq16(spark, sf):
    d = labeled(spark, sf)
    return d.groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("win_odds") > 0).alias("win_odds_available"), F.count_if(F.col("win_pay") > 0).alias("win_pays"),
        F.count_if(F.col("place_pay") > 0).alias("place_pays"), F.sum("target_win_rank").alias("target_win"), F.sum("target_top2_rank").alias("target_top2"),
        F.sum("target_top3_rank").alias("target_place"),
        F.count_if((F.col("target_win_rank") != F.col("target_win_paid")) & (F.col("status") == "0")).alias("win_mismatch_normal"),
        F.count_if((F.col("target_top3_rank") != F.col("target_place_paid")) & (F.col("status") == "0")).alias("place_mismatch_normal"),
        F.count_if(F.col("win_odds") <= 0).alias("odds_not_positive"))


PROFILE = ["status", "track", "turf_going", "final_time", "body", "win_odds", "place_pay"]


def dq17(spark, sf):
    return rounded(Q.column_profile(panel(spark, sf), ["year"], PROFILE).drop("dtype"), "missing_rate")


def dq18(spark, sf):
    d = Q.special_cases(labeled(spark, sf), "status", [("target_win_rank", "target_win_paid", "win_vs_paid"), ("target_top3_rank", "target_place_paid", "place_vs_paid")])
    return d.select("entry_id", "note")


def dq19(spark, sf):
    return Q.counts_map(panel(spark, sf), ["year"], "track").select("year", F.to_json("counts").alias("counts"))


def dq20(spark, sf):
    old = audit_rows(spark, sf).select("entry_id", "year", F.when(F.col("has_quote"), F.col("win_q")).alias("q"), F.col("entry_popularity").alias("pop"))
    new = audit_rows(spark, sf).filter("status is not null").select("entry_id", "year", F.col("win_q").alias("q"), F.col("quote_popularity").alias("pop"))
    return Q.dataset_diff(old, new, "entry_id", "year", ["q", "pop"])


def dq21(spark, sf):
    d = bets(spark, sf)
    old = d.filter("segment <> 'N' or status = 'O'").select("entry_id", "year", F.col("p_model").alias("p"))
    new = d.filter("odds > 1.2").select("entry_id", "year", F.col("p_market").alias("p"))
    return rounded(Q.prediction_diff(old, new, ["entry_id"], ["year"], "p", 0.1), "max_diff", "mean_diff", "p99_diff")


def dq22(spark, sf):
    from pitpanel.operators.integrate import compare_full
    d = bets(spark, sf)
    a = d.filter("segment <> 'N'").select("entry_id", "year", "label")
    b = d.filter("status = 'O'").select("entry_id", "year", F.when(F.col("odds") > 4.5, 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    j = compare_full(a, b, ["entry_id", "year"])
    return j.groupBy("year", "side").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label_left") != F.col("label_right")).alias("label_conflicts"))


def dq23(spark, sf):
    return Q.target_integrity(labeled(spark, sf), ["year"], "target_place_paid", "place_pay", "field_size", "rank")


def dq24(spark, sf):
    d = labeled(spark, sf)
    return rounded(d.groupBy(F.when(F.col("year") <= 1998, "early").otherwise("late").alias("period"), "place_rank_limit",
                             F.when(F.col("field_size") <= 7, "<=7").otherwise(">=8").alias("field_group")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("target_place_paid").alias("positive_rate")), "positive_rate")


def dq24_drift(spark, sf):
    d = panel(spark, sf).groupBy("year").agg(F.avg("field_size").alias("mean_field"), F.avg("win_odds").alias("mean_odds"), F.avg("place_pay").alias("mean_pay"))
    return rounded(d, "mean_field", "mean_odds", "mean_pay")


def dq24_saturation(spark, sf):
    from pitpanel.functions.ordered import quantiles
    from pitpanel.operators.metrics import join_groups
    from pitpanel.plans.q_history import prior
    h = prior(spark, sf, ["runner", "rider", "coach"], ["year"])
    g = ["year", "store"]
    out = join_groups(h.groupBy(*g).agg(F.stddev_samp("wins_rate").alias("std_win_rate")), quantiles(h, g, "starts", [0.5, 0.9, 0.99]), g)
    return rounded(out.withColumnsRenamed({"q0": "p50_starts", "q1": "p90_starts", "q2": "p99_starts"}), "std_win_rate", "p50_starts", "p90_starts", "p99_starts")


def dq24_logit(spark, sf):
    """Market logit by year; years before 1996 are extrapolated."""
    d = Q.extrapolation_audit(bets(spark, sf), "year", F.col("p_market"), 1996)
    return rounded(d, "mean", "std", "p01", "p99")


def dq19_frequent(spark, sf):
    """Part numbers that hold at least one in 2,000 of a year's rows; all others as one row a year."""
    return Q.frequent_values(panel(spark, sf), ["year"], "coach", 0.0005)


QUERIES = {
    "dq1_coverage_by_year": dq1, "dq2_coverage_by_status": dq2, "dq3_dimension_missingness": dq3, "dq4_value_encoding": dq4,
    "dq5_missing_contest_samples": dq5, "dq6_duplicate_keys": dq6, "dq6_schema_summary": dq6_schema, "dq7_status_cross": dq7, "dq8_flag_values": dq8,
    "dq9_patterns_any": dq9("any"), "dq9_patterns_all": dq9("all"), "dq9_partial_samples": dq9_samples, "dq10_count_consistency": dq10,
    "dq11_two_source_comparison": dq11, "dq11_comparison_by_year": dq11_year, "dq12_timing": dq12, "dq14_record_state": dq14, "dq15_preflight": dq15,
    "dq16_yearly_quality": dq16, "dq17_column_profile": dq17, "dq18_special_cases": dq18, "dq19_counts_map": dq19, "dq20_dataset_diff": dq20,
    "dq21_prediction_diff": dq21, "dq22_alignment": dq22, "dq23_target_integrity": dq23, "dq24_target_definition": dq24, "dq24_yearly_drift": dq24_drift,
    "dq24_history_saturation": dq24_saturation, "dq24_market_logit": dq24_logit, "dq19_frequent_values": dq19_frequent,
}


def blank(c):
    return f"({c} IS NULL OR trim({c})='')"


def num(c):
    return f"coalesce(try_cast({c} AS double),0)"


def valid(c):
    return f"(NOT {blank(c)} AND {num(c)}>0 AND {num(c)} NOT IN (9999,999.9,99999))"


def invalid(c):
    return f"(NOT {blank(c)} AND ({num(c)}<=0 OR {num(c)} IN (9999,999.9,99999)))"


VW, VP = valid("win_q"), f"({valid('low_q')} AND {valid('high_q')})"
NP, IP = f"({blank('low_q')} OR {blank('high_q')})", f"({invalid('low_q')} OR {invalid('high_q')})"
J = f"WITH {JOINED} "
QT = f"WITH {AUDIT}, q AS (SELECT * FROM audit WHERE has_quote) "


def cov(by):
    head = f"{by}, " if by else ""
    return (f"SELECT {head}count(*) AS rows, count(*) FILTER (found) AS matched, count(*) FILTER (NOT found) AS missing, count(*) FILTER (found AND {VW}) AS valid_win, count(*) FILTER (found AND {blank('win_q')}) AS null_win, "
            f"count(*) FILTER (found AND {invalid('win_q')}) AS invalid_win, count(*) FILTER (found AND {VP}) AS valid_place, count(*) FILTER (found AND {NP}) AS null_place, count(*) FILTER (found AND {IP}) AS invalid_place, "
            f"round(count(*) FILTER (found)/count(*),6) AS match_rate, round(count(*) FILTER (found AND {VW})/count(*),6) AS win_rate, round(count(*) FILTER (found AND {VP})/count(*),6) AS place_rate FROM j")


def status(v, n, i):
    return f"CASE WHEN NOT found THEN 'missing_row' WHEN {v} THEN 'valid' WHEN {n} THEN 'null' WHEN {i} THEN 'zero_or_invalid' ELSE 'conversion_unknown' END"


def enc(c):
    v = f"CASE WHEN {c} IS NOT NULL THEN {num(c)} END"
    t = f"cast({c} AS varchar)"
    return (f"SELECT count(*) AS rows, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, count(*) FILTER (trim({t})='') AS empty_count, count(*) FILTER (trim({t})<>'' AND {v}=0) AS zero_count, "
            f"count(*) FILTER ({v}<0) AS negative_count, count(*) FILTER ({v} IN (9999,999.9,99999)) AS sentinel_count, min({v})::double AS min_value, max({v})::double AS max_value FROM q")


def pat(policy):
    gone = "missing>0" if policy == "any" else "missing=entries"

    def p(v):
        return f"CASE WHEN {gone} THEN 'missing_rows' WHEN {v}=entries THEN 'all_valid' WHEN {v}=0 THEN 'all_null' ELSE 'partially_valid' END"

    return J + f""", c AS (SELECT contest_id, count(*) AS entries, count(*) FILTER (NOT found) AS missing, count(*) FILTER (found AND {VW}) AS win_valid, count(*) FILTER (found AND {blank('win_q')}) AS win_null,
 count(*) FILTER (found AND {VP}) AS place_valid, count(*) FILTER (found AND {NP}) AS place_null FROM j GROUP BY 1), p AS (SELECT *, {p('win_valid')} AS win_pattern, {p('place_valid')} AS place_pattern FROM c)"""


HYP = J + f""", h AS (SELECT unnest(['as_is','left_div10','right_div10','left_div100','right_div100']) AS comparison, unnest([1.0,10.0,1.0,100.0,1.0])::double AS a, unnest([1.0,1.0,10.0,1.0,100.0])::double AS b),
 d AS (SELECT comparison, abs(entry_odds/a - cast(win_q AS double)/b) AS d FROM j, h WHERE found AND {VW}), r AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY d)-1 AS i, count(*) OVER (PARTITION BY comparison) AS n FROM d)"""
MADE = "try_strptime(make_date,'%Y%m%d')::date"
SQL = {
    "dq1_coverage_by_year": J + cov("year") + " GROUP BY year",
    "dq2_coverage_by_status": J + cov("coalesce(status,'') AS status") + " GROUP BY coalesce(status,'')",
    "dq3_dimension_missingness": J + f""", l AS (SELECT found, {VW} AS v, unnest({DIMS}) AS dimension, unnest([{','.join(f"coalesce(cast({d} AS varchar),'(null)')" for d in DIMS)}]) AS value FROM j),
 g AS (SELECT dimension, value, count(*) AS rows, count(*) FILTER (NOT found) AS missing, count(*) FILTER (found AND v) AS valid FROM l GROUP BY 1,2)
 SELECT dimension, value, rows, missing, valid, round(valid/rows,6) AS valid_rate FROM g""",
    "dq4_value_encoding": QT + " UNION ALL ".join(enc(c) for c in ["win_q", "low_q", "high_q"]) + " UNION ALL " + enc("quote_popularity"),
    "dq5_missing_contest_samples": J + f""", m AS (SELECT contest_id, count(*) FILTER (NOT found OR NOT {VW}) AS missing_rows, count(*) AS entries FROM j GROUP BY 1 HAVING count(*) FILTER (NOT found OR NOT {VW})>0 ORDER BY contest_id LIMIT 50)
 SELECT contest_id, entry_id, missing_rows, entries, win_q, found FROM j JOIN m USING (contest_id)""",
    "dq6_duplicate_keys": "SELECT count(*) FILTER (n>1) AS duplicate_keys, cast(sum(n) AS bigint) AS rows, count(*) AS distinct_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "dq6_schema_summary": f"WITH {AUDIT} " + " UNION ALL ".join(f"SELECT 'audit' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM audit" for c in ["status", "win_q", "low_q", "flag_a", "make_date"]),
    "dq7_status_cross": J + f"""SELECT year, coalesce(record_kind,'missing_row') AS record_kind, coalesce(flag_a,'missing_row') AS flag, {status(VW, blank('win_q'), invalid('win_q'))} AS win_status, {status(VP, NP, IP)} AS place_status,
 count(*) AS rows, count(DISTINCT contest_id) AS contests, count(*) FILTER ({VW}) AS valid_win, count(*) FILTER ({VP}) AS valid_place FROM j GROUP BY 1,2,3,4,5""",
    "dq8_flag_values": QT + f"SELECT flag, value, count(*) AS rows, count(*) FILTER (vw) AS valid_win, count(*) FILTER (vp) AS valid_place FROM (SELECT {VW} AS vw, {VP} AS vp, unnest(['record_kind','flag_a','flag_b']) AS flag, unnest([record_kind, coalesce(flag_a,''), flag_b]) AS value FROM q) GROUP BY 1,2",
    "dq9_patterns_any": pat("any") + " SELECT win_pattern, place_pattern, count(*) AS contests, cast(sum(entries) AS bigint) AS entries, count(*) FILTER (win_valid=place_valid AND win_null=place_null) AS same_contests FROM p GROUP BY 1,2",
    "dq9_patterns_all": pat("all") + " SELECT win_pattern, place_pattern, count(*) AS contests, cast(sum(entries) AS bigint) AS entries, count(*) FILTER (win_valid=place_valid AND win_null=place_null) AS same_contests FROM p GROUP BY 1,2",
    "dq9_partial_samples": pat("any") + " SELECT contest_id, entries, win_valid, place_valid, win_pattern, place_pattern FROM p WHERE win_pattern='partially_valid' OR place_pattern='partially_valid'",
    "dq10_count_consistency": J + """, c AS (SELECT contest_id, count(DISTINCT entry_no) AS entry_rows, count(DISTINCT entry_no) FILTER (found) AS quote_rows FROM j GROUP BY 1)
 SELECT contest_id, entry_rows, quote_rows, 2+o_custkey%4 AS declared, (quote_rows<>entry_rows OR 2+o_custkey%4<>entry_rows) AS anomaly FROM c JOIN orders ON o_orderkey=contest_id""",
    "dq11_two_source_comparison": HYP + """ SELECT comparison, count(*) AS compared, count(*) FILTER (d=0) AS exact, count(*) FILTER (d<=1e-9) AS within_tolerance, round(avg(d),6) AS mean_diff, round(max(d),6) AS max_diff, round(median(d),6) AS median_diff,
 round(max(d) FILTER (i=round_even((n-1)*0.95,0)),6) AS p95_diff, round(max(d) FILTER (i=round_even((n-1)*0.99,0)),6) AS p99_diff, round(count(*) FILTER (d=0)/count(*),6) AS exact_rate FROM r GROUP BY 1""",
    "dq11_comparison_by_year": J + f"SELECT year, count(*) AS compared, round(avg(cast(abs(entry_odds-cast(win_q AS double)/10.0)=0 AS int)),6) AS exact_rate, round(avg(abs(entry_odds-cast(win_q AS double)/10.0)),6) AS mean_diff, round(avg(cast(entry_popularity=quote_popularity AS int)),6) AS rank_match_rate FROM j WHERE found AND {VW} GROUP BY 1",
    "dq12_timing": J + f""", t AS (SELECT *, {MADE} - event_date AS days FROM j) SELECT year, CASE WHEN days IS NULL THEN 'unknown' WHEN days<0 THEN 'before_event' WHEN days=0 THEN 'same_day' WHEN days=1 THEN 'day_after' WHEN days<=7 THEN '2_to_7_days_after' ELSE 'more_than_7_days_after' END AS timing_bucket,
 count(*) AS rows, count(*) FILTER ({blank('make_date')}) AS missing_make_date, min(days) AS min_days, max(days) AS max_days, count(*) FILTER ({VW}) AS valid_win, count(*) FILTER ({VP}) AS valid_place FROM t GROUP BY 1,2""",
    "dq14_record_state": QT + f"SELECT record_kind, coalesce(flag_a,'') AS flag_a, flag_b, count(*) AS rows, count(DISTINCT contest_id) AS contests, count(*) FILTER ({VW}) AS valid_win, count(*) FILTER ({VP}) AS valid_place FROM q GROUP BY 1,2,3",
    "dq15_preflight": J + f""", w AS (SELECT contest_id FROM j GROUP BY 1 HAVING count(*) FILTER (found)=0), dup AS (SELECT contest_id, entry_id FROM j WHERE found GROUP BY 1,2 HAVING count(*)>1)
 SELECT 'rows:entries' AS "check", cast(count(*) AS double) AS value FROM j UNION ALL SELECT 'rows:quotes', count(*) FROM j WHERE found UNION ALL SELECT 'rows:orders', count(*) FROM orders
 UNION ALL SELECT 'coverage:match_rate', round(count(*) FILTER (found)/count(*),6) FROM j UNION ALL SELECT 'coverage:win_rate', round(count(*) FILTER (found AND {VW})/count(*),6) FROM j
 UNION ALL SELECT 'contests_without_quotes', count(*) FROM w UNION ALL SELECT 'duplicate_quote_keys', count(*) FROM dup""",
    "dq16_yearly_quality": "WITH " + LABELED + """ SELECT year, count(*) AS rows, count(*) FILTER (win_odds>0) AS win_odds_available, count(*) FILTER (win_pay>0) AS win_pays, count(*) FILTER (place_pay>0) AS place_pays, cast(sum(target_win_rank) AS bigint) AS target_win,
 cast(sum(target_top2_rank) AS bigint) AS target_top2, cast(sum(target_top3_rank) AS bigint) AS target_place, count(*) FILTER (target_win_rank<>target_win_paid AND status='0') AS win_mismatch_normal,
 count(*) FILTER (target_top3_rank<>target_place_paid AND status='0') AS place_mismatch_normal, count(*) FILTER (win_odds<=0) AS odds_not_positive FROM labeled GROUP BY 1""",
    "dq17_column_profile": f"WITH {PANEL}, l AS (SELECT year, unnest({PROFILE}) AS column_name, unnest([{','.join(f'cast({c} AS varchar)' for c in PROFILE)}]) AS v FROM panel) SELECT year, column_name, count(*) FILTER (v IS NULL) AS null_count, round(count(*) FILTER (v IS NULL)/count(*),6) AS missing_rate, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS unique_count FROM l GROUP BY 1,2",
    "dq18_special_cases": "WITH " + LABELED + " SELECT entry_id, note FROM (SELECT entry_id, CASE WHEN status<>'0' THEN 'abnormal_or_refund' WHEN target_win_rank<>target_win_paid THEN 'win_vs_paid' WHEN target_top3_rank<>target_place_paid THEN 'place_vs_paid' END AS note FROM labeled) WHERE note IS NOT NULL",
    "dq19_counts_map": f"""WITH {PANEL}, c AS (SELECT year, track, count(*) AS n FROM panel GROUP BY 1,2) SELECT year, '{{'||string_agg('"'||track||'":'||n, ',' ORDER BY track)||'}}' AS counts FROM c GROUP BY 1""",
    "dq20_dataset_diff": f"""WITH {AUDIT}, o AS (SELECT entry_id, year, CASE WHEN has_quote THEN win_q END AS q, entry_popularity AS pop FROM audit), n AS (SELECT entry_id, year, win_q AS q, quote_popularity AS pop FROM audit WHERE status IS NOT NULL)
 SELECT coalesce(o.year,n.year) AS year, count(o.entry_id) AS old_rows, count(n.entry_id) AS new_rows, count(*) FILTER (o.entry_id IS NOT NULL AND n.entry_id IS NOT NULL) AS shared_keys,
 count(*) FILTER (o.entry_id IS NOT NULL AND n.entry_id IS NOT NULL AND o.q IS NOT DISTINCT FROM n.q AND o.pop IS NOT DISTINCT FROM n.pop) AS agreeing_rows,
 count(*) FILTER (o.entry_id IS NOT NULL AND n.entry_id IS NOT NULL AND o.q IS NULL AND n.q IS NOT NULL) AS q_filled, count(*) FILTER (o.entry_id IS NOT NULL AND n.entry_id IS NOT NULL AND o.pop IS NULL AND n.pop IS NOT NULL) AS pop_filled,
 count(*) FILTER (o.entry_id IS NOT NULL AND n.entry_id IS NOT NULL AND o.q IS NOT NULL AND n.q IS NULL) AS q_lost, count(*) FILTER (o.entry_id IS NOT NULL AND n.entry_id IS NOT NULL AND o.pop IS NOT NULL AND n.pop IS NULL) AS pop_lost
 FROM o FULL JOIN n ON o.entry_id=n.entry_id GROUP BY 1""",
    "dq21_prediction_diff": f"""WITH {BETS}, o AS (SELECT entry_id, year, p_model AS p FROM bets WHERE segment<>'N' OR status='O'), n AS (SELECT entry_id, year, p_market AS p FROM bets WHERE odds>1.2), j AS (SELECT coalesce(o.year,n.year) AS year, o.p AS a, n.p AS b, abs(o.p-n.p) AS d FROM o FULL JOIN n USING (entry_id, year))
 SELECT year, count(d) AS compared, round(max(d),6) AS max_diff, round(avg(d),6) AS mean_diff, count(*) FILTER (d>0.1) AS mismatches, count(*) FILTER (b IS NULL) AS missing_in_new, count(*) FILTER (a IS NULL) AS missing_in_old, round(quantile_cont(d,0.99),6) AS p99_diff FROM j GROUP BY 1""",
    "dq22_alignment": f"""WITH {BETS}, a AS (SELECT entry_id, year, label FROM bets WHERE segment<>'N'), b AS (SELECT entry_id, year, CASE WHEN odds>4.5 THEN 1-label ELSE label END AS label FROM bets WHERE status='O')
 SELECT coalesce(a.year,b.year) AS year, CASE WHEN a.entry_id IS NOT NULL AND b.entry_id IS NOT NULL THEN 'both' WHEN a.entry_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side, count(*) AS rows, count(*) FILTER (a.label<>b.label) AS label_conflicts
 FROM a FULL JOIN b ON a.entry_id=b.entry_id AND a.year=b.year GROUP BY 1,2""",
    "dq23_target_integrity": "WITH " + LABELED + " SELECT year, count(*) AS rows, count(*) FILTER ((target_place_paid=1)<>(coalesce(place_pay,0)>0)) AS label_payout_mismatch, count(*) FILTER (target_place_paid=1 AND NOT coalesce(place_pay,0)>0) AS positive_without_payout, count(*) FILTER (field_size<=7 AND rank=3 AND coalesce(place_pay,0)>0) AS small_field_third_paid FROM labeled GROUP BY 1",
    "dq24_target_definition": "WITH " + LABELED + " SELECT CASE WHEN year<=1998 THEN 'early' ELSE 'late' END AS period, place_rank_limit, CASE WHEN field_size<=7 THEN '<=7' ELSE '>=8' END AS field_group, count(*) AS rows, round(avg(target_place_paid),6) AS positive_rate FROM labeled GROUP BY 1,2,3",
    "dq24_market_logit": f"WITH {BETS}, l AS (SELECT year, ln(p_market/(1.0-p_market)) AS l FROM bets WHERE p_market>0 AND p_market<1) SELECT year, year<1996 AS extrapolation, count(*) AS rows, round(avg(l),6) AS mean, round(stddev_samp(l),6) AS std, round(quantile_cont(l,0.01),6) AS p01, round(quantile_cont(l,0.99),6) AS p99 FROM l GROUP BY 1",
    "dq19_frequent_values": f"WITH {PANEL}, c AS (SELECT year, coach AS value, count(*) AS n FROM panel GROUP BY 1,2), g AS (SELECT *, n>=sum(n) OVER (PARTITION BY year)*0.0005::double AS kept FROM c) SELECT year, kept, CASE WHEN kept THEN value END AS value, cast(sum(n) AS bigint) AS rows, count(*) AS distinct_values FROM g GROUP BY 1,2,3",
    "dq24_yearly_drift": f"WITH {PANEL} SELECT year, round(avg(field_size),6) AS mean_field, round(avg(win_odds),6) AS mean_odds, round(avg(place_pay),6) AS mean_pay FROM panel GROUP BY 1",
}


def _late():
    from pitpanel.plans.q_history import PRIOR
    SQL["dq24_history_saturation"] = "WITH " + PRIOR + """ SELECT year, store, round(stddev_samp(wins/nullif(starts,0)),6) AS std_win_rate, round(quantile_cont(starts,0.5),6) AS p50_starts, round(quantile_cont(starts,0.9),6) AS p90_starts,
 round(quantile_cont(starts,0.99),6) AS p99_starts FROM prior JOIN (SELECT entry_id, year FROM panel) USING (entry_id) WHERE store IN ('runner','rider','coach') GROUP BY 1,2"""


_late()
