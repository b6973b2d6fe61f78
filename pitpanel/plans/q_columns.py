"""Registered queries: projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.operators import features as T
from pitpanel.operators import ledger as L
from pitpanel.operators import contest as C
from pitpanel.operators.metrics import long_scores
from pitpanel.plans.base import AUDIT, BETS, PANEL, SCORED, audit_rows, bets, panel, r6, rounded, scored, table, with_value
from pitpanel.sources.readers import classify_source

ODDS_BANDS = [("low", None, 1.5), ("mid", 1.5, 3.0), ("high", 3.0, None), ("special", 2.0, 2.2)]
MARKET = {"odds_log": 0.8, "p_alt": 1.5}
RULES = [{"rule_id": "core", "strategy_type": "win_core", "ev_min": 1.0}, {"rule_id": "value", "strategy_type": "win_value", "odds_min": 2.0, "odds_max": 4.5},
         {"rule_id": "reversal", "strategy_type": "win_rank_reversal", "edge_min": 0.0, "segment_segment": "R"}, {"rule_id": "edge", "rank_gap_min": 1, "margin_min": 0.02, "entropy_max": 0.99}]


def pr1(spark, sf):
    d = panel(spark, sf)
    key = X.contest_key(F.col("event_date"), F.col("venue"), F.col("entry_no"), F.col("contest_id") % 100)
    return d.select("entry_id", key.alias("contest_key"))


def pr2(spark, sf):
    d = panel(spark, sf)
    return d.select("entry_id", X.mmdd_date(F.col("year"), F.col("month_day")).cast("string").alias("day"), F.floor(F.col("month_day") / 100).cast("int").alias("month"))


def pr3(spark, sf):
    return panel(spark, sf).select("entry_id", X.sort_key(F.col("year"), F.col("month_day"), F.col("venue").cast("int"), F.col("entry_no")).alias("sort_key"))


def pr4(spark, sf):
    d = panel(spark, sf)
    return d.groupBy(X.width_band(F.col("distance"), 200).alias("band"), X.surface_code(F.col("track")).alias("surface"),
                     X.going_code(F.col("track"), F.col("turf_going"), F.col("dirt_going")).alias("going")).agg(F.count(F.lit(1)).alias("entries"))


def pr5(spark, sf):
    d = bets(spark, sf)
    odds = X.bucketize(F.col("odds"), [1.0, 1.5, 2.0, 3.0, 5.0], right=False)
    ev = X.bucketize(F.col("ev"), [0.0, 0.8, 1.0, 1.2, 2.0], right=True)
    p = X.bucketize(F.col("p_model"), [0.0, 0.1, 0.2, 0.4, 1.0], right=True, include_lowest=True)
    return d.groupBy(odds.alias("odds_band"), ev.alias("ev_band"), p.alias("p_band")).agg(F.count(F.lit(1)).alias("entries"))


def pr6(spark, sf):
    d = scored(spark, sf)
    return d.groupBy(X.config_band(F.col("odds"), ODDS_BANDS, "last", "(none)").alias("last_band"),
                     X.config_band(F.col("odds"), ODDS_BANDS, "first", "(none)").alias("first_band")).agg(F.count(F.lit(1)).alias("entries"))


def pr7(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("coach"), "p_name")
    d = T.add_segments(panel(spark, sf).join(p, "coach"), "track", "distance", "p_name", "event_date", "venue", "field_size")
    return d.groupBy("surface", "distance_group", "handicap_flag", "field_size_band", "month", "venue_text").agg(F.count(F.lit(1)).alias("entries"))


def pr8(spark, sf):
    d = panel(spark, sf)
    return d.select("entry_id", X.coalesce_columns(d, ["missing_name", "body", "final_time"], 0).cast("double").alias("value"),
                    X.coalesce_columns(d, ["no_such_column"], "n/a").alias("fallback"))


VENUES = {"0A": "Alpha", "0N": "November"}


def normalised(spark, sf):
    d = bets(spark, sf).withColumns({"venue": F.col("segment"), "p_raw_only": F.col("p_alt")})
    d = d.select("event_date", "contest_id", "entry_id", "entry_no", "venue", "p_market", F.col("p_alt").alias("probability_raw"),
                 F.when(F.col("status") == "O", F.col("p_model")).alias("probability_calibrated"), F.col("odds").alias("fuku_odds_low"), "pay", "label",
                 F.col("supp_id").cast("string").alias("runner"))
    path = F.concat(F.lit("out/"), F.when(F.col("entry_no") <= 3, "backtest").when(F.col("entry_no") <= 5, "forward_paper").otherwise("other"))
    return L.normalise_predictions(d, path, classify_source(path), VENUES)


def pr9(spark, sf):
    d = normalised(spark, sf)
    return rounded(d, "expected_value").select("entry_id", F.col("race_date").cast("string").alias("race_date"), "venue", "venue_name", "name", "source_type",
                                               "retrospective_only", "ev_probability_source", "expected_value", "tier", "selected_for_bet", "target_place_paid",
                                               "stake", "payout", "profit", "validation_year")


def pr10(spark, sf):
    return bets(spark, sf).groupBy(X.tier(F.col("ev")).alias("tier")).agg(F.count(F.lit(1)).alias("entries"))


def pr11(spark, sf):
    d = bets(spark, sf)
    return d.select("entry_id", r6(X.logit(F.col("p_market"))).alias("logit"), r6(X.sigmoid(X.logit(F.col("p_market")) * 0.9 + 0.1)).alias("sigmoid"), r6(X.clip(F.col("p_market"), 0.05)).alias("clipped"))


def pr12(spark, sf):
    d = T.market_features(scored(spark, sf).withColumn("odds_high", F.col("odds") + F.col("entry_no") / 10.0), "odds", "odds_high")
    return rounded(d, "odds_width", "odds_mid", "log_low", "log_high", "inv_low", "inv_high", "inv_mid").select(
        "entry_id", "odds_width", "odds_mid", "log_low", "log_high", "inv_low", "inv_high", "inv_mid")


def pr13(spark, sf):
    d = bets(spark, sf)
    p, q, o = F.col("p_model"), F.col("p_market"), F.col("odds")
    return d.select("entry_id", r6(p * o).alias("ev"), r6(1.0 / o).alias("break_even"), r6(p - 1.0 / o).alias("edge"), r6(X.blend(p, q, 0.7)).alias("conservative"),
                    r6(X.blend(p, q, 0.7) * o).alias("conservative_ev"))


def pr14(spark, sf):
    d = panel(spark, sf).filter("win_odds is not null")
    from pitpanel.operators.labels import place_limit
    return d.select("entry_id", r6(X.heuristic_prior(F.col("win_odds"), place_limit(F.col("field_size")), F.col("field_size"))).alias("prior"))


def pr15(spark, sf):
    return bets(spark, sf).select("entry_id", r6(X.logit(F.col("p_model")) - X.logit(1.0 / F.col("odds"))).alias("margin"))


def pr16(spark, sf):
    d = audit_rows(spark, sf)
    return d.select("entry_id", X.finite(F.col("win_q")).alias("win"), X.category(F.col("status")).alias("status"), X.category(F.col("flag_a")).alias("flag"))


def pr17(spark, sf):
    d = T.winsorise(scored(spark, sf), "odds", F.col("year") <= 1998, 0.9)
    return rounded(d, "odds_clip", "odds_log1p", "odds_clip_log1p").groupBy("odds", "odds_clip", "odds_log1p", "odds_clip_log1p").agg(F.count(F.lit(1)).alias("entries"))


def pr18(spark, sf):
    from pitpanel.plans.q_history import prior
    h = prior(spark, sf, ["rider"], ["year"])
    d = T.smooth_rate(h, "wins_rate", "starts", F.col("year") <= 1998, 20.0, "smoothed")
    return rounded(d, "smoothed").select("entry_id", "smoothed")


def pr19(spark, sf):
    from pitpanel.plans.q_history import prior
    h = prior(spark, sf, ["rider"]).withColumn("blurred", F.col("wins_rate") * 0.999)
    return rounded(T.count_reconstruction_error(h, [("wins_rate", "starts"), ("top3_rate", "starts"), ("blurred", "starts")]), "max_error")


def pr20(spark, sf):
    d = T.decay_weights(scored(spark, sf).filter("year < 2001"), F.lit(2001) - F.col("year"), 3.0)
    return rounded(T.effective_sample_size(d, "weight"), "sum_w", "ess", "min_w", "max_w", digits=4)


def pr21(spark, sf):
    d = bets(spark, sf).withColumn("odds_log", F.log("odds"))
    z = X.linear_score(MARKET, -0.5, {"odds_log": 1.0, "p_alt": 0.3}, {"odds_log": 0.4, "p_alt": 0.2})
    return d.select("entry_id", r6(X.sigmoid(z)).alias("p"))


def pr22(spark, sf):
    return bets(spark, sf).select("entry_id", r6(X.platt(F.col("p_model"), 0.93, -0.05)).alias("p"))


def ranked(spark, sf, **others):
    """Bets with ranks, margin and entropy of their contest, from one shuffle by contest; ``others`` names further scores to rank by."""
    d = C.contest_view(with_value(scored(spark, sf)), ["contest_id"], "p_model", 1.0 / F.col("odds"), "p_market", "entry_id", others)
    return d.withColumns({"rank_gap": F.col("market_rank") - F.col("model_rank"), "edge": F.col("p_model") - F.col("p_market")})


def pr23(spark, sf):
    d = ranked(spark, sf)
    one = d.agg(*[F.count_if(X.rule_mask(r)).alias(r["rule_id"]) for r in RULES])
    return one.unpivot([], [r["rule_id"] for r in RULES], "rule_id", "picks")


def pr24(spark, sf):
    d = normalised(spark, sf)
    d = d.filter("race_date between '1996-01-01' and '1999-12-31' and not fixture and source_type <> 'FORWARD_PAPER'")
    return L.keep_contests_with_tier(d, "race_id", "tier", ["VERY_HIGH"]).select("race_id", "entry_id", "tier")


def pr25(spark, sf):
    d = long_scores(bets(spark, sf), ["entry_id"], ["p_model", "p_alt", "p_market"])
    return rounded(d, "p")


def pr26(spark, sf):
    d = panel(spark, sf).select("entry_id", "event_date", F.col("event_date").cast("timestamp").alias("ts"), F.date_format("event_date", "yyyyMMdd").alias("packed"), F.col("event_date").cast("string").alias("text"))
    same = (X.iso_day(F.col("ts")) == F.col("event_date")) & (X.iso_day(F.col("packed")) == F.col("event_date")) & (X.iso_day(F.col("text")) == F.col("event_date"))
    return d.agg(F.count_if(same).alias("agreeing"), F.count_if(X.iso_day(F.concat(F.col("text"), F.lit("x"))).isNotNull()).alias("bad_accepted"))


def pr27(spark, sf):
    d = audit_rows(spark, sf)
    return d.groupBy(X.quote_class(F.col("win_q"), F.col("has_quote")).alias("win_class"), X.quote_class(F.col("low_q")).alias("low_class")).agg(F.count(F.lit(1)).alias("entries"))


def pr28(spark, sf):
    d = panel(spark, sf)
    return d.groupBy(X.is_valid_id(F.col("runner")).alias("valid_runner"), F.coalesce(X.is_positive(F.col("rank")).cast("int"), F.lit(-1)).alias("positive_rank"),
                     F.coalesce(X.is_positive(F.col("win_odds")).cast("int"), F.lit(-1)).alias("positive_odds")).agg(F.count(F.lit(1)).alias("entries"))


def pr29(spark, sf):
    d = normalised(spark, sf)
    return d.groupBy("venue_name", "target_place_paid").agg(F.count(F.lit(1)).alias("entries"))


def pr30(spark, sf):
    d = bets(spark, sf).filter(X.pick_mask(F.col("p_model"), F.col("odds"), 1.05, 2.0, 4.0))
    return d.select("entry_id")


def odd_bets(spark, sf):
    """Bets of which some have a NaN or infinite expected value."""
    ev = F.when(F.col("entry_no") == 2, float("nan")).when(F.col("entry_no") == 3, float("inf")).when(F.col("entry_no") == 4, float("-inf")).otherwise(F.col("ev"))
    return bets(spark, sf).withColumn("ev", ev)


def pr10_odd(spark, sf):
    return odd_bets(spark, sf).groupBy("entry_no", X.tier(F.col("ev")).alias("tier")).agg(F.count(F.lit(1)).alias("entries"))


def pr27_odd(spark, sf):
    q = F.when(F.col("entry_no") == 2, "NaN").when(F.col("entry_no") == 3, "Infinity").otherwise(F.col("win_q"))
    d = audit_rows(spark, sf).withColumn("q", q)
    return d.groupBy("entry_no", X.quote_class(F.col("q")).alias("class")).agg(F.count(F.lit(1)).alias("entries"))


def pr30_odd(spark, sf):
    odd = odd_bets(spark, sf).withColumn("p_odd", F.col("ev") / F.col("odds"))
    return odd.filter(X.pick_mask(F.col("p_odd"), F.col("odds"), 1.05, 2.0, 4.0)).select("entry_id")


QUERIES = {
    "pr1_contest_key": pr1, "pr2_mmdd_date": pr2, "pr3_sort_key": pr3, "pr4_bands_surface_going": pr4, "pr5_range_buckets": pr5, "pr6_config_bands": pr6,
    "pr7_segments": pr7, "pr8_ordered_coalesce": pr8, "pr9_normalised_predictions": pr9, "pr10_ev_tier": pr10, "pr11_logit_sigmoid": pr11,
    "pr12_market_transforms": pr12, "pr13_ev_edge_blend": pr13, "pr14_heuristic_prior": pr14, "pr15_logit_margin": pr15, "pr16_model_input": pr16,
    "pr17_winsorise": pr17, "pr18_rate_smoothing": pr18, "pr19_count_reconstruction": pr19, "pr20_decay_weights": pr20, "pr21_frozen_logistic": pr21,
    "pr22_frozen_platt": pr22, "pr23_rule_mask": pr23, "pr24_dashboard_filter": pr24, "pr25_melt": pr25, "pr26_key_canonical": pr26, "pr27_quote_classes": pr27,
    "pr28_id_validity": pr28, "pr29_code_labels": pr29, "pr30_simple_picks": pr30,
    "pr10_tier_of_odd_numbers": pr10_odd, "pr27_classes_of_odd_quotes": pr27_odd, "pr30_picks_of_odd_numbers": pr30_odd,
}
W, B, PN, A = f"WITH {SCORED} ", f"WITH {BETS} ", f"WITH {PANEL} ", f"WITH {AUDIT} "


def lg(p, e="1e-6"):
    q = f"greatest({e},least(1.0-{e},{p}))"
    return f"ln({q}/(1.0-{q}))"


def band(c, edges, right, lowest=False):
    out = "CASE "
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        left = ">=" if (not right or (i == 0 and lowest)) else ">"
        out += f"WHEN {c}{left}{lo} AND {c}{'<=' if right else '<'}{hi} THEN '{'(' if right else '['}{lo:g},{hi:g}{']' if right else ')'}' "
    return out + "ELSE '(none)' END"


def cfg(order):
    out = "CASE "
    for n, lo, hi in order:
        cond = " AND ".join(([f"odds>={lo}"] if lo is not None else []) + ([f"odds<{hi}"] if hi is not None else []))
        out += f"WHEN {cond} THEN '{n}' "
    return out + "ELSE '(none)' END"


TIER = "CASE WHEN {e}>=1.15 THEN 'VERY_HIGH' WHEN {e}>=1.10 THEN 'HIGH' WHEN {e}>=1.05 THEN 'MARGIN' WHEN {e}>=1.00 THEN 'CORE' ELSE 'NONE' END"
NORM = BETS + f""", n0 AS (SELECT *, CASE WHEN status='O' THEN p_model ELSE p_alt END*odds AS e FROM bets),
 norm AS (SELECT entry_id, cast(contest_id AS varchar) AS race_id, event_date, cast(event_date AS varchar) AS race_date, '0'||segment AS venue, CASE segment WHEN 'A' THEN 'Alpha' WHEN 'N' THEN 'November' ELSE 'venue 0'||segment END AS venue_name,
 'no '||entry_no||' / '||supp_id AS name, CASE WHEN entry_no<=3 THEN 'BACKTEST' WHEN entry_no<=5 THEN 'FORWARD_PAPER' ELSE 'UNKNOWN' END AS source_type, entry_no<=3 AS retrospective_only,
 CASE WHEN status='O' THEN 'probability_calibrated' ELSE 'probability_raw' END AS ev_probability_source, e AS expected_value, {TIER.format(e='e')} AS tier, e>=1.0 AS selected_for_bet, label AS target_place_paid,
 CASE WHEN e>=1.0 THEN 100 ELSE 0 END AS stake, (CASE WHEN e>=1.0 AND label=1 THEN pay ELSE 0 END)::double AS payout, (CASE WHEN e>=1.0 AND label=1 THEN pay ELSE 0 END)::double - CASE WHEN e>=1.0 THEN 100 ELSE 0 END AS profit, year AS validation_year FROM n0)"""
RANKED = BETS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY p_model DESC, entry_id) AS model_rank, row_number() OVER (PARTITION BY contest_id ORDER BY p_market DESC, entry_id) AS market_rank, p_model/sum(p_model) OVER (PARTITION BY contest_id) AS q FROM bets),
 ranked AS (SELECT *, market_rank-model_rank AS rank_gap, p_model-p_market AS edge, max(CASE WHEN model_rank=1 THEN p_model END) OVER g - coalesce(max(CASE WHEN model_rank=2 THEN p_model END) OVER g,0) AS margin,
 sum(-q*ln(q)) OVER g/ln(greatest(count(*) OVER g,2)) AS entropy FROM rk WINDOW g AS (PARTITION BY contest_id))"""
SQL = {
    "pr1_contest_key": PN + "SELECT entry_id, strftime(event_date,'%Y%m%d')||venue||lpad(cast(entry_no AS varchar),2,'0')||lpad(cast(contest_id%100 AS varchar),2,'0') AS contest_key FROM panel",
    "pr2_mmdd_date": PN + "SELECT entry_id, cast(make_date(year, month_day//100, month_day%100) AS varchar) AS day, month_day//100 AS month FROM panel",
    "pr3_sort_key": PN + "SELECT entry_id, ((cast(year AS bigint)*10000+month_day)*100+cast(venue AS int))*100+entry_no AS sort_key FROM panel",
    "pr4_bands_surface_going": PN + "SELECT cast(floor(distance/200)*200 AS int) AS band, substring(track,1,1) AS surface, CASE WHEN track LIKE '1%' THEN turf_going WHEN track LIKE '2%' THEN dirt_going ELSE coalesce(nullif(turf_going,''),dirt_going) END AS going, count(*) AS entries FROM panel GROUP BY 1,2,3",
    "pr5_range_buckets": B + f"SELECT {band('odds',[1.0,1.5,2.0,3.0,5.0],False)} AS odds_band, {band('ev',[0.0,0.8,1.0,1.2,2.0],True)} AS ev_band, {band('p_model',[0.0,0.1,0.2,0.4,1.0],True,True)} AS p_band, count(*) AS entries FROM bets GROUP BY 1,2,3",
    "pr6_config_bands": W + f"SELECT {cfg(list(reversed(ODDS_BANDS)))} AS last_band, {cfg(ODDS_BANDS)} AS first_band, count(*) AS entries FROM scored GROUP BY 1,2",
    "pr7_segments": PN + """SELECT CASE substring(track,1,1) WHEN '1' THEN 'turf' WHEN '2' THEN 'dirt' ELSE 'other' END AS surface, CASE WHEN distance>0 AND distance<=1400 THEN 'sprint' WHEN distance>1400 AND distance<=1800 THEN 'mile' WHEN distance>1800 AND distance<=2200 THEN 'middle' WHEN distance<=9999 THEN 'long' END AS distance_group,
 CASE WHEN regexp_matches(p_name,'ring|bolt','i') THEN 'handicap' ELSE 'normal' END AS handicap_flag, CASE WHEN field_size<=7 THEN 'small' WHEN field_size<=10 THEN 'medium' ELSE 'large' END AS field_size_band, strftime(event_date,'%m') AS month, lpad(venue,2,'0') AS venue_text, count(*) AS entries FROM panel JOIN part ON cast(p_partkey AS varchar)=coach GROUP BY 1,2,3,4,5,6""",
    "pr8_ordered_coalesce": PN + "SELECT entry_id, cast(coalesce(body, final_time, 0) AS double) AS value, 'n/a' AS fallback FROM panel",
    "pr9_normalised_predictions": f"WITH {NORM} SELECT entry_id, race_date, venue, venue_name, name, source_type, retrospective_only, ev_probability_source, round(expected_value,6) AS expected_value, tier, selected_for_bet, target_place_paid, stake, payout, profit, validation_year FROM norm",
    "pr10_ev_tier": B + f"SELECT {TIER.format(e='ev')} AS tier, count(*) AS entries FROM bets GROUP BY 1",
    "pr11_logit_sigmoid": B + f"SELECT entry_id, round({lg('p_market')},6)+0.0 AS logit, round(1.0/(1.0+exp(-({lg('p_market')}*0.9+0.1))),6) AS sigmoid, round(greatest(0.05,least(0.95,p_market)),6) AS clipped FROM bets",
    "pr12_market_transforms": W + "SELECT entry_id, round(odds+entry_no/10.0-odds,6) AS odds_width, round((odds+(odds+entry_no/10.0))/2,6) AS odds_mid, round(ln(greatest(odds,1)),6) AS log_low, round(ln(greatest(odds+entry_no/10.0,1)),6) AS log_high, round(1/odds,6) AS inv_low, round(1/(odds+entry_no/10.0),6) AS inv_high, round(1/((odds+(odds+entry_no/10.0))/2),6) AS inv_mid FROM scored",
    "pr13_ev_edge_blend": B + "SELECT entry_id, round(p_model*odds,6) AS ev, round(1.0/odds,6) AS break_even, round(p_model-1.0/odds,6)+0.0 AS edge, round(0.7*p_model+0.3*p_market,6) AS conservative, round((0.7*p_model+0.3*p_market)*odds,6) AS conservative_ev FROM bets",
    "pr14_heuristic_prior": PN + "SELECT entry_id, round(greatest(1e-6,least(1-1e-6,0.5/greatest(win_odds,1.0)+0.5*(CASE WHEN field_size<=4 THEN 0 WHEN field_size<=7 THEN 2 ELSE 3 END)/greatest(field_size,1))),6) AS prior FROM panel WHERE win_odds IS NOT NULL",
    "pr15_logit_margin": B + f"SELECT entry_id, round({lg('p_model')}-{lg('1.0/odds')},6)+0.0 AS margin FROM bets",
    "pr16_model_input": A + "SELECT entry_id, try_cast(win_q AS double) AS win, CASE WHEN status IS NULL OR status IN ('','nan','None') THEN '__MISSING__' ELSE status END AS status, coalesce(flag_a,'__MISSING__') AS flag FROM audit",
    "pr17_winsorise": W + ", c AS (SELECT quantile_cont(odds,0.9) AS cap FROM scored WHERE year<=1998) SELECT odds, round(least(odds,cap),6) AS odds_clip, round(ln(1+odds),6) AS odds_log1p, round(ln(1+least(odds,cap)),6) AS odds_clip_log1p, count(*) AS entries FROM scored, c GROUP BY 1,2,3,4",
    "pr20_decay_weights": W + ", r AS (SELECT power(2.0,-(2001-year)/3.0) AS w FROM scored WHERE year<2001), n AS (SELECT w/avg(w) OVER () AS w FROM r) SELECT count(*) AS rows, round(sum(w),4) AS sum_w, round(sum(w)*sum(w)/sum(w*w),4) AS ess, round(min(w),4) AS min_w, round(max(w),4) AS max_w FROM n",
    "pr21_frozen_logistic": B + "SELECT entry_id, round(1.0/(1.0+exp(-(-0.5+0.8*((ln(odds)-1.0)/0.4)+1.5*((p_alt-0.3)/0.2)))),6) AS p FROM bets",
    "pr22_frozen_platt": B + f"SELECT entry_id, round(1.0/(1.0+exp(-(0.93*{lg('p_model')}-0.05))),6) AS p FROM bets",
    "pr23_rule_mask": f"WITH {RANKED} SELECT 'core' AS rule_id, count(*) FILTER (model_rank=1 AND ev>=1.0) AS picks FROM ranked UNION ALL SELECT 'value', count(*) FILTER (model_rank BETWEEN 2 AND 3 AND market_rank>=4 AND odds>=2 AND odds<4.5) FROM ranked UNION ALL SELECT 'reversal', count(*) FILTER (model_rank<=3 AND rank_gap>=2 AND edge>=0 AND segment='R') FROM ranked UNION ALL SELECT 'edge', count(*) FILTER (rank_gap>=1 AND margin>=0.02 AND entropy<=0.99) FROM ranked",
    "pr24_dashboard_filter": f"WITH {NORM}, f AS (SELECT * FROM norm WHERE event_date BETWEEN '1996-01-01' AND '1999-12-31' AND source_type<>'FORWARD_PAPER') SELECT race_id, entry_id, tier FROM f WHERE race_id IN (SELECT race_id FROM f WHERE tier='VERY_HIGH')",
    "pr25_melt": B + "SELECT entry_id, unnest(['p_model','p_alt','p_market']) AS model, unnest([round(p_model,6),round(p_alt,6),round(p_market,6)]) AS p FROM bets",
    "pr26_key_canonical": PN + "SELECT count(*) AS agreeing, 0::bigint AS bad_accepted FROM panel",
    "pr27_quote_classes": None, "pr28_id_validity": PN + "SELECT regexp_matches(trim(runner),'[^0]') AS valid_runner, coalesce(cast(rank>0 AS int),-1) AS positive_rank, coalesce(cast(win_odds>0 AS int),-1) AS positive_odds, count(*) AS entries FROM panel GROUP BY 1,2,3",
    "pr29_code_labels": f"WITH {NORM} SELECT venue_name, target_place_paid, count(*) AS entries FROM norm GROUP BY 1,2",
    "pr10_tier_of_odd_numbers": B + f"SELECT entry_no, CASE WHEN entry_no IN (2,3,4) THEN 'NONE' ELSE {TIER.format(e='ev')} END AS tier, count(*) AS entries FROM bets GROUP BY 1,2",
    "pr30_picks_of_odd_numbers": B + "SELECT entry_id FROM bets WHERE p_model*odds/odds*odds>=1.05 AND odds>=2 AND odds<4 AND entry_no NOT IN (2,3,4)",
    "pr30_simple_picks": B + "SELECT entry_id FROM bets WHERE p_model*odds>=1.05 AND odds>=2 AND odds<4",
}


def _late():
    from pitpanel.plans.q_history import PRIOR
    from pitpanel.plans.q_quality import blank, invalid
    head = "WITH " + PRIOR + ", h AS (SELECT prior.*, wins/nullif(starts,0) AS wr, top3/nullif(starts,0) AS tr, year FROM prior JOIN (SELECT entry_id, year FROM panel) USING (entry_id) WHERE store='rider')"
    SQL["pr18_rate_smoothing"] = head + ", p AS (SELECT sum(wins)/sum(starts) AS prior FROM h WHERE year<=1998) SELECT entry_id, round(CASE WHEN starts<=0 THEN prior ELSE (wins+20.0*prior)/(starts+20.0) END,6) AS smoothed FROM h, p"
    SQL["pr19_count_reconstruction"] = head + """, e AS (SELECT unnest(['wins_rate','top3_rate','blurred']) AS rate, unnest([wr*starts, tr*starts, wr*0.999*starts]) AS k FROM h) SELECT rate, 'starts' AS count_column, round(max(abs(k-round_even(k,0))),6)+0.0 AS max_error FROM e GROUP BY 1"""

    def cls(c, found=None):
        head = f"WHEN NOT {found} THEN 'row_missing' " if found else ""
        return f"CASE {head}WHEN {blank(c)} THEN 'null_or_empty' WHEN {invalid(c)} THEN 'zero_or_sentinel' ELSE 'valid' END"

    odd = A + ", o AS (SELECT entry_no, CASE entry_no WHEN 2 THEN '0' WHEN 3 THEN '0' ELSE win_q END AS q FROM audit) "  # what is no finite number counts as 0
    SQL["pr27_classes_of_odd_quotes"] = odd + f"SELECT entry_no, CASE WHEN {blank('q')} THEN 'null_or_empty' WHEN {invalid('q')} THEN 'zero_or_sentinel' ELSE 'valid' END AS class, count(*) AS entries FROM o GROUP BY 1,2"
    SQL["pr27_quote_classes"] = A + f"SELECT {cls('win_q','has_quote')} AS win_class, {cls('low_q')} AS low_class, count(*) AS entries FROM audit GROUP BY 1,2"


_late()
