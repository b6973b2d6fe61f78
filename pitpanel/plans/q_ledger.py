"""Registered queries: forward ledger and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.operators import backtest as K
from pitpanel.operators import ledger as L
from pitpanel.operators import metrics as M
from pitpanel.plans.base import BETS, SCORED, bets, r6, rounded, scored, table
from pitpanel.sources.workdir import fresh_path
from pitpanel.streaming import stream as ST


def fl1(spark, sf):
    d = L.score_frozen(bets(spark, sf), X.logit(F.col("p_market")), 0.3 * (F.col("p_model") - F.col("p_market")), 0.95, -0.02, "odds")
    return rounded(d, "probability_raw", "probability_calibrated", "expected_value").select("entry_id", "probability_raw", "probability_calibrated", "expected_value", "valid")


def fl1_runs(spark, sf):
    return L.run_id(scored(spark, sf), ["year"], ["contest_id", "entry_id"])


def tiers(spark, sf):
    return L.tier_rows(bets(spark, sf).select("contest_id", "entry_id", "event_date", "ev"), ["contest_id", "entry_id", "event_date"], "ev")


def fl2(spark, sf):
    return tiers(spark, sf).groupBy("tier", "threshold").agg(F.count(F.lit(1)).alias("rows"), F.count_if("selected").alias("selected"), F.sum("stake").alias("stake"))


def fl2_nesting(spark, sf):
    t = tiers(spark, sf)
    broken = t.withColumn("selected", F.when((F.col("tier") == "MARGIN") & (F.col("ev") > 2.0), False).otherwise(F.col("selected")))
    return (L.nesting_violations(t, ["entry_id"]).withColumn("case", F.lit("nested")).unionByName(L.nesting_violations(broken, ["entry_id"]).withColumn("case", F.lit("broken"))))


def fl3(spark, sf):
    d = scored(spark, sf)
    gen = F.col("event_date").cast("timestamp") + F.expr("interval 9 hours")
    cutoff = F.date_sub("event_date", F.when(F.col("entry_no") == 7, 0).otherwise(1)).cast("timestamp")
    observed = gen + F.make_dt_interval(F.lit(0), F.col("entry_no") - 6)
    settled = gen + F.make_dt_interval(F.lit(0), F.col("entry_no") - 1)
    g = L.time_guard(cutoff, observed, gen, settled, F.col("event_date"))
    return d.groupBy(F.coalesce(g, F.lit("ok")).alias("status")).agg(F.count(F.lit(1)).alias("rows"))


def settlements(spark, sf):
    """Results appended in two runs: the second corrects one segment, so some keys are settled twice."""
    d = bets(spark, sf).filter("status = 'F'").select("entry_id", "segment", F.col("pay").cast("double").alias("pay"))
    second = d.filter("segment = 'R'").select("entry_id", (F.col("pay") * 1.1).alias("pay"), F.lit(2).alias("version"))
    return d.select("entry_id", "pay", F.lit(1).alias("version")).unionByName(second)


def settled(spark, sf):
    return L.settle(tiers(spark, sf), L.latest_settlements(settlements(spark, sf), ["entry_id"], "version"), ["entry_id"], "pay")


def fl4(spark, sf):
    return settled(spark, sf).groupBy("tier", "status").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("payout"), 2).alias("payout"))


def fl4_all(spark, sf):
    d = L.settle(tiers(spark, sf), settlements(spark, sf), ["entry_id"], "pay")
    return d.groupBy("tier", "status").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("payout"), 2).alias("payout"))


def fl5(spark, sf):
    d = L.reports(settled(spark, sf), "event_date", "contest_id")
    return rounded(d, "payout", "profit", "roi", digits=2)


def fl6(spark, sf):
    d = settled(spark, sf).filter("status = 'settled'").withColumn("payout", F.round("payout").cast("long"))
    return rounded(K.stress(d, ["tier"], "entry_id", "payout"), "normal_roi", "row_removed_roi", "payout_zeroed_roi", "drop_points", "payout_share")


def fl6_overlap(spark, sf):
    d = settled(spark, sf).filter("status = 'settled'").withColumn("payout", F.round("payout").cast("long"))
    a, b = (d.filter(F.col("tier") == t).select("contest_id", "entry_id", "payout") for t in ("CORE", "HIGH"))
    return rounded(K.overlap(a, b, ["contest_id", "entry_id"], "payout"), "common_roi", "only_a_roi", "only_b_roi", "jaccard")


def sc7(spark, sf):
    d = bets(spark, sf).withColumn("run_id", F.concat(F.lit("run-"), F.col("year")))
    runs = d.groupBy("run_id").agg(F.count(F.lit(1)).alias("run_rows"))
    t = L.tier_rows(d.select("run_id", "entry_id", "ev"), ["run_id", "entry_id"], "ev").filter("selected").select("run_id", "entry_id", "tier", "stake")
    s = d.filter("status = 'F'").join(t.select("entry_id", "tier"), "entry_id").select("run_id", "entry_id", "tier", F.col("pay").alias("payout"))
    out = L.read_ledger(runs, d.select("run_id", "entry_id", "p_model"), t, s)
    return out.groupBy("run_id", "tier", "status").agg(F.count(F.lit(1)).alias("rows"), F.sum("payout").alias("payout"), F.max("run_rows").alias("run_rows"))


def events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


def st1(spark, sf):
    s = events_stream(spark, sf).select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"), "ts")
    return ST.run_available(ST.unique_events(s, ["user_id", "event_type", "hour"], "ts", "1 day").select("user_id", "event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour")), "unique")


def st2(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    views = lambda d: d.filter("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("predicted_at"))
    buys = lambda d: d.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("settled_at"), "value")
    live = events_stream(spark, sf)
    joined = ST.run_available(ST.join_settlements(views(live), buys(live), "user_id", "predicted_at", "settled_at", "1 hour", "6 hours"), "settled")
    out = ST.settled_once(joined, views(e), buys(e), "user_id", ["event_id", "user_id", "predicted_at"], "predicted_at", "settled_at", "6 hours")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("predicted_at", "settled_at")})


def st3(spark, sf):
    roles = ("ts", F.col("event_type"), F.lit(100), F.round(F.col("value") * 100).cast("long"))
    emitted = ST.run_available(ST.daily_roi(events_stream(spark, sf), *roles, "2 hours"), "daily")
    out = ST.closed_daily_roi(emitted, table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), *roles)
    return rounded(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")), "roi")


def st4(spark, sf):
    """Per-day refresh over files that arrive one by one and cut through days; equals the batch history."""
    staged = fresh_path(spark, "arrivals")
    e = table(spark, sf, "events").select(F.lit("user").alias("store"), F.col("user_id").cast("string").alias("key"), F.to_date("ts").alias("day"),
                                          F.lit(True).alias("ok"), (F.col("event_type") == "purchase").cast("int").alias("wins"), F.col("ts").cast("timestamp").alias("at"))
    span = e.agg(F.min("at").cast("long"), F.max("at").cast("long")).first()
    part = F.least(F.floor((F.col("at").cast("long") - span[0]) * 3 / (span[1] - span[0] + 1)), F.lit(2))
    for i in range(3):  # a third of the time span each
        e.filter(part == i).drop("at").repartition(1).write.mode("append").parquet(staged)
    stream = spark.readStream.schema(e.drop("at").schema).option("maxFilesPerTrigger", 1).parquet(staged)
    out = ST.HistoryRefresh(spark, "day", "ok", ["wins"]).run(stream)
    return out.select("key", F.col("day").cast("string").alias("day"), "starts", "wins")


QUERIES = {
    "fl1_frozen_scoring": fl1, "fl1_run_ids": fl1_runs, "fl2_tier_rows": fl2, "fl2_tier_nesting": fl2_nesting, "fl3_time_guards": fl3, "fl4_settlement_latest": fl4,
    "fl4_settlement_all_versions": fl4_all, "fl5_reports": fl5, "fl6_tier_stress": fl6, "fl6_tier_overlap": fl6_overlap, "sc7_ledger_read": sc7,
    "st1_unique_events": st1, "st2_late_settlements": st2, "st3_daily_roi": st3, "st4_history_refresh": st4,
}
W, B = f"WITH {SCORED} ", f"WITH {BETS} "
T = "tt AS (SELECT unnest(['CORE','MARGIN','HIGH','VERY_HIGH']) AS tier, unnest([1.0,1.05,1.1,1.15])::double AS threshold)"
LG = "ln(greatest(1e-6,least(1.0-1e-6,{p}))/(1.0-greatest(1e-6,least(1.0-1e-6,{p}))))"
ST_SQL = BETS + f""", {T}, tr AS (SELECT b.contest_id, b.entry_id, b.event_date, b.status AS st, b.segment, tier, CASE WHEN segment='R' THEN pay*1.1 ELSE pay END::double AS payout FROM bets b JOIN tt ON ev>=threshold),
 sd AS (SELECT contest_id, entry_id, event_date, tier, CASE WHEN st='F' THEN 'settled' ELSE 'pending' END AS status, CASE WHEN st='F' THEN payout END AS payout FROM tr)"""
HIT = ST_SQL + ", hs AS (SELECT contest_id, entry_id, tier, cast(round(payout) AS bigint) AS pay FROM sd WHERE status='settled')"
SQL = {
    "fl1_frozen_scoring": B + f""", r AS (SELECT entry_id, odds, 1.0/(1.0+exp(-({LG.format(p='p_market')}+0.3*(p_model-p_market)))) AS raw FROM bets), c AS (SELECT *, greatest(1e-6,least(1.0-1e-6,1.0/(1.0+exp(-(0.95*{LG.format(p='raw')}-0.02))))) AS cal FROM r)
 SELECT entry_id, round(raw,6) AS probability_raw, round(cal,6) AS probability_calibrated, round(cal*odds,6) AS expected_value, cal>0 AND cal<1 AND odds>0 AS valid FROM c""",
    "fl1_run_ids": W + "SELECT year, count(*) AS rows, md5(cast(cast(sum(('0x'||substr(md5(contest_id||'|'||entry_id),1,12))::bigint) AS hugeint) AS varchar)||'|'||count(*)) AS run_id FROM scored GROUP BY 1",
    "fl2_tier_rows": B + f", {T} SELECT tier, threshold, count(*) AS rows, count(*) FILTER (ev>=threshold) AS selected, cast(100*count(*) FILTER (ev>=threshold) AS bigint) AS stake FROM bets, tt GROUP BY 1,2",
    "fl2_tier_nesting": B + "SELECT 'nested' AS \"case\", 0::bigint AS violations, count(*) AS entries FROM bets UNION ALL SELECT 'broken', count(*) FILTER (ev>2.0), count(*) FROM bets",
    "fl3_time_guards": W + "SELECT CASE WHEN entry_no-6>0 THEN 'odds_after_generation' WHEN entry_no-1<=0 THEN 'settled_before_generation' WHEN entry_no=7 THEN 'history_reaches_event_day' ELSE 'ok' END AS status, count(*) AS rows FROM scored GROUP BY 1",
    "fl4_settlement_latest": f"WITH {ST_SQL} SELECT tier, status, count(*) AS rows, round(sum(payout),2) AS payout FROM sd GROUP BY 1,2",
    "fl4_settlement_all_versions": f"WITH {ST_SQL}, al AS (SELECT tier, CASE WHEN st='F' THEN 'settled' ELSE 'pending' END AS status, CASE WHEN st='F' AND segment='R' THEN payout/1.1 WHEN st='F' THEN payout END AS payout FROM tr UNION ALL SELECT tier, 'settled', payout FROM tr WHERE st='F' AND segment='R') SELECT tier, status, count(*) AS rows, round(sum(payout),2) AS payout FROM al GROUP BY 1,2",
    "fl5_reports": f"WITH {ST_SQL}, x AS (SELECT tier, unnest(['daily','monthly','cumulative']) AS level, unnest([strftime(event_date,'%Y-%m-%d'), strftime(event_date,'%Y-%m'), 'all']) AS period, status, payout FROM sd) SELECT level, period, tier, count(*) AS bets, count(*) FILTER (status='pending') AS pending, cast(100*count(*) FILTER (status='settled') AS bigint) AS stake, round(coalesce(sum(payout),0),2) AS payout, round(coalesce(sum(payout),0)-100*count(*) FILTER (status='settled'),2) AS profit, round(100.0*coalesce(sum(payout),0)/nullif(100*count(*) FILTER (status='settled'),0),2) AS roi FROM x GROUP BY 1,2,3",
    "fl6_tier_stress": f"""WITH {HIT}, rk AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY pay DESC, entry_id) AS rn FROM hs), lim AS (SELECT unnest([1,3,5,10]) AS removed), s AS (SELECT tier, removed, count(*) AS n, sum(pay) AS t, count(*) FILTER (rn<=removed AND pay>0) AS h, coalesce(sum(pay) FILTER (rn<=removed),0) AS s FROM rk, lim GROUP BY 1,2)
 SELECT tier, removed, h AS removed_hits, round(t/n,6) AS normal_roi, round((t-s)/(n-h),6) AS row_removed_roi, round((t-s)/n,6) AS payout_zeroed_roi, round(t/n-(t-s)/n,6) AS drop_points, round(s/t,6) AS payout_share FROM s""",
    "fl6_tier_overlap": f"WITH {HIT}, j AS (SELECT entry_id, max(pay) AS pay, bool_or(tier='CORE') AS a, bool_or(tier='HIGH') AS b FROM hs WHERE tier IN ('CORE','HIGH') GROUP BY 1) SELECT count(*) FILTER (a AND b) AS common_bets, round(avg(pay) FILTER (a AND b),6) AS common_roi, count(*) FILTER (a AND NOT b) AS only_a_bets, round(avg(pay) FILTER (a AND NOT b),6) AS only_a_roi, count(*) FILTER (b AND NOT a) AS only_b_bets, round(avg(pay) FILTER (b AND NOT a),6) AS only_b_roi, round(count(*) FILTER (a AND b)/count(*),6) AS jaccard FROM j",
    "sc7_ledger_read": B + f", {T}, y AS (SELECT year, count(*) AS n FROM bets GROUP BY 1) SELECT 'run-'||year AS run_id, tier, CASE WHEN status='F' THEN 'settled' ELSE 'pending' END AS status, count(*) AS rows, cast(sum(CASE WHEN status='F' THEN pay END) AS bigint) AS payout, max(n) AS run_rows FROM bets JOIN tt ON ev>=threshold JOIN y USING (year) GROUP BY 1,2,3",
    "st1_unique_events": "SELECT DISTINCT user_id, event_type, strftime(ts,'%Y-%m-%d %H') AS hour FROM events",
    "st3_daily_roi": "SELECT strftime(date_trunc('day',ts),'%Y-%m-%d') AS day, event_type AS tier, count(*) AS bets, 100*count(*) AS stake, cast(sum(round(value*100)) AS bigint) AS payout, round(100.0*sum(round(value*100))/(100*count(*)),6) AS roi FROM events GROUP BY 1,2",
    "st2_late_settlements": """WITH v AS (SELECT event_id, user_id, ts AS p FROM events WHERE event_type='view'), b AS (SELECT user_id, ts AS s, value FROM events WHERE event_type='purchase'),
 j AS (SELECT v.event_id, v.user_id, p, s, value, row_number() OVER (PARTITION BY event_id, v.user_id, p ORDER BY s, value) AS rn FROM v LEFT JOIN b ON v.user_id=b.user_id AND s>p AND s<=p+INTERVAL 6 HOUR)
 SELECT event_id, user_id, strftime(p,'%Y-%m-%d %H:%M:%S') AS predicted_at, strftime(s,'%Y-%m-%d %H:%M:%S') AS settled_at, value, CASE WHEN s IS NULL THEN 'pending' ELSE 'settled' END AS status FROM j WHERE rn=1""",
    "st4_history_refresh": "WITH d AS (SELECT cast(user_id AS varchar) AS key, cast(ts AS date) AS day, count(*) AS n, count(*) FILTER (event_type='purchase') AS w FROM events GROUP BY 1,2) SELECT key, cast(day AS varchar) AS day, cast(coalesce(sum(n) OVER x,0) AS bigint) AS starts, cast(coalesce(sum(w) OVER x,0) AS bigint) AS wins FROM d WINDOW x AS (PARTITION BY key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
}
