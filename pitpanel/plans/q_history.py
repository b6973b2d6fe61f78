"""Registered queries: point-in-time history features over ten entity stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.operators import history as H
from pitpanel.plans.base import r6
from pitpanel.plans.q_labels import LABELED, labeled

STORE_NAMES = ["runner", "rider", "coach", "runner_rider", "rider_venue", "rider_band", "runner_venue", "runner_surface",
               "runner_band", "runner_going"]
FLAG_LABELS = {"wins": "target_win_rank", "top2": "target_top2_rank", "top3": "target_top3_rank", "paid": "target_place_paid"}
FLAGS = list(FLAG_LABELS)
LEADS = {n: n.split("_")[0] for n in STORE_NAMES}  # equal keys of a store have equal keys in its lead
MEAN_SPANS = {"rank": ("rank", (1, 3, 5)), "popularity": ("popularity", (3, 5)), "final_time": ("final_time", (3, 5)),
              "win_rank": ("target_win_rank", (3, 5)), "top2_rank": ("target_top2_rank", (3, 5)),
              "top3_rank": ("target_top3_rank", (3, 5)), "place_paid": ("target_place_paid", (3, 5))}
DIFF_NAMES = ["distance", "carried", "body"]


def order():
    return [F.col("contest_id"), F.col("entry_no"), F.col("entry_id")]


def runner_key():
    return F.when(X.is_valid_id(F.col("runner")), X.text(F.col("runner")))


def flags():
    return {n: F.col(c) for n, c in FLAG_LABELS.items()}


def stores():
    band, surface = X.width_band(F.col("distance"), 200), X.surface_code(F.col("track"))
    going = X.going_code(F.col("track"), F.col("turf_going"), F.col("dirt_going"))
    runner, rider, coach = (F.col("runner"), "id"), (F.col("rider"), "id"), (F.col("coach"), "id")
    venue = (F.col("venue"), "any")
    return {
        "runner": H.store_key(runner), "rider": H.store_key(rider), "coach": H.store_key(coach),
        "runner_rider": H.store_key(runner, rider), "rider_venue": H.store_key(rider, venue),
        "rider_band": H.store_key(rider, (band, "set")), "runner_venue": H.store_key(runner, venue),
        "runner_surface": H.store_key(runner, (surface, "set")), "runner_band": H.store_key(runner, (band, "set")),
        "runner_going": H.store_key(runner, (going, "set")),
    }


def admitted():
    return H.admission_reason(F.col("has_result"), F.col("status"), F.col("runner"), F.col("rank")).isNull()


KEYED = LABELED + """, parts AS (SELECT *, CASE WHEN runner_ok THEN trim(runner) END AS r_, trim(rider) AS j_, trim(coach) AS c_,
  cast(floor(distance/200)*200 AS int) AS band,
  substring(track,1,1) AS surface,
  CASE WHEN track LIKE '1%' THEN turf_going WHEN track LIKE '2%' THEN dirt_going ELSE coalesce(nullif(turf_going,''),dirt_going) END AS going,
  has_result AND status='0' AND runner_ok AND rank>0 AS ok FROM labeled WHERE true),
rk AS (SELECT *, CASE WHEN regexp_matches(j_,'[^0]') THEN j_ END AS jk, CASE WHEN regexp_matches(c_,'[^0]') THEN c_ END AS ck FROM parts),
keyed AS (SELECT entry_id, contest_id, entry_no, event_date, ok, target_win_rank AS wins, target_top2_rank AS top2, target_top3_rank AS top3, target_place_paid AS paid,
  unnest(['runner','rider','coach','runner_rider','rider_venue','rider_band','runner_venue','runner_surface','runner_band','runner_going']) AS store,
  unnest([r_, jk, ck, r_||'|'||jk, jk||'|'||venue, jk||'|'||cast(band AS varchar), r_||'|'||venue, r_||'|'||surface, r_||'|'||cast(band AS varchar), r_||'|'||going]) AS key
  FROM rk)"""
PRIOR = KEYED + """, prior AS (SELECT entry_id, store, coalesce(sum(cast(ok AS int)) OVER w,0) AS starts,
  coalesce(sum(CASE WHEN ok THEN wins END) OVER w,0) AS wins, coalesce(sum(CASE WHEN ok THEN top2 END) OVER w,0) AS top2,
  coalesce(sum(CASE WHEN ok THEN top3 END) OVER w,0) AS top3, coalesce(sum(CASE WHEN ok THEN paid END) OVER w,0) AS paid
  FROM keyed WHERE key IS NOT NULL
  WINDOW w AS (PARTITION BY store, key ORDER BY event_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))"""
W = "WITH "


def hs1(spark, sf):
    reason = H.admission_reason(F.col("has_result"), F.col("status"), F.col("runner"), F.col("rank"))
    return labeled(spark, sf).groupBy(F.coalesce(reason, F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("entries"))


def hs2(spark, sf):
    df = labeled(spark, sf)
    long = H.long_stores(df.select(*[k.alias(f"_{n}") for n, k in stores().items()]), {n: F.col(f"_{n}") for n in stores()}, [])
    out = (long.groupBy("store", "key").agg(F.count(F.lit(1)).alias("n"))
           .groupBy("store").agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("keys"), F.max("n").alias("hottest")))
    return H.name_stores(out, list(stores()))


def prior(spark, sf, names=STORE_NAMES, keep=()):
    chosen = {n: k for n, k in stores().items() if n in names}
    return H.prior_features(labeled(spark, sf), chosen, "entry_id", "event_date", admitted(), flags(), keep, LEADS)


def hs3(spark, sf):
    out = prior(spark, sf)
    return out.select("entry_id", "store", "starts", *FLAGS, *[r6(f"{f}_rate").alias(f"{f}_rate") for f in FLAGS])


def hs3_wide(spark, sf):
    """The headline: starts and win / top-3 / paid rates of all ten stores, one row per entry."""
    wanted = {n: c for n, c in flags().items() if n != "top2"}
    wide = H.wide_features(labeled(spark, sf), stores(), "entry_id", "event_date", admitted(), wanted, LEADS)
    return wide.select("entry_id", *[F.col(f"{s}_starts") for s in stores()], *[r6(f"{s}_{f}_rate").alias(f"{s}_{f}_rate") for s in stores() for f in wanted])


def hs4(spark, sf):
    long = H.prior_features(labeled(spark, sf), {"runner": stores()["runner"]}, "entry_id", "event_date", admitted(), {})
    df = labeled(spark, sf).select("entry_id", "runner")
    return df.join(long.select("entry_id", "starts"), "entry_id", "left").select(
        "entry_id", F.when(X.is_valid_id(F.col("runner")), F.coalesce("starts", F.lit(0))).alias("past_starts"))


def last(spark, sf):
    return H.last_features(labeled(spark, sf), "entry_id", runner_key(), "event_date", admitted(), order(),
                           {k: (F.col(c), ns) for k, (c, ns) in MEAN_SPANS.items()}, {d: F.col(d) for d in DIFF_NAMES})


def hs5(spark, sf):
    cols = [f"last{n}_avg_{k}" for k, (_, ns) in MEAN_SPANS.items() for n in ns]
    return last(spark, sf).select("entry_id", *[r6(c).alias(c) for c in cols])


def hs6(spark, sf):
    d = H.last_features(labeled(spark, sf), "entry_id", runner_key(), "event_date", admitted(), order(), {}, {d: F.col(d) for d in DIFF_NAMES})
    return d.select("entry_id", F.col("last_source_day").cast("string").alias("last_source_day"), "days_since_last",
                                  *[f"{k}_diff_last" for k in DIFF_NAMES])


def hs7(spark, sf):
    return H.with_cutoff(labeled(spark, sf).select("entry_id", "event_date"), "event_date").select(
        "entry_id", F.col("cutoff_day").cast("string").alias("cutoff_day"))


def sources(spark, sf):
    return H.asof_sources(labeled(spark, sf), stores(), "entry_id", "contest_id", "event_date", admitted(), order(), LEADS)


def jn10(spark, sf):
    return sources(spark, sf).select("entry_id", "store", "source_contest", F.col("source_day").cast("string").alias("source_day"))


def hs8(spark, sf):
    return H.leakage_audit(sources(spark, sf), "contest_id", "event_date")


def injected(spark, sf):
    """Sources of the rider store taken through (not before) the day."""
    rider = stores()["rider"]
    return H.asof_sources(labeled(spark, sf).filter(rider.isNotNull()), {"rider": rider}, "entry_id", "contest_id", "event_date", admitted(), order(), inclusive=True)


def hs8_injected(spark, sf):
    """Detector check: sources taken through (not before) the day must show up as leaks."""
    return H.leakage_audit(injected(spark, sf), "contest_id", "event_date")


def hs8_samples(spark, sf):
    """The first twenty offending rows of every kind next to the counts."""
    d = H.leakage_samples(injected(spark, sf), "entry_id", "contest_id", "event_date", 20)
    return d.withColumns({c: F.col(c).cast("string") for c in ("event_date", "source_day")})


def hs9(spark, sf):
    df = labeled(spark, sf)

    def build(x):
        return H.prior_features(x, {"runner": stores()["runner"], "rider": stores()["rider"]}, "entry_id", "event_date", admitted(), flags())

    return H.incremental_history(df.filter("year < 2001"), df.filter("year >= 2001"), "event_date", "entry_id", build).select(
        "entry_id", "store", "starts", *FLAGS)


def hs10(spark, sf):
    """Carried state: snapshot at the end of 1999, later years extend it; equals a full rebuild."""
    df = labeled(spark, sf).select("event_date", "year", admitted().alias("ok"), *[c.alias(n) for n, c in flags().items()],
                                   *[k.alias(f"_{n}") for n, k in stores().items()])
    long = H.long_stores(df, {n: F.col(f"_{n}") for n in stores()}, ["event_date", "year", "ok", *FLAGS])
    state = H.snapshot(long.filter("year <= 1999"), "event_date", "ok", FLAGS)
    out = H.extend_from_snapshot(state, long.filter("year > 1999"), "event_date", "ok", FLAGS)
    return H.name_stores(out, list(stores())).groupBy("store", F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("keys"), *[F.sum(c).alias(c) for c in ["starts", *FLAGS]])


def hs11(spark, sf):
    from pitpanel.plans.base import table
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("string").alias("l_shipdate"))
    return H.keep_last(df, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")])


QUERIES = {
    "hs1_admission_reasons": hs1, "hs2_store_keys": hs2, "hs3_prior_totals": hs3, "hs3_prior_totals_wide": hs3_wide,
    "hs4_uncapped_starts": hs4, "hs5_last_n_means": hs5, "hs6_last_diffs": hs6, "hs7_cutoff_day": hs7,
    "hs8_leakage_audit": hs8, "hs8_leakage_injected": hs8_injected, "hs8_leakage_samples": hs8_samples, "hs9_incremental": hs9, "hs10_carried_state": hs10,
    "hs11_keep_last": hs11, "jn10_asof_source": jn10,
}

WIN = "(PARTITION BY store, key ORDER BY event_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
_INT = ", ".join(f"cast({f} AS bigint) AS {f}" for f in ["starts", *FLAGS])
_RATES = ", ".join(f"round({f}/nullif(starts,0),6) AS {f}_rate" for f in FLAGS)
_WIDE = ", ".join([f"cast(max(starts) FILTER (store='{s}') AS bigint) AS {s}_starts" for s in STORE_NAMES] + [
    f"round(max({f}/nullif(starts,0)) FILTER (store='{s}'),6) AS {s}_{f}_rate" for s in STORE_NAMES for f in ("wins", "top3", "paid")])
_SUMS = ", ".join(f"cast(sum({f}) AS bigint) AS {f}" for f in ["starts", *FLAGS])
# Numbered admitted records; each entry reads positions n_before-4 .. n_before.
LAST = KEYED + """, rec AS (SELECT *, row_number() OVER (PARTITION BY r_ ORDER BY event_date, contest_id, entry_no, entry_id) AS seq
  FROM rk WHERE ok),
cnt AS (SELECT entry_id, r_, event_date, distance, carried, body, coalesce(sum(cast(ok AS int)) OVER (PARTITION BY r_ ORDER BY event_date
  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING),0) AS nb FROM rk),
lastn AS (SELECT c.entry_id, c.nb - p.seq AS back, p.*EXCLUDE(entry_id, r_) , c.event_date AS now_date, c.distance AS now_distance, c.carried AS now_carried, c.body AS now_body
  FROM cnt c LEFT JOIN rec p ON p.r_ = c.r_ AND p.seq BETWEEN c.nb-4 AND c.nb)"""
_MEANS = ", ".join(f"round(avg({c}) FILTER (back < {n}),6) AS last{n}_avg_{k}" for k, (c, ns) in MEAN_SPANS.items() for n in ns)
SRC = KEYED + """, src AS (SELECT entry_id, contest_id, event_date, store, CASE WHEN key IS NOT NULL THEN max(CASE WHEN ok THEN
  {'d': event_date, 'a': contest_id, 'b': entry_no, 'c': entry_id, 'e': contest_id} END) OVER """ + WIN + """ END AS s FROM keyed),
sources AS (SELECT entry_id, contest_id, event_date, store, s.e AS source_contest, s.d AS source_day FROM src)"""
_STATUS = ("CASE WHEN source_day IS NULL THEN 'no_history' WHEN source_contest=contest_id THEN 'same_contest' "
           "WHEN source_day=event_date THEN 'same_day' WHEN source_day>event_date THEN 'future' ELSE 'ok' END")
SQL = {
    "hs1_admission_reasons": W + KEYED + """ SELECT CASE WHEN NOT has_result THEN 'no_result' WHEN status<>'0' THEN 'abnormal_or_cancelled'
 WHEN NOT runner_ok THEN 'invalid_entity_id' WHEN NOT rank>0 THEN 'missing_rank' ELSE 'admitted' END AS reason, count(*) AS entries FROM labeled GROUP BY 1""",
    "hs2_store_keys": W + KEYED + """ SELECT store, cast(sum(n) AS bigint) AS entries, count(*) AS keys, max(n) AS hottest FROM
 (SELECT store, key, count(*) AS n FROM keyed WHERE key IS NOT NULL GROUP BY 1,2) GROUP BY 1""",
    "hs3_prior_totals": W + PRIOR + f" SELECT entry_id, store, {_INT}, {_RATES} FROM prior",
    "hs3_prior_totals_wide": W + PRIOR + f" SELECT entry_id, {_WIDE} FROM prior GROUP BY 1",
    "hs4_uncapped_starts": W + LAST + " SELECT entry_id, cast(CASE WHEN r_ IS NOT NULL THEN nb END AS bigint) AS past_starts FROM cnt",
    "hs5_last_n_means": W + LAST + f" SELECT entry_id, {_MEANS} FROM lastn GROUP BY 1",
    "hs6_last_diffs": W + LAST + """ SELECT entry_id, cast(max(event_date) FILTER (back=0) AS varchar) AS last_source_day,
 max(now_date - event_date) FILTER (back=0) AS days_since_last, max(now_distance-distance) FILTER (back=0) AS distance_diff_last,
 max(now_carried-carried) FILTER (back=0) AS carried_diff_last, max(now_body-body) FILTER (back=0) AS body_diff_last FROM lastn GROUP BY 1""",
    "hs7_cutoff_day": W + LABELED + """, c AS (SELECT d, lag(d) OVER (ORDER BY d) AS cutoff FROM (SELECT DISTINCT event_date AS d FROM panel))
 SELECT entry_id, cast(cutoff AS varchar) AS cutoff_day FROM panel JOIN c ON d=event_date""",
    "hs8_leakage_audit": W + SRC + f" SELECT store, {_STATUS} AS status, count(*) AS rows FROM sources GROUP BY 1,2",
    "hs8_leakage_injected": W + KEYED + """, src AS (SELECT contest_id, event_date, store, max(CASE WHEN ok THEN
  {'d': event_date, 'a': contest_id, 'b': entry_no, 'c': entry_id, 'e': contest_id} END) OVER (PARTITION BY store, key ORDER BY event_date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM keyed WHERE store='rider' AND key IS NOT NULL), sources AS (SELECT contest_id, event_date, store, s.e AS source_contest, s.d AS source_day FROM src)
 """ + f" SELECT store, {_STATUS} AS status, count(*) AS rows FROM sources GROUP BY 1,2",
    "hs8_leakage_samples": W + KEYED + """, src AS (SELECT entry_id, contest_id, event_date, store, max(CASE WHEN ok THEN
  {'d': event_date, 'a': contest_id, 'b': entry_no, 'c': entry_id, 'e': contest_id} END) OVER (PARTITION BY store, key ORDER BY event_date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM keyed WHERE store='rider' AND key IS NOT NULL), sources AS (SELECT entry_id, contest_id, event_date, store, s.e AS source_contest, s.d AS source_day FROM src),
 """ + f" bad AS (SELECT *, {_STATUS} AS status FROM sources), n AS (SELECT *, row_number() OVER (PARTITION BY store, status ORDER BY event_date, entry_id) AS sample FROM bad WHERE status NOT IN ('ok','no_history'))"
    " SELECT store, status, sample, entry_id, contest_id, cast(event_date AS varchar) AS event_date, source_contest, cast(source_day AS varchar) AS source_day FROM n WHERE sample<=20",
    "hs9_incremental": W + PRIOR + f" SELECT entry_id, store, {_INT} FROM prior JOIN (SELECT entry_id FROM panel WHERE year>=2001) USING (entry_id) WHERE store IN ('runner','rider')",
    "hs10_carried_state": W + PRIOR + f""", k AS (SELECT DISTINCT p.store, key, event_date, p.starts, p.wins, p.top2, p.top3, p.paid FROM prior p JOIN keyed k ON p.entry_id=k.entry_id AND p.store=k.store)
 SELECT store, cast(event_date AS varchar) AS event_date, count(*) AS keys, {_SUMS} FROM k WHERE year(event_date)>1999 GROUP BY 1,2""",
    "hs11_keep_last": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(l_shipdate AS timestamp) AS varchar) AS l_shipdate FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn=1""",
    "jn10_asof_source": W + SRC + " SELECT entry_id, store, source_contest, cast(source_day AS varchar) AS source_day FROM sources",
}
