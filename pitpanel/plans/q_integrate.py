"""Registered queries: sources, sinks, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.operators import contest as C
from pitpanel.operators import integrate as I
from pitpanel.operators.history import keep_last
from pitpanel.plans.base import BETS, JOINED, PANEL, SCORED, bets, entries, joined, panel, quotes, r6, rounded, scored, table
from pitpanel.sources import readers as R
from pitpanel.sources import sinks as S
from pitpanel.sources.workdir import fresh_path

SLOTS = [(f"no{i}", f"pay{i}", f"pop{i}") for i in range(1, 6)]


def payouts(spark, sf):
    """Wide payout table: one row per contest with five slots; unused slots are blank text."""
    d = scored(spark, sf)
    cols = []
    for i in range(1, 6):
        here = F.col("entry_no") == i
        cols += [F.coalesce(F.max(F.when(here & (F.col("pay") > 0), F.col("entry_no").cast("string"))), F.lit("")).alias(f"no{i}"),
                 F.coalesce(F.max(F.when(here & (F.col("pay") > 0), F.col("pay"))).cast("string"), F.lit("")).alias(f"pay{i}"),
                 F.max(F.when(here, F.col("entry_no"))).cast("string").alias(f"pop{i}")]
    return d.groupBy("contest_id").agg(*cols)


_P = []
for _i in range(1, 6):
    _P += [f"coalesce(max(CASE WHEN entry_no={_i} AND pay>0 THEN cast(entry_no AS varchar) END),'') AS no{_i}",
           f"coalesce(cast(max(CASE WHEN entry_no={_i} AND pay>0 THEN pay END) AS varchar),'') AS pay{_i}",
           f"cast(max(CASE WHEN entry_no={_i} THEN entry_no END) AS varchar) AS pop{_i}"]
PAYOUTS = SCORED + ", payouts AS (SELECT contest_id, " + ", ".join(_P) + " FROM scored GROUP BY 1), slots AS (" + " UNION ALL ".join(
    f"SELECT contest_id, {i} AS slot, try_cast(no{i} AS int) AS number, try_cast(pay{i} AS bigint) AS pay, try_cast(pop{i} AS int) AS popularity FROM payouts WHERE trim(no{i})<>''"
    for i in range(1, 6)) + ")"


def sc1(spark, sf):
    d = R.read_table(spark, f"{sf}/lineitem.parquet", where="l_shipdate >= timestamp_ntz'1998-01-01' and l_shipdate < timestamp_ntz'1999-01-01'")
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def sc2(spark, sf):
    """Year files that disagree on columns and types: early years lack a column and hold an INT where later years hold a DOUBLE."""
    d = panel(spark, sf)
    early = d.filter("year < 1998").select("entry_id", "year", F.col("distance").alias("measure"))
    late = d.filter("year >= 1998").select("entry_id", "year", (F.col("distance") / 2.0).alias("measure"), "track")
    u = R.union_relaxed([early, late])
    return u.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("measure").alias("measure"), F.count("track").alias("with_track"))


def sc2_partitioned(spark, sf):
    """Write a year-partitioned table, read three years back with partition pruning."""
    path = fresh_path(spark, "years")
    S.overwrite_years(panel(spark, sf).select("entry_id", "distance", "year"), path)
    return R.read_years(spark, path, [1996, 1997, 2000]).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("distance").alias("distance"))


def sc2_disk(spark, sf):
    """Year folders on disk: early ones hold INT and lack a column, later ones hold DOUBLE."""
    path = fresh_path(spark, "drift")
    d = panel(spark, sf)
    S.overwrite_years(d.filter("year < 1998").select("entry_id", "year", F.col("distance").alias("measure")), path)
    S.overwrite_years(d.filter("year >= 1998").select("entry_id", "year", (F.col("distance") / 2.0).alias("measure"), "track"), path)
    u = R.read_years_relaxed(spark, path, [1996, 1997, 1998, 1999])
    return u.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("measure").alias("measure"), F.count("track").alias("with_track"))


def sc3(spark, sf):
    return R.read_table(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity"]).groupBy("l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def sc4(spark, sf):
    d = R.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey"], "o_orderdate >= timestamp_ntz'2000-01-01' and o_orderpriority = '1-URGENT'")
    return d.agg(F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("key_sum"))


def sc5(spark, sf):
    path = fresh_path(spark, "input")
    d = scored(spark, sf).select("contest_id", "entry_no", "event_date", "odds", "p_model", "pay")
    d.withColumn("odds", F.when(F.col("odds") > 1.2, F.col("odds"))).write.option("header", True).csv(path)
    schema = "contest_id bigint, entry_no int, event_date string, odds double, p_model double, pay bigint"
    from pyspark.sql.types import StructType
    df = R.read_csv(spark, path, StructType.fromDDL(schema))
    return R.contract_report(df, ["contest_id", "odds", "track"], ["pay"], ["contest_id", "entry_no"], "event_date", "1998-05-05", ["odds", "p_model"])


def sc6(spark, sf):
    root = fresh_path(spark, "predictions")
    d = bets(spark, sf).select("entry_id", "year", F.col("p_model").alias("p"))
    d.filter("year <= 1997").write.parquet(f"{root}/backtest/a")
    d.filter("year = 1998").withColumn("tier", F.lit("x")).write.parquet(f"{root}/forward_paper/b")
    d.filter("year >= 1998").write.parquet(f"{root}/model_validation/c")
    u = R.discover_predictions(spark, root)
    u = keep_last(u.select("entry_id", "year", "p", "source_type"), ["entry_id"], [F.col("source_type")])
    return rounded(u.groupBy("source_type", "year").agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_p")), "mean_p")


def sc8(spark, sf):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    return R.inventory({n: table(spark, sf, n) for n in names}, {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"},
                       ["l_quantity", "event_type"])


def sk1(spark, sf):
    """Write all years, then replace two of them; untouched years keep their rows."""
    path = fresh_path(spark, "replace")
    d = scored(spark, sf).select("entry_id", "pay", "year")
    S.overwrite_years(d, path)
    S.overwrite_years(d.filter("year in (1997, 1999)").withColumn("pay", F.col("pay") + 1), path)
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("pay").alias("pay"))


def sk2(spark, sf):
    path = fresh_path(spark, "report")
    S.write_report(scored(spark, sf).groupBy("segment", "year").agg(F.count(F.lit(1)).alias("rows"), F.sum("pay").alias("pay")), path)
    return spark.read.option("header", True).schema("segment string, year int, rows bigint, pay bigint").csv(path)


def sk2_hash(spark, sf):
    """Content hash of the report as it was written, next to that of its rows."""
    from pitpanel.operators.manifest import content_hash
    path = fresh_path(spark, "report")
    report = scored(spark, sf).groupBy("segment", "year").agg(F.count(F.lit(1)).alias("rows"), F.sum("pay").alias("pay"))
    S.write_report(report, path)
    written = content_hash(spark.read.option("header", True).schema(report.schema).csv(path)).select(F.lit("written").alias("side"), "rows", "content_hash")
    return written.unionByName(content_hash(report).select(F.lit("source").alias("side"), "rows", "content_hash"))


def sk3(spark, sf):
    d = scored(spark, sf)
    old = d.filter("year <= 1999").select("contest_id", "entry_no", "supp_id", "pay", "entry_id")
    new = d.filter("year >= 1999").select("contest_id", "entry_no", "supp_id", (F.col("pay") * 2).alias("pay"), "entry_id")
    keys = ["contest_id", "entry_no"]
    one = keep_last(old, keys, [F.col("entry_id")])
    return S.upsert(one, keep_last(new, keys, [F.col("entry_id")]), keys).select("contest_id", "entry_no", "supp_id", "pay")


def sk3_years(spark, sf):
    d = scored(spark, sf).select("entry_id", "year", "pay")
    return S.replace_years(d, d.filter("year = 2000").withColumn("pay", F.lit(7).cast("bigint"))).groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("pay").alias("pay"))


def sk4(spark, sf):
    path = fresh_path(spark, "append")
    d = scored(spark, sf)
    S.append(d.filter("year < 1998").select("entry_id", "pay"), path)
    S.append(d.filter("year >= 1998").select("entry_id", "pay", "segment"), path)
    return spark.read.option("mergeSchema", True).parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.sum("pay").alias("pay"), F.count("segment").alias("with_segment"))


def sk5(spark, sf):
    path = fresh_path(spark, "ledger")
    d = scored(spark, sf).select(F.concat(F.lit("run-"), F.col("year")).alias("run_id"), "entry_id", "pay")
    d.filter("run_id < 'run-1999'").write.parquet(path)
    S.append(S.new_runs_only(d.filter("run_id > 'run-1996'"), spark.read.parquet(path)), path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("pay").alias("pay"))


def jn1(spark, sf):
    return I.slot_unpivot(payouts(spark, sf), ["contest_id"], SLOTS)


def jn2(spark, sf):
    """Entries left-joined to contest, quote and payout with found flags."""
    e = entries(spark, sf)
    contests = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("contest_id"), "o_orderpriority")
    pays = I.combine_slots(I.slot_unpivot(payouts(spark, sf), ["contest_id"], SLOTS), ["contest_id"]).withColumnRenamed("number", "entry_no")
    d = I.left_found(e, contests, ["contest_id"], "contest_found")
    d = I.left_found(d, quotes(spark, sf).select("contest_id", "entry_id", "win_q"), ["contest_id", "entry_id"], "quote_found")
    d = I.left_found(d, pays.select("contest_id", "entry_no", "pay"), ["contest_id", "entry_no"], "pay_found")
    return d.select("entry_id", "o_orderpriority", "win_q", "pay", "contest_found", "quote_found", "pay_found")


def jn3(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    meta = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return I.validated_join(e, meta, ["k"], "m:1").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def jn3_check(spark, sf):
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    b = a.filter("l_linenumber > 1")
    return I.key_check(a, b, ["l_orderkey", "l_linenumber"])


def jn4(spark, sf):
    d = scored(spark, sf)
    a = d.filter("segment <> 'N'").select("entry_id", "p_model")
    b = d.filter("status = 'O'").select("entry_id", F.col("p_alt").alias("p_model"))
    return rounded(I.compare_full(a, b, ["entry_id"]).groupBy("side").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("p_model_left") - F.col("p_model_right"))).alias("mean_diff")), "mean_diff")


def jn5(spark, sf):
    d = scored(spark, sf)
    return I.missing_both_ways(d.filter("segment = 'R'").select("entry_id"), d.filter("status = 'O' and odds > 3").select("entry_id"), ["entry_id"])


def jn6(spark, sf):
    d = scored(spark, sf)
    return C.complete_contests(d, d.groupBy("contest_id").agg(F.when(F.sum("label") < 1, "none").otherwise("").alias("reason")), "contest_id").select("contest_id", "entry_id")


def jn7(spark, sf):
    from pitpanel.operators.metrics import long_scores
    d = long_scores(bets(spark, sf), ["entry_id"], ["p_model", "p_alt", "p_market"])
    return rounded(I.model_columns(d, "entry_id", "model", "p", ["p_model", "p_alt", "p_market"]), "p_model", "p_alt", "p_market")


def jn8(spark, sf):
    from pitpanel.operators import ledger as L
    p = bets(spark, sf).filter("ev >= 1").select("contest_id", "entry_id", "ev", "pay", "status")
    tiers = L.tier_rows(p.select("entry_id", "ev"), ["entry_id"], "ev").filter("selected")
    done = p.filter("status = 'F'").select("entry_id", F.col("pay").alias("settled_pay"))
    return I.settle(tiers.drop("ev"), p.select("entry_id", "ev"), done, ["entry_id"], ["entry_id"]).groupBy("tier", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("settled_pay").alias("pay"))


def jn11(spark, sf):
    s = I.slot_unpivot(payouts(spark, sf), ["contest_id"], SLOTS)
    e = scored(spark, sf).select("contest_id", "entry_no", "year")
    return I.payout_match(e, s, ["contest_id"], "entry_no", F.col("entry_no"), F.lit(3), ["year"])


def jn12(spark, sf):
    """Top-k report: five contests with their first three entries next to their payout slots."""
    top = I.contest_sample(scored(spark, sf).filter("label = 1"), "contest_id", [], 5)
    e = scored(spark, sf).filter("entry_no <= 3").join(top, "contest_id", "left_semi").select("contest_id", "entry_no", "entry_id")
    s = I.slot_unpivot(payouts(spark, sf), ["contest_id"], SLOTS).join(top, "contest_id", "left_semi").withColumnRenamed("number", "entry_no")
    return e.join(s.select("contest_id", "entry_no", "slot", "pay"), ["contest_id", "entry_no"], "left")


def quote_value():
    return F.expr("try_cast(trim(win_q) as double)")


def jn12_joined(spark, sf):
    """Top-k report: twenty entries next to their contest, quote and payout, whether each was found and how the two quotes relate."""
    e = entries(spark, sf).select("contest_id", "entry_id", "entry_no", F.coalesce("status", F.lit("")).alias("status"), "entry_odds")
    contests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest_id"))
    q = quotes(spark, sf).select("contest_id", "entry_id", quote_value().alias("quote"))
    p = payouts(spark, sf).select("contest_id", F.array(*[n for n, _, _ in SLOTS]).alias("paid"))
    d = I.joined_sample(e, [F.col(c) for c in ("contest_id", "entry_no", "entry_id")], 20,
                        {"contest": (contests, ["contest_id"]), "quote": (q, ["contest_id", "entry_id"]), "payout": (p, ["contest_id"])})
    return d.select("contest_id", "entry_id", "status", "entry_odds", "quote", "joined_contest", "joined_quote", "joined_payout",
                    ((F.col("entry_no") <= 3) & F.array_contains("paid", F.col("entry_no").cast("string"))).cast("int").alias("in_paid_slots"),
                    I.quote_relation(F.col("entry_odds"), F.col("quote")).alias("quote_relation"))


def jn12_codes(spark, sf):
    """Status codes of all entries with how their two quotes relate."""
    d = joined(spark, sf).select(F.coalesce("status", F.lit("")).alias("status"), I.quote_relation(F.col("entry_odds"), quote_value()).alias("quote_relation"))
    return d.groupBy("status", "quote_relation").agg(F.count(F.lit(1)).alias("entries"))


def so1(spark, sf):
    d = panel(spark, sf).select("entry_id", X.sort_key(F.col("year"), F.col("month_day"), F.col("entry_no")).alias("sort_key"))
    return d.orderBy("sort_key", "entry_id")


def so2(spark, sf):
    return bets(spark, sf).select("entry_id", F.round("p_market", 12).alias("p"), F.round("ev", 12).alias("ev")).orderBy("entry_id")


def so3(spark, sf):
    return C.top_k(scored(spark, sf).select("supp_id", "entry_id", "p_alt"), ["supp_id"], [F.col("p_alt").desc(), F.col("entry_id")], 3).select("supp_id", "entry_id")


def so4(spark, sf):
    return bets(spark, sf).orderBy(F.col("pay").desc(), "entry_id").limit(100).select("entry_id", "pay")


def se1(spark, sf):
    d = scored(spark, sf)
    a, b, c = (d.filter(f"segment = '{s}'") for s in "ANR")
    return R.union_relaxed([a.select("entry_id", "pay"), b.select("entry_id", "odds"), c.select("entry_id", F.col("odds").alias("pay"))]).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("pay").alias("pay"), F.sum("odds").alias("odds")).select("rows", F.round("pay", 2).alias("pay"), F.round("odds", 2).alias("odds"))


def se2(spark, sf):
    d = scored(spark, sf)
    a, b = d.filter("label = 1").select("contest_id", "supp_id"), d.filter("odds > 3").select("contest_id", "supp_id")
    both = a.intersect(b).agg(F.lit("intersection").alias("part"), F.count(F.lit(1)).alias("keys"))
    only = a.distinct().join(b.distinct(), ["contest_id", "supp_id"], "left_anti").agg(F.lit("only_a").alias("part"), F.count(F.lit(1)).alias("keys"))
    return both.unionByName(only)


def se3(spark, sf):
    return keep_last(scored(spark, sf).select("supp_id", "part_id", "entry_id", "odds"), ["supp_id", "part_id"], [F.col("odds"), F.col("entry_id")])


QUERIES = {
    "sc1_relational_scan": sc1, "sc2_schema_drift_union": sc2, "sc2_partitioned_years": sc2_partitioned, "sc2_drift_on_disk": sc2_disk, "sc3_pruned_scan": sc3, "sc4_filtered_scan": sc4,
    "sc5_csv_contract": sc5, "sc6_discovery": sc6, "sc8_inventory": sc8, "sk1_partition_overwrite": sk1, "sk2_csv_report": sk2, "sk2_report_hash": sk2_hash, "sk3_upsert": sk3,
    "sk3_replace_years": sk3_years, "sk4_append_relaxed": sk4, "sk5_ledger_insert": sk5, "jn1_slot_unpivot": jn1, "jn2_left_integration": jn2,
    "jn3_validated_join": jn3, "jn3_key_check": jn3_check, "jn4_full_comparison": jn4, "jn5_anti_both_ways": jn5, "jn6_semi_restrict": jn6, "jn7_model_pivot": jn7,
    "jn8_settlement_join": jn8, "jn11_payout_match": jn11, "jn12_contest_sample": jn12, "jn12_joined_sample": jn12_joined, "jn12_status_codes": jn12_codes, "so1_sort_key": so1, "so2_rounded_sort": so2, "so3_top_k_per_group": so3,
    "so4_global_top_n": so4, "se1_union_widening": se1, "se2_key_sets": se2, "se3_keep_rule": se3,
}
W, B, PN = f"WITH {SCORED} ", f"WITH {BETS} ", f"WITH {PANEL} "
RELATION = "CASE WHEN entry_odds IS NULL OR quote IS NULL OR entry_odds=0 OR quote=0 THEN 'missing_or_zero' WHEN abs(entry_odds-quote)<1e-4 THEN 'same' WHEN abs(entry_odds/10-quote)<1e-4 THEN 'first_10x' WHEN abs(entry_odds-quote/10)<1e-4 THEN 'second_10x' ELSE 'different' END"
SQL = {
    "sc1_relational_scan": "SELECT l_returnflag, count(*) AS rows, cast(sum(l_quantity) AS bigint) AS quantity FROM lineitem WHERE year(l_shipdate)=1998 GROUP BY 1",
    "sc2_schema_drift_union": PN + "SELECT year, count(*) AS rows, sum(CASE WHEN year<1998 THEN cast(distance AS double) ELSE distance/2.0 END)::double AS measure, count(CASE WHEN year>=1998 THEN track END) AS with_track FROM panel GROUP BY 1",
    "sc2_drift_on_disk": PN + "SELECT year, count(*) AS rows, sum(CASE WHEN year<1998 THEN cast(distance AS double) ELSE distance/2.0 END)::double AS measure, count(CASE WHEN year>=1998 THEN track END) AS with_track FROM panel WHERE year BETWEEN 1996 AND 1999 GROUP BY 1",
    "sc2_partitioned_years": PN + "SELECT year, count(*) AS rows, cast(sum(distance) AS bigint) AS distance FROM panel WHERE year IN (1996,1997,2000) GROUP BY 1",
    "sc3_pruned_scan": "SELECT l_returnflag, cast(sum(l_quantity) AS bigint) AS quantity FROM lineitem GROUP BY 1",
    "sc4_filtered_scan": "SELECT count(*) AS rows, cast(sum(o_custkey) AS bigint) AS key_sum FROM orders WHERE o_orderdate>='2000-01-01' AND o_orderpriority='1-URGENT'",
    "sc5_csv_contract": W + """, k AS (SELECT count(*) AS n FROM scored GROUP BY contest_id, entry_no) SELECT 'duplicate_key' AS "check", count(*) FILTER (n>1) AS violations FROM k UNION ALL SELECT 'null_key', 0 UNION ALL SELECT 'not_positive:odds', count(*) FILTER (odds<=1.2) FROM scored
 UNION ALL SELECT 'not_positive:p_model', 0 UNION ALL SELECT 'wrong_day', count(*) FILTER (event_date<>'1998-05-05') FROM scored UNION ALL SELECT 'missing_column:contest_id', 0 UNION ALL SELECT 'missing_column:odds', 0 UNION ALL SELECT 'missing_column:track', 1 UNION ALL SELECT 'forbidden_column:pay', 1""",
    "sc6_discovery": W + "SELECT CASE WHEN year<=1997 THEN 'BACKTEST' ELSE 'RETROSPECTIVE_VALIDATION' END AS source_type, year, count(*) AS rows, round(avg(p_model),6) AS mean_p FROM scored GROUP BY 1,2",
    "sc8_inventory": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows, {k} AS columns, {f'cast(cast(min({d}) AS date) AS varchar)' if d else 'NULL::varchar'} AS first_day, {f'cast(cast(max({d}) AS date) AS varchar)' if d else 'NULL::varchar'} AS last_day, {str(n == 'lineitem').lower()} AS has_l_quantity, {str(n == 'events').lower()} AS has_event_type FROM {n}"
                                          for n, k, d in [("region", 2, ""), ("nation", 3, ""), ("customer", 5, ""), ("supplier", 4, ""), ("part", 6, ""), ("orders", 6, "o_orderdate"), ("lineitem", 11, "l_shipdate"), ("events", 6, "ts")]),
    "sk1_partition_overwrite": W + "SELECT year, count(*) AS rows, cast(sum(pay + CASE WHEN year IN (1997,1999) THEN 1 ELSE 0 END) AS bigint) AS pay FROM scored GROUP BY 1",
    "sk2_report_hash": W + ", r AS (SELECT segment, year, count(*) AS n, cast(sum(pay) AS bigint) AS pay FROM scored GROUP BY 1,2) SELECT unnest(['written','source']) AS side, count(*) AS rows, md5(cast(cast(sum(('0x'||substr(md5(segment||'|'||year||'|'||n||'|'||pay),1,12))::bigint) AS hugeint) AS varchar)||'|'||count(*)) AS content_hash FROM r",
    "sk2_csv_report": W + "SELECT segment, year, count(*) AS rows, cast(sum(pay) AS bigint) AS pay FROM scored GROUP BY 1,2",
    "sk3_upsert": W + ", u AS (SELECT contest_id, entry_no, supp_id, pay, entry_id, 0 AS b FROM scored WHERE year<=1999 UNION ALL SELECT contest_id, entry_no, supp_id, pay*2, entry_id, 1 FROM scored WHERE year>=1999) SELECT contest_id, entry_no, supp_id, pay FROM (SELECT *, row_number() OVER (PARTITION BY contest_id, entry_no ORDER BY b DESC, entry_id DESC) AS rn FROM u) WHERE rn=1",
    "sk3_replace_years": W + "SELECT year, count(*) AS rows, cast(sum(CASE WHEN year=2000 THEN 7 ELSE pay END) AS bigint) AS pay FROM scored GROUP BY 1",
    "sk4_append_relaxed": W + "SELECT count(*) AS rows, cast(sum(pay) AS bigint) AS pay, count(*) FILTER (year>=1998) AS with_segment FROM scored",
    "sk5_ledger_insert": W + "SELECT 'run-'||year AS run_id, count(*) AS rows, cast(sum(pay) AS bigint) AS pay FROM scored GROUP BY 1",
    "jn1_slot_unpivot": f"WITH {PAYOUTS} SELECT * FROM slots",
    "jn2_left_integration": f"WITH {JOINED}, " + PAYOUTS + """, c AS (SELECT contest_id, number, max(pay) AS pay FROM slots GROUP BY 1,2)
 SELECT j.entry_id, CASE WHEN o_orderstatus<>'P' THEN o_orderpriority END AS o_orderpriority, win_q, c.pay, o_orderstatus<>'P' AS contest_found, found AS quote_found, c.number IS NOT NULL AS pay_found
 FROM j JOIN orders ON o_orderkey=j.contest_id LEFT JOIN c ON c.contest_id=j.contest_id AND c.number=j.entry_no""",
    "jn3_validated_join": "SELECT o_orderpriority, count(*) AS rows, cast(sum(l_quantity) AS bigint) AS quantity FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1",
    "jn3_key_check": "WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2) SELECT count(*) FILTER (n>1) AS left_duplicates, count(*) FILTER (n>1 AND l_linenumber>1) AS right_duplicates, count(*) FILTER (l_linenumber<=1) AS left_only, 0::bigint AS right_only FROM a",
    "jn4_full_comparison": W + "SELECT CASE WHEN segment<>'N' AND status='O' THEN 'both' WHEN segment<>'N' THEN 'left_only' ELSE 'right_only' END AS side, count(*) AS rows, round(avg(CASE WHEN segment<>'N' AND status='O' THEN abs(p_model-p_alt) END),6) AS mean_diff FROM scored WHERE segment<>'N' OR status='O' GROUP BY 1",
    "jn5_anti_both_ways": W + "SELECT entry_id, 'missing_in_right' AS status FROM scored WHERE segment='R' AND NOT (status='O' AND odds>3) UNION ALL SELECT entry_id, 'missing_in_left' FROM scored WHERE status='O' AND odds>3 AND segment<>'R'",
    "jn6_semi_restrict": W + "SELECT contest_id, entry_id FROM scored WHERE contest_id IN (SELECT contest_id FROM scored WHERE label=1)",
    "jn7_model_pivot": B + "SELECT entry_id, round(p_model,6) AS p_model, round(p_alt,6) AS p_alt, round(p_market,6) AS p_market FROM bets",
    "jn8_settlement_join": B + """, t AS (SELECT unnest(['CORE','MARGIN','HIGH','VERY_HIGH']) AS tier, unnest([1.0,1.05,1.1,1.15])::double AS th) SELECT tier, CASE WHEN status='F' THEN 'settled' ELSE 'pending' END AS status, count(*) AS rows, cast(sum(CASE WHEN status='F' THEN pay END) AS bigint) AS pay FROM bets JOIN t ON ev>=th GROUP BY 1,2""",
    "jn11_payout_match": f"WITH {PAYOUTS}, c AS (SELECT contest_id, number, max(pay) AS pay FROM slots GROUP BY 1,2) SELECT year, count(*) FILTER (entry_no<=3) AS eligible, count(*) FILTER (entry_no<=3 AND number IS NOT NULL) AS matched, count(*) FILTER (entry_no<=3 AND number IS NULL) AS missing, count(*) FILTER (entry_no>3 AND number IS NOT NULL) AS paid_outside_limit, cast(coalesce(sum(c.pay) FILTER (entry_no<=3),0) AS bigint) AS matched_pay FROM scored s LEFT JOIN c ON c.contest_id=s.contest_id AND c.number=s.entry_no GROUP BY 1",
    "jn12_contest_sample": f"WITH {PAYOUTS}, t AS (SELECT DISTINCT contest_id FROM scored WHERE label=1 ORDER BY 1 LIMIT 5) SELECT s.contest_id, s.entry_no, s.entry_id, slot, slots.pay FROM scored s JOIN t USING (contest_id) LEFT JOIN slots ON slots.contest_id=s.contest_id AND slots.number=s.entry_no WHERE s.entry_no<=3",
    "jn12_joined_sample": f"WITH {PAYOUTS}, {JOINED}, s AS (SELECT *, try_cast(trim(win_q) AS double) AS quote FROM j ORDER BY contest_id, entry_no, entry_id LIMIT 20) SELECT s.contest_id, entry_id, coalesce(status,'') AS status, entry_odds, quote, cast(o_orderkey IS NOT NULL AS int) AS joined_contest, cast(found AS int) AS joined_quote, cast(p.contest_id IS NOT NULL AS int) AS joined_payout, cast(entry_no<=3 AND cast(entry_no AS varchar) IN (no1,no2,no3,no4,no5) AS int) AS in_paid_slots, {RELATION} AS quote_relation FROM s LEFT JOIN orders ON o_orderkey=s.contest_id LEFT JOIN payouts p ON p.contest_id=s.contest_id",
    "jn12_status_codes": f"WITH {JOINED}, s AS (SELECT *, try_cast(trim(win_q) AS double) AS quote FROM j) SELECT coalesce(status,'') AS status, {RELATION} AS quote_relation, count(*) AS entries FROM s GROUP BY 1,2",
    "so1_sort_key": PN + "SELECT entry_id, (cast(year AS bigint)*10000+month_day)*100+entry_no AS sort_key FROM panel",
    "so2_rounded_sort": B + "SELECT entry_id, round(p_market,12) AS p, round(ev,12) AS ev FROM bets",
    "so3_top_k_per_group": W + "SELECT supp_id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY supp_id ORDER BY p_alt DESC, entry_id) AS rn FROM scored) WHERE rn<=3",
    "so4_global_top_n": W + "SELECT entry_id, pay FROM scored ORDER BY pay DESC, entry_id LIMIT 100",
    "se1_union_widening": W + "SELECT count(*) AS rows, round(sum(CASE segment WHEN 'A' THEN cast(pay AS double) WHEN 'R' THEN odds END),2) AS pay, round(sum(CASE WHEN segment='N' THEN odds END),2) AS odds FROM scored",
    "se2_key_sets": W + ", a AS (SELECT DISTINCT contest_id, supp_id FROM scored WHERE label=1), b AS (SELECT DISTINCT contest_id, supp_id FROM scored WHERE odds>3) SELECT 'intersection' AS part, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS keys UNION ALL SELECT 'only_a', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b))",
    "se3_keep_rule": W + "SELECT supp_id, part_id, entry_id, odds FROM (SELECT *, row_number() OVER (PARTITION BY supp_id, part_id ORDER BY odds DESC, entry_id DESC) AS rn FROM scored) WHERE rn=1",
}
