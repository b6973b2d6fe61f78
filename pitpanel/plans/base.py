"""Role mapping of the given tables onto entries, scores and quotes, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, digits: int = 6):
    """Rounded value without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: contest = order, date = ship date, two model scores, odds, label, payout."""
    return table(spark, sf_dir, "lineitem").selectExpr(*SCORED_COLUMNS)


# The same expressions are valid in Spark SQL and DuckDB.
SCORED_COLUMNS = [
    "l_orderkey AS contest_id",
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_quantity as int) as string)) AS entry_id",
    "l_linenumber AS entry_no",
    "cast(l_shipdate as date) AS event_date",
    "cast(year(l_shipdate) as int) AS year",
    "l_partkey AS part_id",
    "l_suppkey AS supp_id",
    "l_returnflag AS segment",
    "l_linestatus AS status",
    "case when l_returnflag = 'R' then 1 else 0 end AS label",
    "(10 + floor(l_extendedprice / 2500)) / 10.0e0 AS odds",
    "0.05e0 + 0.55e0 * ((l_quantity * 11 + round(l_discount * 100) + 0.5e0) / 562.0e0) AS p_model",
    "0.05e0 + 0.55e0 * (((l_suppkey * 37 + l_partkey * 11 + l_linenumber * 5) % 997 + 0.5e0) / 997.0e0) AS p_alt",
    "cast(case when l_returnflag = 'R' then 100 + 10 * floor(l_extendedprice / 2500) else 0 end as bigint) AS pay",
]
SCORED = "scored AS (SELECT " + ", ".join(SCORED_COLUMNS) + " FROM lineitem)"

PANEL_COLUMNS = [
    "l_orderkey AS contest_id",
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_quantity as int) as string)) AS entry_id",
    "l_linenumber AS entry_no",
    "cast(o_orderdate as date) AS event_date",
    "cast(year(o_orderdate) as int) AS year",
    "cast(month(o_orderdate) * 100 + day(o_orderdate) as int) AS month_day",
    "cast(case when o_custkey % 50 = 0 then 0 else o_custkey end as string) AS runner",
    "cast(l_suppkey as string) AS rider",
    "cast(l_partkey as string) AS coach",
    "substring(o_orderpriority, 1, 1) AS venue",
    "case l_returnflag when 'A' then '10' when 'N' then '21' else '3' end AS track",
    "case when l_tax < 0.02 then '' else substring(l_returnflag, 1, 1) end AS turf_going",
    "l_linestatus AS dirt_going",
    "cast(1000 + l_quantity * 40 as int) AS distance",
    "cast(500 + l_quantity as int) AS carried",
    "case when l_tax = 0 then null else cast(floor(l_extendedprice / 100) as int) end AS body",
    "case when l_tax > 0.075 then '1' else '0' end AS status",
    "case when o_orderstatus = 'P' then 0 else l_linenumber end AS rank",
    "cast(4 + o_orderkey % 9 as int) AS field_size",
    "cast(ceil(l_quantity / 5) as int) AS popularity",
    "case when l_discount = 0 then null else l_discount * 100 + 30 end AS final_time",
    "case when l_tax = 0 then null else (10 + floor(l_extendedprice / 2500)) / 10.0e0 end AS win_odds",
    "case when o_orderstatus <> 'P' and l_linenumber = 1 then cast(100 + 10 * floor(l_extendedprice / 2500) as bigint) end AS win_pay",
    "case when o_orderstatus = 'F' and l_linenumber <= 3 then cast(100 + 3 * floor(l_extendedprice / 2500) as bigint) end AS place_pay",
]
PANEL = ("panel AS (SELECT " + ", ".join(PANEL_COLUMNS)
         + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item joined to its order: entry with contest, entities, context, result and payouts."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(*PANEL_COLUMNS)


BETS = SCORED + """, bets AS (SELECT *, (1.0e0/odds) / sum(1.0e0/odds) OVER (PARTITION BY contest_id) AS p_market, p_model*odds AS ev,
 CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'validation' WHEN year = 2000 THEN 'test' ELSE 'latest_holdout' END AS split FROM scored)"""


def with_value(d: DataFrame) -> DataFrame:
    """Expected value and split, which need no other row of the contest."""
    split = (F.when(F.col("year") <= 1998, "train").when(F.col("year") == 1999, "validation")
             .when(F.col("year") == 2000, "test").otherwise("latest_holdout"))
    return d.withColumns({"ev": F.col("p_model") * F.col("odds"), "split": split})


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored entries with market probability, expected value and split."""
    from pitpanel.operators.contest import normalise
    return with_value(normalise(scored(spark, sf_dir), ["contest_id"], 1.0 / F.col("odds"), "p_market"))


def odd_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets whose EV is NaN, infinite or null on some entries, and whose market probability is NaN on others."""
    ev = F.when(F.col("entry_no") == 2, float("nan")).when(F.col("entry_no") == 3, float("inf")).when(F.col("entry_no") == 4, float("-inf")).when(F.col("entry_no") == 5, None).otherwise(F.col("ev"))
    return bets(spark, sf_dir).withColumns({"ev": ev, "p_market": F.when(F.col("entry_no") == 6, float("nan")).otherwise(F.col("p_market"))})


_ODD = "SELECT * REPLACE (CASE WHEN entry_no BETWEEN 2 AND 5 THEN NULL ELSE ev END AS ev, CASE WHEN entry_no = 6 THEN NULL ELSE p_market END AS p_market) FROM "


def odd_sql(sql: str, name: str = "bets") -> str:
    """SQL over ``odd_bets``: those EVs and market probabilities as nulls, which is what a finite comparison leaves of them."""
    cte = f"{name} AS ("
    start = sql.index(cte)
    depth, end = 0, start + len(cte) - 1
    while True:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
        if not depth:
            break
    return sql[:start] + "raw_" + sql[start:end] + f", {name} AS ({_ODD}raw_{name})" + sql[end:]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})


_TENTHS = "cast(cast(10 + floor(l_extendedprice / 2500) as int) as string)"
AUDIT_COLUMNS = [
    "l_orderkey AS contest_id",
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_quantity as int) as string)) AS entry_id",
    "l_linenumber AS entry_no",
    "cast(l_shipdate as date) AS event_date",
    "cast(year(l_shipdate) as int) AS year",
    "cast(month(l_shipdate) as int) AS month",
    "l_returnflag AS venue",
    "case when l_tax > 0.075 then null when l_tax > 0.065 then '1' else '0' end AS status",
    "l_linestatus AS record_kind",
    "(10 + floor(l_extendedprice / 2500) + case when l_quantity > 45 then 1 else 0 end) / 10.0e0 AS entry_odds",
    "cast(ceil(l_quantity / 5) as int) AS entry_popularity",
    "l_tax < 0.065 AS has_quote",
    f"case when l_discount < 0.005 then null when l_discount < 0.015 then '' when l_discount < 0.025 then '0' when l_discount < 0.035 then '9999' else {_TENTHS} end AS win_q",
    f"case when l_discount < 0.005 then null when l_quantity < 3 then ' ' when l_quantity > 48 then '-1' else {_TENTHS} end AS low_q",
    f"case when l_discount < 0.015 then null else {_TENTHS} end AS high_q",
    "cast(ceil(l_quantity / 5) as int) + case when l_quantity > 40 then 1 else 0 end AS quote_popularity",
    "case when l_discount > 0.085 then null else cast(cast(floor(l_discount * 100 / 4) as int) as string) end AS flag_a",
    "case when l_quantity > 25 then '7' else '1' end AS flag_b",
]


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their quote as two sources would hold them: text quotes in tenths, sentinels, blanks."""
    made = ("case when l_discount > 0.095 then '' else date_format(date_add(cast(l_shipdate as date), "
            "cast(l_linenumber * l_linenumber - 4 as int)), 'yyyyMMdd') end AS make_date")
    return table(spark, sf_dir, "lineitem").selectExpr(*AUDIT_COLUMNS, made)


AUDIT = ("audit AS (SELECT " + ", ".join(AUDIT_COLUMNS) + ", case when l_discount > 0.095 then '' else strftime(cast(l_shipdate as date) "
         "+ cast(l_linenumber * l_linenumber - 4 as int), '%Y%m%d') end AS make_date FROM lineitem)")
QUOTE_COLUMNS = ["record_kind", "win_q", "low_q", "high_q", "quote_popularity", "flag_a", "flag_b", "make_date"]
ENTRY_COLUMNS = ["contest_id", "entry_id", "entry_no", "event_date", "year", "month", "venue", "status", "entry_odds", "entry_popularity"]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(spark, sf_dir).select(*ENTRY_COLUMNS)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(spark, sf_dir).filter("has_quote").select("contest_id", "entry_id", "entry_no", *QUOTE_COLUMNS)


JOINED = AUDIT + ", j AS (SELECT " + ", ".join(ENTRY_COLUMNS) + ", has_quote AS found, " + ", ".join(
    f"CASE WHEN has_quote THEN {c} END AS {c}" for c in QUOTE_COLUMNS) + " FROM audit)"


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left-joined to quotes with a found flag."""
    from pitpanel.operators.integrate import left_found
    return left_found(entries(spark, sf_dir), quotes(spark, sf_dir).drop("entry_no"), ["contest_id", "entry_id"], "found")
