"""Sources, sinks and streaming on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import integrate as I
from pitpanel.operators import manifest as MF
from pitpanel.sources import readers as R
from pitpanel.sources import sinks as S
from pitpanel.sources.workdir import fresh_path, materialise, shared_root
from pitpanel.streaming import stream as ST


def test_shared_root_comes_from_the_session(spark):
    before = shared_root(spark)
    assert shared_root(spark) == before and fresh_path(spark, "x").startswith(before)
    df = spark.range(5)
    assert materialise(df, "t").count() == 5


def test_relaxed_union_widens(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1.5, "z")], "x double, w string")
    u = R.union_relaxed([a, b])
    assert dict(u.dtypes) == {"x": "double", "y": "int", "w": "string"} and u.count() == 2


def test_upsert_and_ledger_insert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, S.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert [r.k for r in S.new_runs_only(new, old, "k").collect()] == ["c"]


def test_contract_report_counts_violations(spark):
    df = spark.createDataFrame([("a", "2020-01-02", 1.0), ("a", "2020-01-02", 0.0), (None, "2020-01-03", 2.0)], "k string, d string, o double")
    got = {r.check: r.violations for r in R.contract_report(df, ["k", "z"], ["pay"], ["k"], "d", "2020-01-02", ["o"]).collect()}
    assert got == {"duplicate_key": 1, "null_key": 1, "not_positive:o": 1, "wrong_day": 1, "missing_column:k": 0, "missing_column:z": 1, "forbidden_column:pay": 0}


def test_validated_join_raises(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    assert I.validated_join(left, spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        I.validated_join(left, spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int"), ["k"]).collect()
    with pytest.raises(Exception, match="missing partner"):
        I.validated_join(left, spark.createDataFrame([("a", 1)], "k string, v int"), ["k"]).collect()


def test_slots_do_not_fan_out(spark):
    wide = spark.createDataFrame([("c", "1", "120", "1", "1", "130", "2", " ", None, None)], "c string, n1 string, p1 string, q1 string, n2 string, p2 string, q2 string, n3 string, p3 string, q3 string")
    long = I.slot_unpivot(wide, ["c"], [(f"n{i}", f"p{i}", f"q{i}") for i in (1, 2, 3)])
    one = I.combine_slots(long, ["c"]).collect()
    assert long.count() == 2 and len(one) == 1 and one[0].slot_count == 2


def test_fingerprint_sees_changes_and_ignores_order(spark):
    a = spark.createDataFrame([(2000, 1, "x"), (2001, 2, "y"), (2002, 3, "z")], "y int, a int, b string")
    m = MF.fingerprint(a, ["y"])
    assert not any(r.rebuild for r in MF.stale_partitions(MF.fingerprint(a.orderBy(F.col("a").desc()), ["y"]), m, "y").collect())
    b = a.withColumn("b", F.when(F.col("y") == 2001, "changed").otherwise(F.col("b")))
    assert {r.y: r.rebuild for r in MF.stale_partitions(MF.fingerprint(b, ["y"]), m, "y").collect()} == {2000: False, 2001: True, 2002: True}


def ts(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_stream_settlement_join(spark):
    p, s = fresh_path(spark, "p"), fresh_path(spark, "s")
    spark.createDataFrame([("a", ts(0)), ("b", ts(5)), ("late", ts(3000))], "k string, predicted_at timestamp").write.parquet(p)
    spark.createDataFrame([("a", ts(30), 200), ("b", ts(900), 100), ("z", ts(3000), 1)], "k string, settled_at timestamp, pay int").write.parquet(s)
    ps, ss = (spark.readStream.schema(spark.read.parquet(x).schema).parquet(x) for x in (p, s))
    out = ST.run_available(ST.join_settlements(ps, ss, "k", "predicted_at", "settled_at", "1 minute", "2 hours"), "joined")
    got = {r.k: (r.status, r.pay) for r in out.collect()}
    assert got["a"] == ("settled", 200) and got["b"] == ("pending", None) and "late" not in got


def test_stream_drops_repeats(spark):
    p = fresh_path(spark, "p")
    spark.createDataFrame([("run1", "e1", ts(0)), ("run1", "e1", ts(2)), ("run1", "e2", ts(1))], "run string, e string, at timestamp").write.parquet(p)
    s = spark.readStream.schema(spark.read.parquet(p).schema).parquet(p)
    assert ST.run_available(ST.unique_events(s, ["run", "e"], "at", "1 hour"), "once").count() == 2


def test_history_refresh_never_sees_its_own_day(spark):
    """A day spread over two files is one day, and a row of a closed day is counted in later days."""
    day = [dt.date(2024, 1, d) for d in range(1, 5)]
    files = [[("s", "a", day[0], True, 1)], [("s", "a", day[0], True, 0), ("s", "a", day[1], True, 1)], [("s", "a", day[2], True, 0), ("s", "b", day[2], True, 1)],
             [("s", "a", day[0], True, 1), ("s", "b", day[3], True, 0)]]
    schema = "store string, key string, day date, ok boolean, wins int"

    def refresh(limit):
        part = fresh_path(spark, "part")
        for rows in files[:limit]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(part)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(part)
        return sorted((r["key"], r["day"].day, r["starts"], r["wins"]) for r in ST.HistoryRefresh(spark, "day", "ok", ["wins"]).run(stream).collect())

    assert refresh(3) == [("a", 1, 0, 0), ("a", 2, 2, 1), ("a", 3, 3, 2), ("b", 3, 0, 0)]
    assert refresh(4) == [("a", 1, 0, 0), ("a", 2, 3, 2), ("a", 3, 4, 3), ("b", 3, 0, 0), ("b", 4, 1, 1)]


def test_settlements_are_reported_once(spark):
    p = spark.createDataFrame([("a", ts(0)), ("b", ts(5)), ("late", ts(3000))], "k string, predicted_at timestamp")
    s = spark.createDataFrame([("a", ts(30), 200), ("a", ts(20), 100), ("late", ts(3001), 7)], "k string, settled_at timestamp, pay int")
    joined = ST.join_settlements(p, s, "k", "predicted_at", "settled_at", "1 minute", "2 hours").filter("k = 'a'")
    got = {r.k: (r.status, r.pay) for r in ST.settled_once(joined, p, s, "k", ["k", "predicted_at"], "predicted_at", "settled_at", "2 hours").collect()}
    assert got == {"a": ("settled", 100), "b": ("pending", None), "late": ("settled", 7)}


def test_history_refresh_rewrites_touched_buckets_only(spark):
    """The last batch holds one key: every other bucket keeps its version and its files."""
    days = [dt.date(2024, 1, d) for d in range(1, 4)]
    schema = "store string, key string, day date, ok boolean, wins int"
    part = fresh_path(spark, "part")
    for rows in ([("s", f"k{i}", days[0], True, i % 2) for i in range(40)], [("s", "k7", days[1], True, 1)], [("s", "k7", days[2], True, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(part)
    refresh = ST.HistoryRefresh(spark, "day", "ok", ["wins"], buckets=16)
    out = {(r["key"], r["day"].day): (r["starts"], r["wins"]) for r in refresh.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(part)).collect()}
    assert out["k7", 3] == (2, 2) and out["k7", 2] == (1, 1) and out["k8", 1] == (0, 0)
    last = refresh.index(refresh.version)
    moved = [b for b, v in last.items() if v > min(last.values())]
    own = spark.createDataFrame([("s", "k7")], "store string, key string").select(refresh.bucket()).first()[0]
    assert len(last) > 8 and moved == [own]
    state = refresh._state(last, sorted(last), "store string, key string, starts long, wins long, last_day date")
    assert state.count() == 40 and state.filter("key = 'k7'").first()["starts"] == 3


def test_closing_report_shows_open_days(spark):
    rows = spark.createDataFrame([("a", ts(0), 1), ("a", ts(10), 2), ("b", ts(1500), 3), ("a", ts(3000), 4)], "tier string, at timestamp, pay int")
    p = fresh_path(spark, "p")
    rows.write.parquet(p)
    roles = ("at", F.col("tier"), F.lit(100), F.col("pay"))
    emitted = ST.run_available(ST.daily_roi(spark.readStream.schema(rows.schema).parquet(p), *roles, "1 minute"), "daily")
    assert emitted.agg(F.max("day")).first()[0] < ts(2880)
    got = {(r.day.day, r.tier): (r.bets, r.payout) for r in ST.closed_daily_roi(emitted, rows, *roles).collect()}
    assert got == {(1, "a"): (2, 3), (2, "b"): (1, 3), (3, "a"): (1, 4)}
