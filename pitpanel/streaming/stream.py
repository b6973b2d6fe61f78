"""Structured Streaming forms of the ledger and the per-day history refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.operators import history as H
from pitpanel.sources.workdir import fresh_path


def unique_events(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Exactly-once ingest: repeated keys inside the watermark are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def join_settlements(predictions: DataFrame, settlements: DataFrame, key: str, predicted_at: str, settled_at: str, delay: str, within: str) -> DataFrame:
    """Stream-stream left outer join in a time bound; unmatched predictions come out as pending once the bound has passed."""
    p = predictions.withWatermark(predicted_at, delay)
    s = settlements.withColumnRenamed(key, "_key").withWatermark(settled_at, delay)
    cond = (F.col(key) == F.col("_key")) & (F.col(settled_at) > F.col(predicted_at)) & (F.col(settled_at) <= F.col(predicted_at) + F.expr(f"interval {within}"))
    j = p.join(s, cond, "leftOuter")
    return j.withColumn("status", F.when(F.col("_key").isNull(), "pending").otherwise("settled")).drop("_key")


def daily_roi(stream: DataFrame, ts: str, tier: Column, stake: Column, payout: Column, delay: str) -> DataFrame:
    """Tumbling daily ROI by tier; rows later than the watermark are dropped."""
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), tier.alias("tier"))
    d = g.agg(F.count(F.lit(1)).alias("bets"), F.sum(stake).alias("stake"), F.sum(payout).alias("payout"))
    return d.select(F.col("w.start").alias("day"), "tier", "bets", "stake", "payout", F.try_divide(100.0 * F.col("payout"), F.col("stake")).alias("roi"))


def closed_daily_roi(emitted: DataFrame, rows: DataFrame, ts: str, tier: Column, stake: Column, payout: Column) -> DataFrame:
    """Closing report of ``daily_roi``: the days that the stream emitted and, from the closed table, those it still held open."""
    shown = emitted.select("day").distinct()
    day = F.date_trunc("day", ts)
    held = rows.withColumn("day", day).join(F.broadcast(shown), "day", "left_anti")  # one row per day of the calendar
    d = held.groupBy("day", tier.alias("tier")).agg(F.count(F.lit(1)).alias("bets"), F.sum(stake).alias("stake"), F.sum(payout).alias("payout"))
    return emitted.unionByName(d.withColumn("roi", F.try_divide(100.0 * F.col("payout"), F.col("stake"))))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available into a file sink in the shared folder and read it back."""
    spark = stream.sparkSession
    out, ck = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def settled_once(joined: DataFrame, predictions: DataFrame, settlements: DataFrame, key: str, ids: Sequence[str], predicted_at: str, settled_at: str, within: str) -> DataFrame:
    """Closing report of the stream join: every prediction exactly once, with its first settlement or as pending.

    Several settlements of a prediction leave the earliest; predictions that the open stream still holds back, or that
    came later than the watermark, are looked up in the closed tables.
    """
    rest = [c for c in settlements.columns if c not in (key, settled_at)]
    first = F.min(F.when(F.col(settled_at).isNotNull(), F.struct(settled_at, *rest))).alias("_s")
    done = joined.groupBy(*ids).agg(first)
    left = predictions.join(done.select(*ids), list(ids), "left_anti")
    s = settlements.withColumnRenamed(key, "_key")
    cond = (F.col(key) == F.col("_key")) & (F.col(settled_at) > F.col(predicted_at)) & (F.col(settled_at) <= F.col(predicted_at) + F.expr(f"interval {within}"))
    out = done.unionByName(left.join(s, cond, "left").groupBy(*ids).agg(first))
    return out.select(*ids, *[F.col(f"_s.{c}").alias(c) for c in (settled_at, *rest)], F.when(F.col("_s").isNull(), "pending").otherwise("settled").alias("status"))


class HistoryRefresh:
    """Per closed day(s): join the snapshot, emit prior totals, merge the days into the next snapshot version.

    The newest day seen is still open: its rows wait until a later day arrives or the stream ends, so a day that is
    spread over several batches is counted as one and never sees itself.  Rows of days that are closed already are
    kept apart; at the end they make the totals of all days anew from the written day facts.

    The snapshot lies in ``buckets`` by the hash of the key.  A batch reads and writes the buckets of its own keys only; the
    index of the batch says which version of a bucket is the newest, and the files of all others stay as they are.  Every
    batch writes its own folders, so a retried batch gives the same files.
    """

    def __init__(self, spark: SparkSession, day: str, ok: str, flags: Sequence[str], buckets: int = 64):
        self.spark, self.day, self.ok, self.flags, self.buckets = spark, day, ok, list(flags), buckets
        self.root = fresh_path(spark, "refresh")

    def _put(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")

    def _get(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/version={version}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("store", "key"), F.lit(self.buckets)).cast("int")

    def index(self, version: int) -> dict[int, int]:
        """Newest version of every bucket after a batch (at most ``buckets`` rows)."""
        return {r["bucket"]: r["at"] for r in self._get("index", version).collect()} if version >= 0 else {}

    def _state(self, index: dict[int, int], buckets: Sequence[int], schema) -> DataFrame:
        paths = [f"{self.root}/snapshot/version={index[b]}/bucket={b}" for b in buckets if b in index]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _advance(self, rows: DataFrame, version: int, keep_open: bool) -> None:
        day = F.col(self.day)
        if version:
            closed = self._get("closed", version - 1).first()[0]
            rows = rows.unionByName(self._get("open", version - 1))
        else:
            closed = None
        newest = rows.agg(F.max(self.day)).first()[0] if keep_open else None
        late = rows.filter(day <= F.lit(closed)) if closed is not None else rows.filter(F.lit(False))
        live = rows.filter(day > F.lit(closed)) if closed is not None else rows
        closing = live.filter(day < F.lit(newest)) if newest is not None else live
        self._put(late, "late", version)
        self._put(live.filter(day >= F.lit(newest)) if newest is not None else live.filter(F.lit(False)), "open", version)
        self._put(H.key_days(closing, self.day, self.ok, self.flags), "facts", version)
        fresh = H.snapshot(closing, self.day, self.ok, self.flags)
        index = self.index(version - 1)
        touched = sorted(r[0] for r in closing.select(self.bucket()).distinct().collect())  # at most ``buckets``
        state = self._state(index, touched, fresh.schema)
        self._put(H.extend_from_snapshot(state, closing, self.day, self.ok, self.flags), "features", version)
        merged = state.unionByName(fresh).groupBy("store", "key").agg(*[F.sum(c).alias(c) for c in ["starts", *self.flags]], F.max("last_day").alias("last_day"))
        merged.select(*fresh.columns, self.bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/snapshot/version={version}")
        written = {r[0] for r in fresh.select(self.bucket()).distinct().collect()} | {b for b in touched if b in index}
        self._put(self.spark.createDataFrame(sorted((index | {b: version for b in written}).items()), "bucket int, at int"), "index", version)
        last = closing.agg(F.max(self.day).alias("closed"))
        self._put(last.select(F.greatest("closed", F.lit(closed)).alias("closed")) if closed is not None else last, "closed", version)
        self.version = version

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._advance(batch, batch_id, keep_open=True)

    def run(self, stream: DataFrame) -> DataFrame:
        """Process everything available, close the last day and return the totals of all days."""
        ck = fresh_path(self.spark, "refresh-checkpoint")
        self.version = -1
        q = stream.writeStream.foreachBatch(self).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        empty = self.spark.createDataFrame([], stream.schema)
        self._advance(empty, self.version + 1, keep_open=False)
        out = self.spark.read.parquet(f"{self.root}/features").drop("version")
        late = self.spark.read.parquet(f"{self.root}/late").drop("version")
        if not late.head(1):
            return out
        days = self.spark.read.parquet(f"{self.root}/facts").drop("version").unionByName(H.key_days(late, self.day, self.ok, self.flags))
        days = days.groupBy("store", "key", self.day).agg(*[F.sum(c).alias(c) for c in days.columns if c not in ("store", "key", self.day)])
        return H.prior_totals(days, self.day, ["starts", *self.flags]).select(*out.columns)
