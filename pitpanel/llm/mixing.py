"""Mixing sources to target weights by Pfair scheduling with earliest deadline first, in DataFrame functions only.

Every source is dealt into blocks of rows.  Block j of a source with weight w is released at slot floor(j / w) and due
by slot ceil((j + 1) / w); of the released blocks the one due first is taken, so a source never runs a whole block ahead
of or behind its weight.  When a source has no blocks left, a new phase begins with the weights of the others in
proportion, so every row is placed exactly once.  Weights are whole parts of ``period``, hence the order of a phase
repeats after at most ``period`` slots: only this pattern, made from the weights and the number of blocks of each source
(at most MAX_SOURCES rows), is planned on the driver; ranks, blocks and slots of all rows are computed by Spark.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.llm.common import packed
from pitpanel.sources.workdir import materialise

BLOCK_ROWS = 32
PERIOD = 1000
MAX_SOURCES = 250  # named sources; rows of all further ones are mixed as one source named OTHER
OTHER, NONE = "(other)", "(none)"
BUCKET_ROWS = 4096
PHASE_SCHEMA = "source string, phase int, first_block long, last_block long, start_slot long, parts long, period long, pattern array<int>"


def whole_parts(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Positive weights as whole parts, at least 1 each, by largest remainder."""
    total = sum(weights.values())
    exact = {s: w / total * max(period, len(weights)) for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, period - sum(parts.values()))]:
        parts[s] += 1
    return parts


def edf_pattern(parts: dict[str, int]) -> dict[str, list[int]]:
    """Slots of one period for every source: released blocks only, earliest deadline first, ties by name."""
    period = sum(parts.values())
    done, slots = dict.fromkeys(parts, 0), {s: [] for s in parts}
    for t in range(period):
        ready = [(-((-(done[s] + 1) * period) // q), s) for s, q in parts.items() if done[s] < q and done[s] * period // q <= t]
        s = min(ready)[1]
        slots[s].append(t)
        done[s] += 1
    return slots


def phases(blocks: dict[str, int], parts: dict[str, int]) -> list[tuple]:
    """Rows of PHASE_SCHEMA: which blocks of a source fall into a phase, and the repeating pattern of their slots."""
    out, done, start, number = [], dict.fromkeys(blocks, 0), 0, 0
    active = {s: parts[s] for s, n in blocks.items() if n}
    while active:
        period, pattern = sum(active.values()), edf_pattern(active)
        left = {s: blocks[s] - done[s] for s in active}
        end = min(((left[s] - 1) // q) * period + pattern[s][(left[s] - 1) % q] for s, q in active.items()) + 1
        whole, rest = divmod(end, period)
        for s, q in active.items():
            n = whole * q + sum(t < rest for t in pattern[s])
            if n:
                out.append((s, number, done[s], done[s] + n - 1, start, q, period, pattern[s]))
            done[s] += n
        start, number = start + end, number + 1
        active = {s: q for s, q in active.items() if done[s] < blocks[s]}
    return out


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, block_rows: int = BLOCK_ROWS,
          doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per input row: ``row``, doc_id, source, phase, block, slot, place (in the block), release_slot, due_slot.

    ``weights`` are targets by source; without them a source of n rows weighs n ** alpha, and sources that ``weights``
    doesn't name share their smallest weight.  Rows of a source are ordered by the MD5 of the id.  A null source is the
    source "(none)"; repeated rows and ids are placed one after the other; an empty table gives no rows.
    """
    rows = packed(docs, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit(NONE)).alias("name"))
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    named = [r["name"] for r in sizes.orderBy(F.desc("n"), "name").limit(MAX_SOURCES).collect()]
    pooled = F.when(F.col("name").isin(named), F.col("name")).otherwise(F.lit(OTHER))
    counts = {r["name"]: r["n"] for r in sizes.groupBy(pooled.alias("name")).agg(F.sum("n").alias("n")).collect()}
    if weights is None:
        target = {s: n ** alpha for s, n in counts.items()}
    else:
        target = {s: weights.get(s, min(weights.values())) for s in counts}
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, whole_parts(target) if target else {})
    plan_df = docs.sparkSession.createDataFrame(plan, PHASE_SCHEMA).withColumnRenamed("source", "_source")

    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = F.floor(F.conv(F.substring("md5", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    dealt = rows.select("row", "doc_id", pooled.alias("source"), key.alias("md5")).withColumn("bucket", bucket)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("source", "bucket").orderBy("md5", "doc_id")))
    ranked = ranked.join(offsets, ["source", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("offset"))
    placed = ranked.withColumn("block", F.floor(F.col("rank") / F.lit(block_rows)).cast("long")).join(
        F.broadcast(plan_df), (F.col("source") == F.col("_source")) & F.col("block").between(F.col("first_block"), F.col("last_block")))
    j = F.col("block") - F.col("first_block")
    slot = F.col("start_slot") + F.expr("(block - first_block) div parts") * F.col("period") + F.element_at("pattern", (F.pmod(j, F.col("parts")) + 1).cast("int"))
    release = F.col("start_slot") + F.expr("((block - first_block) * period) div parts")
    due = F.col("start_slot") + F.expr("((block - first_block + 1) * period + parts - 1) div parts")
    return placed.select("row", "doc_id", "source", "phase", "block", slot.cast("long").alias("slot"), (F.col("rank") % block_rows).alias("place"),
                         release.cast("long").alias("release_slot"), due.cast("long").alias("due_slot"))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """All rows with their own columns, sorted into the mixed order; written as files, :func:`positioned` finds it again."""
    return mixed(docs, **options).orderBy("slot", "place").select("row.*")


def positioned(docs: DataFrame) -> DataFrame:
    """Rows of :func:`in_order`, written or not, with their 0-based ``position`` and sorted by it.

    A scan deals files out by size, so the order comes from the numbers of the part files and the rows in them.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not a file scan yet
        docs = materialise(docs, "ordered")
    rows = packed(docs, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    number = [F.coalesce(F.regexp_extract("file", p, 1).try_cast("long"), F.lit(0)) for p in (r"part-(\d+)[^/]*$", r"-c(\d+)\.[^/]*$")]
    before = W.orderBy(*number, "file").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select(F.col("file").alias("_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row for each file
    placed = rows.join(F.broadcast(starts), F.col("file") == F.col("_file"))
    return placed.select("row.*", (F.col("start") + F.col("at")).alias("position")).orderBy("position")
