"""Filter interaction audit: what every filter removes, repeats or costs in every order of application.

One bit per filter says that a document fails it.  Documents collapse to *mask cells* (part, mask) with counts, at most
2 ** filters for every part.  A recursive CTE starts from the empty prefix of every part and extends each prefix by the
letters it does not hold yet; it joins the part's cells, carries the applied bits, and every level appends the metrics of
its step.  The prefixes of full length are the permutations.

Documents are counted by rows: repeated rows count as often as they occur.  The copy filter compares whole texts by
SHA-256 over the whole table; a row fails it if an equal text has a smaller doc_id, so rows that share the smallest id
pass.  A null doc_id is never larger than another and passes; a null text is empty; a null part is the empty part, one with
an empty name.  Labels of a doc_id count if any of its rows says so; a null label never counts.  An empty table has no
part and gives no rows; columns that are not needed are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.llm.common import text_of
from pitpanel.sources.workdir import materialise

COPY = "E"
PARTS = 2_000  # parts in one recursion: 326 prefixes each stay under Spark's limit of a million rows
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the single documents, by letter."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, LETTERS, ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]")}


def mask_of(conditions: Mapping[str, Column]) -> Column:
    """Bit i is set if condition i holds."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return mask


def cells(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], part: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic) of all documents; the bit after the conditions is the copy filter.

    Rows travel as id, hash and mask, combined on the map side before either shuffle, so copies of any number are few rows.
    """
    text = text_of("text")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("h"), mask_of(conditions).alias("mask"))
    rows = rows.groupBy("doc_id", "h", "mask", "part").agg(F.count(F.lit(1)).alias("n"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # null ids are spread over the shuffle by their hash and match no label
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.xxhash64("h")))
    rows = rows.join(known, (F.col("_key") == F.col("_id")) & F.col("doc_id").isNotNull(), "left")
    same = rows.groupBy("h", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without"))
    first = F.min("least").over(W.partitionBy("h"))
    passed = F.col("without") + F.when(F.col("least") == first, F.col("at_least")).otherwise(F.lit(0))
    same = same.withColumn("passed", passed)
    split = F.inline(F.array(F.struct(F.col("mask"), F.col("passed").alias("k")),
                             F.struct((F.col("mask") + F.lit(1 << len(conditions))).alias("mask"), (F.col("n") - F.col("passed")).alias("k"))))
    same = same.select("part", "good", "toxic", split)
    return same.groupBy("part", "mask").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("good"), F.col("k")).otherwise(0)).alias("good"),
                                            F.sum(F.when(F.col("toxic"), F.col("k")).otherwise(0)).alias("toxic"))


WALK = """
WITH RECURSIVE walk(part, prefix, applied, step, trail) AS (
  SELECT part, '', 0, 0, cast(array() AS array<struct<step: int, filter: string, kept: bigint, removed: bigint, redundant: bigint,
                                                      unique_fails: bigint, good_lost: bigint, toxic_lost: bigint>>)
  FROM {packed}
  UNION ALL
  SELECT part, prefix || letter, applied | bit, step + 1, array_append(trail, named_struct(
      'step', step + 1, 'filter', letter,
      'kept', aggregate(cells, 0L, (s, c) -> s + if(c.mask & (applied | bit) = 0, c.n, 0L)),
      'removed', aggregate(cells, 0L, (s, c) -> s + if(c.mask & bit <> 0 AND c.mask & applied = 0, c.n, 0L)),
      'redundant', aggregate(cells, 0L, (s, c) -> s + if(c.mask & bit <> 0 AND c.mask & applied <> 0, c.n, 0L)),
      'unique_fails', aggregate(cells, 0L, (s, c) -> s + if(c.mask = bit, c.n, 0L)),
      'good_lost', aggregate(cells, 0L, (s, c) -> s + if(c.mask & bit <> 0 AND c.mask & applied = 0, c.good, 0L)),
      'toxic_lost', aggregate(cells, 0L, (s, c) -> s + if(c.mask & bit <> 0 AND c.mask & applied = 0, c.toxic, 0L))))
  FROM (SELECT w.*, c.cells, explode(filter({letters}, l -> w.applied & l.bit = 0)) AS unused FROM walk w JOIN {packed} c USING (part))
       LATERAL VIEW inline(array(unused)) u AS letter, bit
)
SELECT part, prefix AS filter_order, inline(trail) FROM walk WHERE step = {steps}"""


def orders(counted: DataFrame, letters: str) -> DataFrame:
    """Metrics of every (part, filter_order, step) from the mask cells, with the filter's Shapley sum over all orders."""
    packed = materialise(counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "cells")
    blocks = 1 + packed.count() // PARTS
    spread = packed.withColumn("_block", F.pmod(F.xxhash64("part"), F.lit(2 * blocks))) if blocks > 1 else packed
    array = "array(" + ", ".join(f"struct('{x}' AS letter, {1 << i} AS bit)" for i, x in enumerate(letters)) + ")"
    out = None
    for b in range(2 * blocks if blocks > 1 else 1):
        own = spread.filter(F.col("_block") == b).drop("_block") if blocks > 1 else packed
        walked = counted.sparkSession.sql(WALK.replace("{letters}", array).replace("{steps}", str(len(letters))), packed=own)
        out = walked if out is None else out.unionByName(walked)
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))


def audited(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included."""
    conditions = failures(text_of("text"))
    return orders(cells(docs, labels, conditions, part, doc_id), "".join(conditions) + COPY).drop("filter")
