"""Exact de-duplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every text to two cells of a bit table and counts the cells (8 bytes per row and cell are
shuffled, combined on the map side).  Cells that were hit twice or more form the filter.  Pass 2 tests every
row: a row whose two cells are both in the filter may be repeated, and only such rows are shuffled by their
SHA-256; all others pass straight through as unique.  A repeated text always sets both cells twice, so nothing
is missed; a false alarm only costs the shuffle of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.ordered import join_stats
from pitpanel.llm.common import packed, text_of
from pitpanel.sources.workdir import materialise

BLOCK = 32768  # bits in one bitmap of Spark's bitmap functions
CELLS_PER_ROW = 16
MAX_FILTER_BITS = 28  # the filter has at most 2**28 cells, so its broadcast is at most 32 MB whatever the input


def filter_bits(rows: int, max_bits: int = MAX_FILTER_BITS) -> int:
    """Size of the bit table as a power of two: 16 cells per row within the bound of the broadcast."""
    return max(15, min(max_bits, (CELLS_PER_ROW * rows).bit_length()))


def cells(digest: Column, bits: int) -> tuple[Column, Column]:
    """Two independent cells from the first and the second half of a 64-bit hash."""
    mask = F.lit((1 << bits) - 1).cast("long")
    return digest.bitwiseAND(mask), F.shiftrightunsigned(digest, 32).bitwiseAND(mask)


def repeated_cells(hashed: DataFrame, bits: int) -> DataFrame:
    """Bitmaps of the cells that two or more rows hit: (block, bitmap of 4 KB), at most 2**bits / 8 bytes."""
    twice = (
        hashed.select(F.explode(F.array(*cells(F.col("h"), bits))).alias("cell"))
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    )
    return (
        twice.select((F.shiftright("cell", 15)).alias("block"), F.col("cell").bitwiseAND(F.lit(BLOCK - 1)).alias("bit"))
        .repartition("block").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def in_filter(rows: DataFrame, bitmaps: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add ``flag``: both cells of ``h`` are in the filter.  The bitmaps are broadcast within their proven bound."""
    out = rows
    for i, cell in enumerate(cells(F.col("h"), bits)):
        side = bitmaps.select(F.col("block").alias(f"block{i}"), F.col("bitmap").alias(f"bitmap{i}"))
        out = out.withColumn(f"cell{i}", cell)
        out = out.join(F.broadcast(side), F.shiftright(f"cell{i}", 15) == F.col(f"block{i}"), "left")
    tests = []
    for i in range(2):
        bit = F.col(f"cell{i}").bitwiseAND(F.lit(BLOCK - 1))
        byte = F.substring(F.col(f"bitmap{i}"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        tests.append(F.coalesce(F.pmod(F.floor(value / F.pow(F.lit(2.0), bit.bitwiseAND(F.lit(7)))), F.lit(2)) == 1, F.lit(False)))
    return out.withColumn(flag, tests[0] & tests[1]).drop(*[f"{n}{i}" for n in ("cell", "block", "bitmap") for i in range(2)])


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per input row: ``row`` (the whole input row), doc_id, keep_id, group_size, kept, text_sha256, maybe_repeated.

    Texts are equal when identical; null equals the empty text.  Of equal texts the largest doc_id stays (a null id
    loses to any other; a group of null ids keeps them).  Repeated rows with the same id and text count in group_size
    and get the same answer.  An empty table gives no rows; extra columns of any name stay inside ``row``.
    """
    t = text_of(text)
    base = packed(docs, F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("h"), F.sha2(t, 256).alias("text_sha256"))
    bits = filter_bits(docs.count(), max_bits)
    bitmaps = materialise(repeated_cells(base.select("h"), bits), "bloom")
    flagged = in_filter(base, bitmaps, bits, "maybe_repeated")
    unique = flagged.filter("not maybe_repeated").select(
        "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "maybe_repeated")
    candidates = flagged.filter("maybe_repeated").select("row", "doc_id", "text_sha256", "maybe_repeated")
    groups = candidates.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups.withColumn("rows", F.col("group_size")), "groups")
    joined = join_stats(candidates, groups, ["text_sha256"], ["keep_id", "group_size"], "rows", split=True, hot_rows=1000)
    repeated = joined.select("row", "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "maybe_repeated")
    return unique.unionByName(repeated)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their own columns.  Fully repeated rows (same id and text) leave exactly one."""
    kept = exact_groups(docs, doc_id, text).filter("kept")
    once = kept.filter("group_size = 1").select("row.*")
    return once.unionByName(kept.filter("group_size > 1").dropDuplicates(["text_sha256"]).select("row.*"))
