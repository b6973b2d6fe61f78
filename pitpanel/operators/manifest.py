"""Order-independent table fingerprints and the reuse decision per partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def fingerprint(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, hash sum and hash xor per partition; does not depend on row order or file layout."""
    cols = list(columns) if columns else [c for c in df.columns if c not in by]
    h = F.xxhash64(*cols)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def content_hash(df: DataFrame) -> DataFrame:
    """Rows and one hash of all values as text, independent of row order: kept next to a written report."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    part = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(20,0)")
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("s"))
    return sums.select("rows", F.md5(F.concat_ws("|", "s", F.col("rows").cast("string"))).alias("content_hash"))


def stale_partitions(current: DataFrame, manifest: DataFrame, by: str, carries_forward: bool = True) -> DataFrame:
    """Partitions to rebuild: changed, new or lost ones and, when state carries forward, all later ones."""
    m = manifest.select(by, F.struct("rows", "hash_sum", "hash_xor").alias("_m"))
    c = current.select(by, F.struct("rows", "hash_sum", "hash_xor").alias("_c"))
    j = c.join(m, by, "full").withColumn("changed", ~F.col("_c").eqNullSafe(F.col("_m")))
    first = F.min(F.when(F.col("changed"), F.col(by))).over(W.partitionBy(F.lit(0)))  # one row per year
    rebuild = (F.col(by) >= first) if carries_forward else F.col("changed")
    return j.select(by, "changed", F.coalesce(rebuild, F.lit(False)).alias("rebuild"))


def digest_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int = 3) -> DataFrame:
    """Digest of every range of the key hash, from the root (level 0) to ranges of ``depth`` hexadecimal digits.

    A range is a prefix of the md5 of the key; its digest is the number of its rows and the sum of their 48-bit content hashes,
    so that the digest of a range is the sum of its sixteen children, and neither row order nor file layout matters.  Rows are
    aggregated once into the at most 16^depth leaves; the levels above are sums of those.  Nulls in keys and values are a
    value of their own.  An empty table has no ranges.
    """
    key = F.md5(_line(keys))
    rows = df.select(F.substring(key, 1, depth).alias("range"), F.conv(F.substring(F.md5(_line([*keys, *columns])), 1, 12), 16, 10).cast("decimal(20,0)").alias("h"))
    leaves = rows.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("h").alias("h"))
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda n: F.struct(n.alias("level"), F.substring(F.col("range"), F.lit(1), n).alias("range")))
    return leaves.select("rows", "h", F.inline(prefixes)).groupBy("level", "range").agg(F.sum("rows").alias("rows"), F.sum("h").cast("string").alias("digest"))


def _line(columns: Sequence[str]):
    """Values as one text: every value is preceded by its length, a null has none, so different rows never read alike."""
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in [F.col(c).cast("string") for c in columns]])


def differing_ranges(old: DataFrame, new: DataFrame, depth: int = 3) -> DataFrame:
    """Ranges whose digests differ, level by level: a range is looked at only if the one above it differs.

    ``old`` and ``new`` are tables of ``digest_tree``.  Rows that are on one side only count as 0 rows on the other.
    """
    def level(t: DataFrame, n: int, side: str) -> DataFrame:
        return t.filter(F.col("level") == n).select("range", F.col("rows").alias(f"{side}_rows"), F.col("digest").alias(f"{side}_digest"))

    found, above = None, None
    for n in range(depth + 1):
        a, b = level(old, n, "old"), level(new, n, "new")
        if above is not None:
            parent = F.substring("range", 1, n - 1)
            a, b = [t.withColumn("_up", parent).join(above, "_up", "left_semi").drop("_up") for t in (a, b)]
        differs = a.join(b, "range", "full").filter(~(F.col("old_rows").eqNullSafe(F.col("new_rows")) & F.col("old_digest").eqNullSafe(F.col("new_digest"))))
        here = differs.select(F.lit(n).alias("level"), "range", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("old_rows", "new_rows")])
        above = here.select(F.col("range").alias("_up"))
        found = here if found is None else found.unionByName(here)
    return found


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], ranges: DataFrame, depth: int = 3) -> DataFrame:
    """Keys whose rows differ, read only from the leaf ranges that differ; ``change`` is added, removed or changed.

    Rows of one key are compared as a multiset.  At most 16^depth ranges, so the list of leaves is broadcast with that bound.
    """
    leaves = F.broadcast(ranges.filter(F.col("level") == depth).select(F.col("range").alias("_leaf")))

    def side(df: DataFrame, name: str) -> DataFrame:
        d = df.withColumn("_leaf", F.substring(F.md5(_line(keys)), 1, depth)).join(leaves, "_leaf", "left_semi")
        h = F.conv(F.substring(F.md5(_line([*keys, *columns])), 1, 12), 16, 10).cast("decimal(20,0)")
        return d.groupBy(*[F.col(k).alias(f"{name}_{i}") for i, k in enumerate(keys)]).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).alias(name))

    cond = F.lit(True)
    for i in range(len(keys)):
        cond = cond & F.col(f"old_{i}").eqNullSafe(F.col(f"new_{i}"))
    j = side(old, "old").join(side(new, "new"), cond, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return j.select(*[F.when(F.col("old").isNull(), F.col(f"new_{i}")).otherwise(F.col(f"old_{i}")).alias(k) for i, k in enumerate(keys)], change.alias("change"))
