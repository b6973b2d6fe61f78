"""Near copies by word shingles: pairs with Jaccard similarity of at least 0.8 on five words, and SimHash links.

First every text of a min-hash bucket is compared with the bucket's smallest one; with 48 bands of 8 a pair of similarity
exactly 0.8 shares no bucket with probability (1 - 0.8 ** 8) ** 48 = 1.5e-4, a more similar one less often.  What is left
are texts that share a bucket but lie in different components.  A crowd of them is not paired: their shingles are ordered
by how many of these texts hold them, the rarest first, and a pair meets only at a shingle whose places in both texts leave
room for the overlap that 0.8 needs (an exact bound, so no pair of 0.8 among these texts is lost).  Two texts that differ in
a fifth of their shingles have their own shingles there and never meet.  Every candidate is compared by its whole set of
shingles before it counts.  Pairs within 2 bits of SimHash are links as in ``simhash``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.functions.ordered import join_stats
from pitpanel.llm.common import arrow_map, text_of, texts, with_ids
from pitpanel.llm.simhash import fingerprint, links, stars
from pitpanel.sources.workdir import materialise

SHINGLE = 5
LEAST_SIMILARITY = 0.8
BANDS, ROWS = 48, 8
SALTS = 64  # copies of a text that is compared with very many others
CACHED_WORDS = 500_000
MAP = 16  # longs of a text's bitmap
_numbers = np.random.RandomState(20)
FACTORS = _numbers.randint(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFTS = _numbers.randint(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def mixed_bits(h: np.ndarray) -> np.ndarray:
    for factor in MIXERS[:2]:
        h = (h ^ h >> np.uint64(31)) * factor
    return h ^ h >> np.uint64(29)


def shingles(text: str, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed_bits(out + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def band_keys(s: np.ndarray, chunk: int = 512) -> np.ndarray:
    """One 64-bit key for every band of min-hashes of the shingles."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), chunk):
        np.minimum(least, (h[at:at + chunk, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mixed_bits(key * MIXERS[2] + column)
    return key.view(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """Bitmap of MAP longs: a bit is set if an odd number of shingles fall on it."""
    odd = np.bincount((mixed_bits(s * MIXERS[3]) % np.uint64(64 * MAP)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, node, fp, bands) of rows (doc_id, node, text)."""

    def make():
        known = WordHashes()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = texts(batch)
            fps = np.array([fingerprint(t) for t in own], dtype=np.uint64).view(np.int64)
            bands = pa.array([band_keys(shingles(t, known)) for t in own], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(fps), bands], names=["doc_id", "node", "fp", "bands"])
        return apply

    return arrow_map(rows, make, "doc_id long, node long, fp long, bands array<long>")


def compared(pairs: DataFrame, nodes: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a similarity of ``least`` or more; ``nodes`` has one (node, text) each."""
    pairs = pairs.select("u", "v", F.pmod(F.xxhash64("u"), F.lit(SALTS)).alias("salt"))
    right = pairs.select("v", "salt").distinct().join(nodes.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    both = pairs.join(right, ["v", "salt"]).join(nodes.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")

    def make():
        known = WordHashes()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, last, s = [], None, None
            for a, b in zip(texts(batch, "a"), texts(batch, "b")):
                if a != last:
                    last, s = a, shingles(a, known)
                t = shingles(b, known)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(common >= least * (len(s) + len(t) - common) - 1e-9)
            return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        return apply

    return arrow_map(both.select("u", "v", "a", "b"), make, "u long, v long", rows=200)


def room(own: str, place: str, other: Column) -> Column:
    """Whether a shingle at ``place`` (from 0) of ``own`` shingles leaves an overlap o with 9 * o >= 4 * (own + other)."""
    return 9 * (F.col(own) - F.col(place)) >= 4 * (F.col(own) + other)


def met(texts_: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of different roots whose similarity can be 0.8 by size and by the place of a common shingle.

    ``texts_`` has (node, root, text).  In the order of rarity the first common shingle of a pair bounds its overlap by the
    shingles from there on.  Odd-count bitmaps of the shingles bound it too: sets that share o of m and n shingles differ in at
    most m + n - 2 * o bits.  Both bounds are part of the join, so what they exclude is no row.  Shingles of one text, of one component or without room for their smallest partner go before
    the join; hot shingles are counted and joined salted.
    """

    def make():
        known = WordHashes()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [shingles(t, known) for t in texts(batch)]
            sets = pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))
            maps = pa.array([parities(s) for s in own], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), sets, maps], names=["node", "root", "s", "bits"])
        return apply

    sets = materialise(arrow_map(texts_.select("node", "root", "text"), make, "node long, root long, s array<long>, bits array<long>"), "sets")
    rows = sets.select("node", "root", F.size("s").cast("long").alias("size"), F.explode("s").alias("h"))
    counts = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "counts")
    rows = join_stats(rows, counts.withColumn("held", F.col("df")), ["h"], ["held"], "df", split=True, hot_rows=1000)
    rows = rows.withColumn("held", F.coalesce("held", F.lit(1).cast("long")))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("held", "h")).cast("long") - 1)
    rows = materialise(rows.filter("held > 1").filter(5 * (F.col("size") - F.col("place")) >= 4 * F.col("size")), "prefix")
    useful = rows.groupBy("h").agg(F.min("size").alias("least"), F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).filter("x < y")
    rows = join_stats(rows.drop("held"), materialise(useful, "useful"), ["h"], ["least"], "n", split=True, hot_rows=1000)
    rows = materialise(rows.filter("least is not null").filter(room("size", "place", F.col("least"))), "meeting")
    rows = materialise(rows.join(sets.select("node", "bits"), "node"), "maps")
    a = rows.select("h", F.col("node").alias("u"), F.col("root").alias("p"), F.col("size").alias("m"), F.col("place").alias("i"), *[F.col("bits")[k].alias(f"a{k}") for k in range(MAP)])
    b = rows.select("h", F.col("node").alias("v"), F.col("root").alias("q"), F.col("size").alias("n"), F.col("place").alias("j"), *[F.col("bits")[k].alias(f"b{k}") for k in range(MAP)])
    unlike = " + ".join(f"bit_count(a{k} ^ b{k})" for k in range(MAP))
    pairs = a.join(b, "h").filter((F.col("u") > F.col("v")) & (F.col("p") != F.col("q")) & room("m", "i", F.col("n")) & room("n", "j", F.col("m")) & F.expr(f"9 * ({unlike}) <= m + n"))
    return pairs.select("u", "v").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, component_id (smallest doc_id reachable over links, itself included).

    Nodes are the distinct texts, by a 64-bit hash.  Null counts as empty; a null doc_id stays null and is never the
    smallest unless its component has no other id.  Repeated rows get the same answer; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("node", F.xxhash64("text"))
    prints = materialise(sketches(rows.select("doc_id", "node", "text")), "sketches")
    types = materialise(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "types")

    # SimHash: the smallest text of every fingerprint stands for it
    classes = materialise(types.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "classes")
    close = links(classes.select("fp")).join(classes.select(F.col("fp").alias("u"), F.col("head").alias("x")), "u").join(classes.select(F.col("fp").alias("v"), F.col("head").alias("y")), "v")
    close = close.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    same = join_stats(types.select("node", "fp"), classes.filter("n > 1"), ["fp"], ["head"], "n", split=True, hot_rows=1000).filter("node > head")

    keyed = types.select("node", F.explode("bands").alias("key"))
    buckets = materialise(keyed.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    keyed = materialise(join_stats(keyed, buckets, ["key"], ["head"], "n", split=True, hot_rows=1000).filter("head is not null"), "keyed")
    first = materialise(keyed.filter("node > head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct(), "pairs")
    # texts that any comparison can need, one row for each
    wanted = keyed.select("node").distinct()
    nodes = materialise(rows.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "nodes")
    edges = close.unionByName(same.select(F.col("node").alias("u"), F.col("head").alias("v"))).unionByName(compared(first, nodes)).distinct()
    edges = materialise(edges, "edges")

    roots = stars(edges)
    # texts of buckets that hold different components so far
    placed = keyed.select("key", "node").join(wanted.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "node")
    placed = materialise(placed, "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    crowd = materialise(placed.join(open_, "key", "left_semi").groupBy("node").agg(F.first("root").alias("root")), "open")
    rest = met(crowd.join(nodes, "node")).join(first, ["u", "v"], "left_anti")
    more = materialise(compared(rest, nodes), "more")
    if not more.isEmpty():
        roots = stars(edges.unionByName(more).distinct())

    member = materialise(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    linked = types.select("node", "least", "n").join(member, "node")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = types.select("node", "least", "n").join(member.join(best, "root").select("node", "component_id"), "node", "left")
    named = named.select("node", "n", F.coalesce("component_id", "least").alias("component_id"))
    return join_stats(prints.select("doc_id", "node"), materialise(named, "named"), ["node"], ["component_id"], "n", split=True, hot_rows=1000).select("doc_id", "component_id")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id names their component, with their own columns; the others leave.  Rows with a null id stay."""
    gone = near_groups(docs, doc_id, text).filter("doc_id <> component_id").select("doc_id")
    return with_ids(docs, materialise(gone, "near"), "left_anti", doc_id)
