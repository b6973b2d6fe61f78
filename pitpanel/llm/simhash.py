"""Near-duplicates by SimHash fingerprints; candidate pairs by pigeonring filtering.

The 64 bits are cut into ``segments`` on a ring.  Two fingerprints within ``distance`` bits have a start from which,
for every l, the first l consecutive segments differ in at most floor(l * distance / segments) bits.  While this budget
is zero the segments are equal, and this equal run is the join key (28 of 64 bits by default).  The join condition then
demands the whole chain of budgets before the full Hamming check.  Work is done on distinct fingerprints, so copies of
any number are one node; links are joined to components by alternating star steps on written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.ordered import join_stats
from pitpanel.llm.common import arrow_map, text_of, texts, with_ids
from pitpanel.sources.workdir import materialise

BITS = 64
SEGMENTS = 16
DISTANCE = 2
SHINGLE = 3


def fingerprint(text: str, size: int = SHINGLE, chunk: int = 65536) -> int:
    """SimHash of all word shingles, repeats included: a bit is set if it is set in over half of the hashes; no word: 0."""
    import xxhash
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(size, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1:] - 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(first), chunk):
        a, b = first[at:at + chunk].tolist(), last[at:at + chunk].tolist()
        h = np.array([digest(line[i:j], 42) for i, j in zip(a, b)], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as the signed 64-bit value; null text counts as empty."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in texts(batch)], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])
        return apply

    return arrow_map(rows, make, "doc_id long, fp long")


def rotated(column: Column, by: int) -> Column:
    return column if by == 0 else F.shiftrightunsigned(column, by).bitwiseOR(F.shiftleft(column, BITS - by))


def low(column: Column, bits: int) -> Column:
    return column if bits >= BITS else column.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def chains(distance: int, segments: int) -> tuple[int, list[tuple[int, int]]]:
    """Bits of the equal run, and for every further budget the (bits, most differing bits) at the longest chain under it."""
    width = BITS // segments
    budget = [0] + [length * distance // segments for length in range(1, segments + 1)]
    run = max(length for length in range(1, segments + 1) if budget[length] == 0)
    steps = [(length * width, budget[length]) for length in range(run + 1, segments + 1) if length == segments or budget[length + 1] > budget[length]]
    return run * width, steps


def links(types: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (u, v), u > v, of distinct fingerprints ``fp`` within ``distance`` bits."""
    if BITS % segments or segments <= distance:
        raise ValueError("segments must divide 64 and exceed the distance")
    width = BITS // segments
    key_bits, steps = chains(distance, segments)
    starts = F.explode(F.array(*[
        F.struct(F.lit(i).cast("byte").alias("at"), low(rotated(F.col("fp"), i * width), key_bits).alias("run"), rotated(F.col("fp"), i * width).alias("ring"))
        for i in range(segments)])).alias("s")
    keyed = types.select("fp", starts).select("s.at", "s.run", "s.ring", "fp")
    a, b = keyed.alias("a"), keyed.alias("b")
    differs = F.col("a.ring").bitwiseXOR(F.col("b.ring"))
    cond = (F.col("a.at") == F.col("b.at")) & (F.col("a.run") == F.col("b.run")) & (F.col("a.fp") > F.col("b.fp"))
    for bits, most in steps:
        cond = cond & (F.bit_count(low(differs, bits)) <= most)
    return a.join(b, cond).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Edges (u > v) to (node, root): alternating large and small star steps until nothing changes.

    Every round is written to the shared folder.  Minima are combined on the map side; hubs are split by adaptive joins.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialise(edges, "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialise(moved.select("e.u", "e.v").filter("u > v").distinct(), "stars")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id reachable over links, itself included).

    Null and empty texts have fingerprint zero and link like any other.  A null doc_id stays null and is never the
    smallest unless its component has no other id.  Repeated rows get the same answer; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    types = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "types")
    roots = stars(links(types.select("fp"), distance, segments))
    member = materialise(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    linked = types.join(member, types.fp == member.node).select("root", "node", "least")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(best, "root").select("node", "component_id")
    classes = types.join(named, types.fp == named.node, "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return join_stats(prints, materialise(classes, "classes"), ["fp"], ["component_id"], "n", split=True, hot_rows=1000)


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id names their component, with their own columns; the others leave.  Rows with a null id stay."""
    gone = near_groups(docs, doc_id, text).filter("doc_id <> component_id").select("doc_id")
    return with_ids(docs, materialise(gone, "near"), "left_anti", doc_id)
