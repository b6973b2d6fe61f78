"""Hard negatives by Kronecker-packed products.

Components become whole numbers, floor(scale * x).  In a block of rows the components of several candidates are made
non-negative by a bias and put into separate fields of one wide integer, one integer for each dimension; an anchor's
components are biased likewise.  One product of a packed integer with an anchor component holds the products of all its
candidates, and the sum over the dimensions holds their sums, because a field is wide enough for the largest sum of its
block.  Unpacking takes the fields apart and subtracts what the biases added, so every score is exact.  Fields of up to
32 bits share 64-bit words; wider ones share Python integers, which have no bound.

Anchors and candidates meet in blocks: every block of candidates stays where it is and meets the blocks of anchors by
their number, at most ROUND_BYTES of anchors in one pass.  The first pass finds the positives, the second the negatives under each positive's score; a
block keeps only its own best for each of them, and the merge is a group limit in Spark.

Defined cases.  Rows with a null id, label or vector, or with a null or non-finite component take no part.  Components
beyond +-2**26 count as that bound (64 dimensions then stay within 64-bit scores).  Vectors of unlike length are multiplied
over the components both have; an empty vector scores 0 with all.  Exactly repeated rows count once; of anchors with equal
ids the one with the largest (label, vector) counts.  Ties of score go to the smaller id.  An anchor without another row of
its label has no positives, and a positive without a fitting negative no rows.  An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.sources.workdir import materialise

SCALE = 256
LARGEST = 1 << 26
CANDIDATES = 2048  # rows in a block of candidates (1 MB at 64 dimensions)
ANCHORS = 512
WIDE_FIELDS = 16  # candidates in one Python integer
ROUND_BYTES = 64 << 20  # of anchors that are broadcast together
NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q holds the whole components."""
    v = F.col(vector)

    def whole(x: Column) -> Column:
        return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(float(scale)) * x.cast("double")))).cast("long")

    usable = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(v, whole).alias("q"))


def packed(q: np.ndarray, bias: int, width: int, fields: int) -> np.ndarray:
    """(rows, dimensions) to (groups, dimensions): ``fields`` consecutive rows in the fields of one integer, the first lowest."""
    rows = -(-len(q) // fields) * fields
    kind = np.uint64 if width * fields <= 64 else object
    biased = np.zeros((rows, q.shape[1]), kind)
    biased[:len(q)] = (q + bias).astype(kind)
    biased = biased.reshape(-1, fields, q.shape[1])
    out = biased[:, 0]
    for k in range(1, fields):
        out = out | biased[:, k] << (np.uint64(k * width) if kind is np.uint64 else k * width)
    return out


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors, candidates) of two integer matrices with as many columns."""
    n, d = candidates.shape
    if not n or not d or not len(anchors):
        return np.zeros((len(anchors), n), np.int64)
    b, a = max(0, -int(candidates.min())), max(0, -int(anchors.min()))
    width = max(1, (d * (int(candidates.max()) + b) * (int(anchors.max()) + a)).bit_length())
    fields = 64 // width if width <= 32 else WIDE_FIELDS
    words = packed(candidates, b, width, fields)
    kind = words.dtype
    product = (anchors + a).astype(kind) @ words.T  # one product for each anchor component and packed integer
    out = np.empty((len(anchors), product.shape[1], fields), np.int64)
    mask = (1 << width) - 1
    wide = kind == object
    side, total = candidates.sum(axis=1), anchors.sum(axis=1)
    # what the biases added: a * (sum of the candidate) + b * (sum of the anchor) + d * a * b
    for k in range(fields):
        own = np.zeros(product.shape[1], np.int64)
        own[:len(side[k::fields])] = side[k::fields]
        if wide:
            added = a * own.astype(object)[None, :] + b * total.astype(object)[:, None] + d * a * b
            out[:, :, k] = (((product >> (k * width)) & mask) - added).astype(np.int64)
        else:
            out[:, :, k] = ((product >> np.uint64(k * width)) & np.uint64(mask)).astype(np.int64) - (a * own[None, :] + b * total[:, None] + d * a * b)
    return out.reshape(len(anchors), -1)[:, :n]


def best(s: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest allowed scores of every row, more where the last one is tied."""
    s = np.where(allowed, s, NONE)
    if s.shape[1] > k:
        floor = np.maximum(np.partition(s, -k, axis=1)[:, -k], NONE + 1)
        return np.nonzero(s >= floor[:, None])
    return np.nonzero(s > NONE)


def matrix(flat: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Vectors of a block as rows of one matrix, shorter ones filled with zeros."""
    out = np.zeros((len(length), int(length.max()) if len(length) else 0), np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out


BLOCK = "ids array<long>, labels array<long>, length array<long>, q array<long>"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a partition in blocks of at most ``size``, sorted by id in each block; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size).sort_by("vec_id")
                q = part.column("q")
                own = [part.column("vec_id"), part.column("label"), pa.compute.list_value_length(q).cast(pa.int64()), q.flatten()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in own], names=["ids", "labels", "length", "q"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, BLOCK)


def block_number(vec_id: str, blocks_: int) -> Column:
    return F.pmod(F.xxhash64(vec_id), F.lit(blocks_))


def anchor_blocks(anchors: DataFrame, size: int) -> tuple[DataFrame, int, int]:
    """Blocks of about ``size`` anchors by the hash of their distinct ids, their count and the bytes of all of them."""
    unique = materialise(anchors.groupBy("vec_id").agg(F.max(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q"), "anchors")
    n, numbers = unique.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()
    count = max(1, -(-n // size))
    members = unique.groupBy(block_number("vec_id", count).alias("number")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "q"))).alias("m"))
    rows = members.select("number", F.col("m.vec_id").alias("ids"), F.col("m.label").alias("labels"),
                          F.transform("m", lambda x: F.size(x["q"]).cast("long")).alias("length"), F.flatten(F.col("m.q")).alias("q"))
    return materialise(rows, "anchor_blocks"), count, 8 * numbers


def met(candidates: DataFrame, anchors: DataFrame, count: int, size: int, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of every block of candidates with every block of anchors.

    The candidates stay in place: they name the block numbers and meet the broadcast blocks by number.  Anchors of more than
    ROUND_BYTES are met in several rounds, each of them a pass over the candidates that is written before the next begins.
    """
    rounds = max(1, -(-size // ROUND_BYTES))
    out = None
    for r in range(rounds):
        low, high = count * r // rounds, count * (r + 1) // rounds
        if low == high:
            continue
        own = anchors.filter(F.col("number").between(low, high - 1)).select("number", *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "number"])
        asked = candidates.withColumn("number", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))))
        part = score(asked.join(F.broadcast(own), "number"))
        part = part if rounds == 1 else materialise(part, "round")
        out = part if out is None else out.unionByName(part)
    return out


def columns_of(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].values.to_numpy(zero_copy_only=False) for name in batch.schema.names if name != "number"}


def block_scores(r: dict[str, np.ndarray]) -> np.ndarray:
    a, c = matrix(r["a_q"], r["a_length"]), matrix(r["q"], r["length"])
    d = min(a.shape[1], c.shape[1])
    return scores(np.ascontiguousarray(a[:, :d]), np.ascontiguousarray(c[:, :d]))


def first(row: np.ndarray, col: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` of the entries of each row: larger scores first, then smaller columns (the ids of a block are sorted)."""
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    return row[place < k], col[place < k]


def positives_of(pairs: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the best of every block pair, the anchor itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in columns_of(batch):
                s = block_scores(r)
                allowed = (r["labels"][None, :] == r["a_labels"][:, None]) & (r["ids"][None, :] != r["a_ids"][:, None])
                row, col = first(*best(s, allowed, k), s, k)
                yield pa.RecordBatch.from_pydict({"anchor_id": r["a_ids"][row], "positive_id": r["ids"][col], "positive_score": s[row, col]})

    return pairs.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")


def negatives_of(pairs: DataFrame, k: int, share: int) -> DataFrame:
    """Best negatives of every block pair for each (anchor, positive) of the anchor block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in columns_of(batch):
                s = block_scores(r)
                other = r["labels"][None, :] != r["a_labels"][:, None]
                at = np.searchsorted(r["a_ids"], r["a_anchor"])
                for start in range(0, len(at), ANCHORS):
                    own, top = at[start:start + ANCHORS], r["a_limit"][start:start + ANCHORS]
                    t = s[own]
                    allowed = other[own] & (t <= top[:, None]) & (100 * t >= share * top[:, None])
                    row, col = first(*best(t, allowed, k), t, k)
                    yield pa.RecordBatch.from_pydict({"anchor_id": r["a_ids"][own[row]], "positive_id": r["a_positive"][start + row], "positive_score": top[row],
                                                      "negative_id": r["ids"][col], "negative_score": t[row, col]})

    return pairs.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")


def with_positives(own: DataFrame, positives: DataFrame, count: int) -> DataFrame:
    """Anchor blocks with the (anchor, positive, score) of their positives; blocks without any leave."""
    found = positives.groupBy(block_number("anchor_id", count).alias("number")).agg(F.sort_array(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score"))).alias("p"))
    return own.join(found, "number").select(*own.columns, F.col("p.anchor_id").alias("anchor"), F.col("p.positive_id").alias("positive"), F.col("p.positive_score").alias("limit"))


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: int = 80, candidates: int = CANDIDATES, anchors: int = ANCHORS) -> DataFrame:
    """Hard negatives of every (anchor, positive): rows (vec_id, label, q) as ``quantised`` gives them.

    Positives are the anchor's best other rows of its label; negatives the best rows of other labels that score at most as
    much as the positive and at least ``share`` per cent of it.  Every result is from the exact scores of all rows.
    """
    own, count, size = anchor_blocks(rows.filter(is_anchor), anchors)
    others = blocks(rows, candidates)
    a = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = met(others, own, count, size, lambda pairs: positives_of(pairs, positives)).distinct()
    found = materialise(found.withColumn("_r", F.row_number().over(a)).filter(F.col("_r") <= positives).drop("_r"), "positives")
    p = W.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = met(others, with_positives(own, found, count), count, size, lambda pairs: negatives_of(pairs, negatives, share)).distinct()
    hard = hard.withColumn("rank", F.row_number().over(p).cast("int")).filter(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """Labels of ids divisible by ``every`` moved on by one."""
    moved = (F.col("label") + 1) % classes
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, moved).otherwise(F.col("label")))
