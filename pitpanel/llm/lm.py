"""Quality by perplexity: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

N-grams are packed into 60-bit numbers, so counts, continuation counts and context sums are joins and aggregations of
numbers that Spark shards by key.  Every trusted text is counted; partial counts are combined in the tasks before they
are shuffled.  The finished tables are cut into shards by the last two characters of the context; each shard has a
checked size and is broadcast in turn, and a pass over the texts adds up what the shard knows.  A text is rejected
if its perplexity lies too far above the quantiles of all texts of its language.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import arrow_map, text_of, texts, with_ids
from pitpanel.sources.workdir import materialise

ORDER = 5
WIDTH = 12  # bits of a character
FOLD = 0xF00  # characters from here on are folded into classes of 256 neighbours
SHARD_ENTRIES = 4_000_000  # most table entries that are broadcast at once (64 MB)
WIDEN = 4.0  # the threshold lies this many times the distance from first quartile to median above the median (of log perplexity)
SHORT = 2.0  # and this much over the root of the number of characters, since short texts vary more
LEAST_TEXTS = 50
BLANK = re.compile(r"[\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")


def codes(text: str) -> np.ndarray:
    """Character numbers of a text after ORDER - 1 blanks: white space runs are one blank, digits one sign, rare scripts folded."""
    line = BLANK.sub(" ", DIGIT.sub("0", text)).strip(" ")
    if not line:
        return np.zeros(0, np.int64)
    c = np.frombuffer((" " * (ORDER - 1) + line + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(c < FOLD, c, FOLD + (c >> 8) % (4096 - FOLD))


def windows(c: np.ndarray) -> np.ndarray:
    """Packed n-grams of the highest order, the last character lowest."""
    n = len(c) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = out << WIDTH | c[k:k + n]
    return out


def counted(rows: DataFrame) -> DataFrame:
    """(g, c): counts of the n-grams of the highest order in all texts."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [windows(codes(t)) for t in texts(batch)]
            g, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c.astype(np.int64))], names=["g", "c"])
        return apply

    return arrow_map(rows, make, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def tail(column: Column, characters: int) -> Column:
    return column.bitwiseAND(F.lit((1 << WIDTH * characters) - 1).cast("long"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the counts of counts; 0.5, 1, 1.5 where these are too few."""
    row = counts.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.1), k - 0.05) for d, k in zip(raw, (1, 2, 3))]


def train(trusted: DataFrame) -> DataFrame:
    """Model table (n, g, kind, v): log probability of n-gram g ("p") or log weight that context g leaves to the lower order ("b").

    The highest order has plain counts, lower orders the number of distinct characters before.  Without trusted text
    the table is empty.
    """
    top = materialise(counted(trusted), "ngrams")
    counts, levels = top, {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        counts = counts.groupBy(tail(F.col("g"), n).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        levels[n] = counts = materialise(counts, f"level{n}")
    characters = levels[1].count()
    lower, out = None, None
    for n in range(1, ORDER + 1):
        d = discounts(levels[n])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = levels[n].select("g", "c", F.shiftrightunsigned("g", WIDTH).alias("ctx"), tail(F.col("g"), n - 1).alias("low"), off.alias("off"))
        context = rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("off").alias("mass"))
        seen = rows.join(context, "ctx")
        if lower is None:
            p = (F.col("c") - F.col("off")) / F.col("total") + F.col("mass") / F.col("total") / F.lit(float(characters + 1))
        else:
            seen = seen.join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
            p = (F.col("c") - F.col("off")) / F.col("total") + F.col("mass") / F.col("total") * F.col("q")
        lower = materialise(seen.select("g", p.alias("p")), f"p{n}")
        table = lower.select(F.lit(n).alias("n"), "g", F.lit("p").alias("kind"), F.log("p").alias("v")).unionByName(
            context.select(F.lit(n).alias("n"), F.col("ctx").alias("g"), F.lit("b").alias("kind"), F.log(F.col("mass") / F.col("total")).alias("v")))
        out = table if out is None else out.unionByName(table)
    return out


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a context by its last two characters."""
    return F.pmod(F.xxhash64(tail(key, 2)), F.lit(shards)).cast("int")


class Tables:
    """Sorted tables of one shard for look-up: all of orders 1 and 2, the shard's part of the higher ones."""

    def __init__(self, n: np.ndarray, g: np.ndarray, kind: np.ndarray, v: np.ndarray):
        self.p, self.b = {}, {}
        for k in range(1, ORDER + 1):
            for name, store in (("p", self.p), ("b", self.b)):
                own = (n == k) & (kind == name)
                order = np.argsort(g[own], kind="stable")
                store[k] = (g[own][order], v[own][order])

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, v = table
        if not len(g):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(g, keys), len(g) - 1)
        return g[at] == keys, v[at]

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last character of every n-gram, backing off through unseen orders."""
        out, at, keys = np.zeros(len(grams)), np.arange(len(grams)), grams
        for n in range(ORDER, 0, -1):
            hit, v = self.find(self.p[n], keys)
            out[at[hit]] += v[hit]
            at, keys = at[~hit], keys[~hit]
            if not len(at):
                return out
            known, left = self.find(self.b[n], keys >> WIDTH)
            out[at] += np.where(known, left, 0.0)
            keys = keys & ((1 << WIDTH * (n - 1)) - 1)
        out[at] -= np.log(len(self.p[1][0]) + 1.0)  # an unknown character
        return out


def scored(rows: DataFrame, model: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(doc_id, h, lang, n_chars, log_likelihood) of every text: one pass per shard of the model, added up per row."""
    spark = rows.sparkSession
    model = materialise(model, "model")
    entries = model.count()
    shards = max(1, -(-entries // shard_entries))
    passes = None
    key = F.when(F.col("kind") == "p", F.shiftrightunsigned("g", WIDTH)).otherwise(F.col("g"))
    for s in range(shards):
        part = model if shards == 1 else model.filter((F.col("n") <= 2) | (shard_of(key, shards) == s))
        table = part.toArrow()  # at most about shard_entries rows, by the choice of shards
        tables = Tables(*(table.column(c).to_numpy() for c in ("n", "g")), np.array(table.column("kind").to_pylist(), dtype=object), table.column("v").to_numpy())
        shared = spark.sparkContext.broadcast((tables.p, tables.b))

        def make(shared=shared, s=s):
            tables = Tables.__new__(Tables)
            tables.p, tables.b = shared.value

            def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
                n, total = [], []
                parts = [windows(codes(t)) for t in texts(batch)]
                grams = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                mine = np.ones(len(grams), bool) if shards == 1 else shard_numbers(grams, shards) == s
                values = np.zeros(len(grams))
                values[mine] = tables.log_probability(grams[mine]) if entries else 0.0
                ends = np.cumsum([0, *map(len, parts)])
                sums = np.concatenate([[0.0], np.cumsum(values)])
                total, n = sums[ends[1:]] - sums[ends[:-1]], np.array([len(x) for x in parts], np.int64)
                return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "h", "lang")], pa.array(n), pa.array(total)], names=["doc_id", "h", "lang", "n_chars", "log_likelihood"])
            return apply

        one = arrow_map(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, lang string, n_chars long, log_likelihood double", rows=500)
        passes = one if passes is None else passes.unionByName(one)
    if shards == 1:
        return passes
    n = F.count(F.lit(1)) / shards  # repeated rows meet here and are dealt out again
    sums = passes.groupBy("doc_id", "h", "lang").agg(F.max("n_chars").alias("n_chars"), (F.sum("log_likelihood") / n).alias("log_likelihood"), n.cast("int").alias("rows"))
    return sums.select("doc_id", "h", "lang", "n_chars", "log_likelihood", F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("_")).drop("_")


def shard_numbers(grams: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every n-gram by the last two characters of its context, as :func:`shard_of` has it."""
    import xxhash
    keys = grams >> WIDTH & (1 << 2 * WIDTH) - 1
    pairs, inverse = np.unique(keys, return_inverse=True)
    own = np.array([np.array(xxhash.xxh64_intdigest(int(k).to_bytes(8, "little"), 42), np.uint64).astype(np.int64) % shards for k in pairs], np.int64)
    return own[inverse] if len(pairs) else np.zeros(0, np.int64)


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", widen: float = WIDEN, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """One row per input row: doc_id, lang, n_chars, perplexity (per character), threshold, kept.

    Trusted are the documents whose label says quality 1.  Null and empty texts have no characters, perplexity and threshold
    null, and are not kept.  A null language is "und"; a language with few texts has no threshold and keeps all.
    Without trusted text every perplexity is 1 and nothing is rejected.  Repeated rows get
    the same answer; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id")
    model = train(with_ids(rows, good, "left_semi").select("text"))
    done = scored(rows.withColumn("h", F.xxhash64("text")), model, shard_entries)
    perplexity = F.when(F.col("n_chars") > 0, F.exp(-F.col("log_likelihood") / F.col("n_chars")))
    done = materialise(done.withColumn("perplexity", perplexity), "perplexity")
    quartiles = F.percentile_approx(F.log("perplexity"), F.array(F.lit(0.25), F.lit(0.5)), 10000)
    limits = done.filter("perplexity is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), quartiles.alias("q")).filter(F.col("n") >= LEAST_TEXTS)
    limits = limits.select("lang", (F.col("q")[1] + widen * (F.col("q")[1] - F.col("q")[0])).alias("level"))
    out = done.join(F.broadcast(limits), "lang", "left")  # one row for each language
    out = out.withColumn("threshold", F.exp(F.col("level") + F.try_divide(F.lit(SHORT), F.sqrt("n_chars"))))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))
