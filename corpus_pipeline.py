"""A corpus pipeline: toxicity filter, exact de-duplication, near de-duplication, mixing, BPE encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
``documents``; the last one returns the encoded texts.  Between the stages the rows are written as Parquet.  Nulls, empty
and very long texts, ties, repeated rows, empty tables and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pitpanel.llm import bpe, exact, mixing, nearcopy, toxicity
from pitpanel.sources.workdir import materialise


def keep_civil(spark, docs, sf_dir):
    """Documents that the toxicity scorer rejects go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark, docs, sf_dir):
    """Of equal texts the largest doc_id stays."""
    return exact.dedup(docs)


def keep_unlike(spark, docs, sf_dir):
    """Of each group of near copies (similarity 0.8 on five words, or 2 bits of SimHash) the smallest doc_id stays."""
    return nearcopy.one_per_group(docs)


def mix_sources(spark, docs, sf_dir):
    """All rows, in the order that holds the target weights of the sources."""
    return mixing.in_order(docs)


def encode(spark, docs, sf_dir):
    """Token ids of every text and its position in the mixed order; the rows are sorted by position."""
    return bpe.encoded(mixing.positioned(docs), with_tokens=True, keep=("position",))


STAGES = [("toxicity", keep_civil), ("exact_dedup", keep_distinct), ("simhash_near_dedup", keep_unlike), ("mix_sources", mix_sources), ("bpe", encode)]

# Fingerprints, learned scores and merges are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
