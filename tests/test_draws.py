"""Draws in numpy equal those of the plain plan, number by number."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pitpanel.functions import draws as D
from pitpanel.functions import ordered
from pitpanel.operators import resample as B
from tests.plan_scan import plan_of


def test_words_equal_the_library():
    keys, lengths = D.string_keys([b"", b":7", b":1234567", b":" + b"x" * 70])
    for found in (((keys, lengths), ["", ":7", ":1234567", ":" + "x" * 70]), ((keys[:3, :8], lengths[:3]), ["", ":7", ":1234567"])):
        for four, words in D.blocks_of_four(42, *found[0], 440):
            for i, k in enumerate(found[1]):
                h = hashlib.md5(f"42:{four}{k}".encode()).hexdigest()
                assert [int(w[i]) for w in words] == [int(h[8 * q:8 * q + 8], 16) for q in range(4)]


@pytest.mark.parametrize("cents", [1, 0.37])
def test_multinomial_vectors_in_one_and_many_blocks(spark, monkeypatch, cents):
    monkeypatch.setattr(B, "PAGE_ROWS", 64)
    c = spark.range(900).select(F.col("id").alias("c"), (F.col("id") % 7 * 10 * cents).alias("return"), F.lit(100.0).alias("stake"))
    want = [tuple(r) for r in B.replicate_sums(c, "c", ["return", "stake"], 10, 9).orderBy("replicate").collect()]
    i = c.withColumnRenamed("c", "_i")
    for limit, codes in ((1 << 20, 1 << 16), (300, 1 << 16), (300, 3)):
        monkeypatch.setattr(B, "MOST_CODES", codes)
        got = [tuple(r) for r in B.multinomial_vectors(i, 900, ["return", "stake"], 10, 9, limit).orderBy("replicate").collect()]
        assert [r[0] for r in got] == [r[0] for r in want]
        assert got == [pytest.approx(r, rel=1e-12) for r in want]


def test_many_clusters_are_not_joined_with_draws(spark, monkeypatch):
    monkeypatch.setattr(B, "VECTOR_ROWS", 100)
    c = spark.range(300).select(F.col("id").alias("c"), F.lit(1.0).alias("n"))
    plan = plan_of(B.replicate_sums(c, "c", ["n"], 8, 9))
    assert "Broadcast" not in plan and "md5" not in plan


def test_poisson_vectors(spark, monkeypatch):
    c = spark.range(300).select(F.when(F.col("id") > 5, (F.col("id") / 3).cast("int").cast("string")).alias("c"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("bin"),
                                F.when(F.col("id") % 3 < 2, F.col("id").cast("double")).alias("n"), F.lit(1.0).alias("m"))
    one = c.filter("bin is null")
    want = [B.replicate_sums(d, "c", ["n", "m"], 10, 9, "poisson", by).orderBy("replicate", *by).collect() for d, by in ((c, ["bin"]), (one, []))]
    monkeypatch.setattr(ordered, "fits_one_task", lambda df, *_: False)
    frames = [B.replicate_sums(d, "c", ["n", "m"], 10, 9, "poisson", by) for d, by in ((c, ["bin"]), (one, []))]
    assert all("MapInArrow" in plan_of(d) and "md5" not in plan_of(d) for d in frames)
    assert [d.orderBy("replicate", *by).collect() for d, by in zip(frames, (["bin"], []))] == want
