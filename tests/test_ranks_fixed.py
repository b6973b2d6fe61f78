"""Ranks by slices read one evaluation of the probability, whichever branch of the plan asks for it."""

import random

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import contest as C


@pytest.fixture
def noisy(spark):
    """Scores that differ from one evaluation to the next, as a float sum may after another shuffle."""
    noise = F.udf(lambda i: i % 10 + random.random(), "double").asNondeterministic()
    return spark.range(400).select(F.lit(1).alias("g"), "id", noise("id").alias("p"))


def in_order(rows, name):
    best = sorted(rows, key=lambda r: (-r["p"], r["id"]))
    return [r[name] for r in best] == list(range(1, len(rows) + 1))


def test_model_rank_by_slices(noisy):
    assert in_order(C.model_rank(noisy, ["g"], "p", "id", slices=6).collect(), "model_rank")


def test_model_rank_of_hot_and_ordinary_groups(spark):
    rows = [(g, f"{g}-{i:03d}", (i * 7 % 5) / 5) for g, n in ((1, 300), (2, 3), (3, 1)) for i in range(n)]
    got = C.model_rank(spark.createDataFrame(rows, "g int, id string, p double"), ["g"], "p", "id", hot_rows=100).collect()
    for g in (1, 2, 3):
        assert in_order([r for r in got if r["g"] == g], "model_rank")
