"""Lines of a notice without an anchor word, and anchors in mixed case, are candidates like all others."""

from pyspark.sql import functions as F

from pitpanel.llm import licenses as L


def test_lines_without_an_anchor_are_candidates(spark):
    vocabulary = [r[0] for r in L.with_grams(L.notices(spark)).select(F.explode("grams")).distinct().collect()]
    lines = ["to any person obtaining a copy of this software and associated documentation files", "this LiCensed under the BSD 3-Clause LiCense.", "A walk in the park."]
    rows = spark.createDataFrame(list(enumerate(lines)), "line int, t string").select("line", L.words(F.col("t")).alias("words"))
    assert sorted(r["line"] for r in L.confirmable(rows, vocabulary).collect()) == [0, 1]
