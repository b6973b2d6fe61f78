"""Licence scans: a paragraph classifier on sparse word n-grams, with a calibrated unknown class and template comparison.

DataFrame functions and Spark ML only.  A multinomial logistic regression on the words, pairs and triples that occur in
licence notices is trained on windows of the notices below and on the ordinary paragraphs of all texts, which have a
bounded weight together, so that a large corpus doesn't outweigh the notices.  Equal sets of n-grams are one weighted row.
Every paragraph of every text is scanned; one with fewer than LEAST_COMMON n-grams of all notices together can't be confirmed and
is unknown at once, the others are classified, with or without an anchor word.  A family is reported if its probability exceeds the level that ordinary held-out
paragraphs reach and if the paragraph shares enough n-grams with a notice of that family.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import text_of
from pitpanel.sources.workdir import materialise

UNKNOWN = "unknown"
ROW_WEIGHT = 0.2  # of an ordinary sentence or paragraph; a notice or a window of one has 1
ORDINARY_WEIGHT = 480.0  # most weight that the ordinary paragraphs of the corpus have together
VOCABULARY = 20_000
LEAST_LEVEL = 0.5
HELD_SHARE = 0.995  # share of the held-out ordinary paragraphs that don't exceed the level
LEVEL_CELLS = 10_000  # the level is a multiple of 1 / LEVEL_CELLS
LEAST_SHARED = 0.6  # share of the n-grams of the paragraph or of the notice that must be common
LEAST_COMMON = 7  # n-grams; the shortest notice has nine
#: Public licence notices by family.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Copyright. All rights reserved."],
}
#: Sentences with anchor words that grant nothing.
ORDINARY = [
    "You need a driving licence to rent a car here.", "The committee may license more taxis next year.", "She studied at MIT before she moved to Boston.", "The copyright office moved to a new building.",
    "The warranty covers repairs for two years.", "The apache helicopter landed near the village.", "He asked for permission to leave the room.", "The public domain of the king was large.", "Mozilla and GNU are names of projects.",
]
ANCHORS = ["licen", "copyright", "redistribut", "hereby", "creative", "domain", "reserved", "warrant"]  # in lower, upper or title case
ANCHOR_NAMES = ["GNU", "CC0", "CC BY"]
FAMILIES = [UNKNOWN, *NOTICES]


def words(column: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def has_anchor(column: Column) -> Column:
    """Plain substring tests, which read the bytes of a text once each."""
    out = F.lit(False)
    for a in [*ANCHOR_NAMES, *[v for a in ANCHORS for v in (a[1:], a.upper())]]:
        out = out | column.contains(a)
    return out


def paragraphs(rows: DataFrame) -> DataFrame:
    """(doc_id, h, line, paragraph): the lines with something else than white space."""
    return rows.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line", "paragraph")).filter(F.col("paragraph").rlike(r"\S"))


def with_grams(rows: DataFrame) -> DataFrame:
    """Add ``grams``: the distinct words, pairs and triples of ``words``."""
    rows = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows)
    rows = NGram(n=3, inputCol="words", outputCol="triples").transform(rows)
    return rows.withColumn("grams", F.array_distinct(F.concat("words", "pairs", "triples"))).drop("pairs", "triples")


def notices(spark) -> DataFrame:
    rows = [(FAMILIES.index(f), f"{f}-{i}", t) for f, ts in NOTICES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "label int, notice string, text string").select("label", "notice", words(F.col("text")).alias("words"))


def with_known_grams(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Add ``grams``: the sorted distinct words, pairs and triples of ``words`` that the vocabulary holds.

    Pairs are made of known words and triples of known pairs only, so the vocabulary must hold the words of its pairs and
    the pairs of its triples.
    """
    one, two, three = ([v for v in vocabulary if v.count(" ") == spaces] for spaces in range(3))
    following = lambda grams, at: F.zip_with(grams, F.slice("ones", at, F.size("ones")), lambda g, w: F.concat(g, F.lit(" "), w))
    rows = rows.withColumn("ones", F.transform("words", lambda g: F.when(g.isin(one), g)))
    rows = rows.withColumn("pairs", F.transform(following("ones", 2), lambda g: F.when(g.isin(two), g)))
    rows = rows.withColumn("triples", F.filter(following("pairs", 3), lambda g: g.isin(three)))
    return rows.withColumn("grams", F.sort_array(F.array_distinct(F.array_compact(F.concat("ones", "pairs", "triples"))))).drop("ones", "pairs", "triples")


def confirmable(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The rows whose ``words`` hold LEAST_COMMON or more n-grams of the vocabulary, which has every n-gram of every notice."""
    known = with_known_grams(rows, vocabulary)
    # an outer explode, since a filter on the n-grams would be pushed down and make them several times
    kept = F.explode_outer(F.when(F.size("grams") >= LEAST_COMMON, F.array("words"))).alias("words")
    return known.select(*[c for c in rows.columns if c != "words"], kept).filter(F.col("words").isNotNull())


def ordinary(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(held, grams, n): the paragraphs of all texts that have no anchor and three words or more (fewer can't be confirmed), counted by their sets of known n-grams."""
    lines = rows.select(F.explode(F.split("text", "\n")).alias("paragraph"))
    plain = lines.filter(F.col("paragraph").rlike(r"\S") & ~has_anchor(F.col("paragraph")))
    split = plain.select((F.pmod(F.xxhash64("paragraph"), F.lit(5)) == 0).alias("held"), words(F.col("paragraph")).alias("words"))
    counted = with_known_grams(split, vocabulary).groupBy("held", "grams").agg(F.count_if(F.size("words") > 2).alias("n"))
    return counted.filter("n > 0")  # not a filter on the words, which would be pushed down and split them twice


def training(spark, rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(label, grams, held, n): whole notices and windows of them, ordinary sentences (both without n), all ordinary paragraphs."""
    base = notices(spark).drop("notice")
    n = F.size("words")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(n - 9, F.lit(1)), F.lit(3)))
    windows = base.select("label", "words", starts.alias("at")).select("label", F.slice("words", F.col("at"), 10).alias("words"))
    sentences = spark.createDataFrame([(t,) for t in ORDINARY], "text string").select(F.lit(0).alias("label"), words(F.col("text")).alias("words"))
    own = with_grams(base.unionByName(windows).unionByName(sentences)).select("label", "grams", F.lit(False).alias("held"), F.lit(None).cast("long").alias("n"))
    return own.unionByName(ordinary(rows, vocabulary).select(F.lit(0).alias("label"), "grams", "held", "n"))


def fit(spark, docs: DataFrame) -> tuple[PipelineModel, float]:
    """The classifier and the probability level of the unknown class: what held-out ordinary paragraphs hardly ever reach."""
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=VOCABULARY).fit(with_grams(notices(spark)))
    rows = materialise(training(spark, docs, vectors.vocabulary), "licences")
    trained, held = rows.agg(*[F.coalesce(F.sum(F.when(F.col("held") == h, F.col("n"))), F.lit(0)) for h in (False, True)]).first()
    unit = min(ROW_WEIGHT, ORDINARY_WEIGHT / max(trained, 1))
    weighed = rows.filter("not held").withColumn("weight", F.when(F.col("label") > 0, 1.0).otherwise(F.coalesce(F.col("n") * unit, F.lit(ROW_WEIGHT))))
    regression = LogisticRegression(labelCol="label", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=40)
    model = Pipeline(stages=[vectors, regression]).fit(weighed)
    reached = model.transform(rows.filter("held")).select("n", F.ceil((1 - vector_to_array("probability")[0]) * LEVEL_CELLS).alias("cell"))
    cells = sorted(tuple(r) for r in reached.groupBy("cell").agg(F.sum("n")).collect())  # at most LEVEL_CELLS + 1
    return model, max(LEAST_LEVEL, level_of(cells, held))


def level_of(cells: list[tuple[int, int]], total: int) -> float:
    """The least edge of a cell that at least HELD_SHARE of all counted probabilities don't exceed; 0 without any."""
    below = 0
    for cell, n in cells:
        below += n
        if below >= HELD_SHARE * total:
            return cell / LEVEL_CELLS
    return 0.0


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_paragraphs, n_licenses, families (sorted, comma-joined), best_probability, found.

    ``found`` lists (line, family, probability, shared) of the paragraphs that were confirmed.  A paragraph is a line with
    something else than white space; it is read whole.  Null and empty texts have no paragraphs.  Repeated rows get the
    same answer; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    model, level = fit(spark, rows)
    likely = confirmable(paragraphs(rows).select("doc_id", "h", "line", words(F.col("paragraph")).alias("words")), model.stages[0].vocabulary)
    graded = model.transform(with_grams(likely)).select("doc_id", "h", "line", "grams", vector_to_array("probability").alias("p"))
    families = F.array(*[F.lit(f) for f in FAMILIES])
    best = F.array_max(F.slice("p", 2, len(FAMILIES) - 1))
    graded = graded.withColumn("probability", best).withColumn("label", F.array_position("p", F.col("probability")) - 1).filter(F.col("probability") >= level)
    known = with_grams(notices(spark)).select(F.col("label").alias("of"), F.col("grams").alias("notice_grams"))  # one row per fixed notice
    compared = graded.join(F.broadcast(known), F.col("label") == F.col("of"))
    common = F.size(F.array_intersect("grams", "notice_grams"))
    shared = F.greatest(common / F.size("grams"), common / F.size("notice_grams"))
    confirmed = compared.groupBy("doc_id", "h", "line").agg(F.max(F.when(common >= LEAST_COMMON, shared)).alias("shared"), F.max("probability").alias("probability"), F.max(families[F.col("label")]).alias("family"))
    confirmed = confirmed.filter(F.col("shared") >= LEAST_SHARED)
    per_text = confirmed.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(
        F.count(F.lit(1)).alias("n_licenses"), F.concat_ws(",", F.array_sort(F.collect_set("family"))).alias("families"), F.max("probability").alias("best_probability"),
        F.array_sort(F.collect_list(F.struct("line", "family", "probability", "shared"))).alias("found"))  # the lines of one text
    count = F.regexp_count("text", F.lit(r"[^\s][^\n]*")).cast("long")  # from the first sign of a line to its end
    out = rows.select("doc_id", "h", count.alias("n_paragraphs"))
    out = out.join(per_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("families", F.lit("")).alias("families"),
                      F.coalesce("best_probability", F.lit(0.0)).alias("best_probability"), "found")
