"""The unknown class of the licence scan is trained and calibrated on all ordinary paragraphs; brute-force versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.llm import licenses

FOUND = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."
AWKWARD = ["", None, "\n \n\t\n", "two words", "a b c\n\na b c\nA  B--c", "the copyright of the work\nthe rights of the work", "to use, copy, modify, MERGE; to use copy", "of_the_software and of the Software",
           "the " * 3000 + "rights to use", "été the rights naïve to use", "ſoftware the Kelvin K İn the", "1.0 2.0 3-clause", "the rights to usé"]


def split(paragraph):
    return re.findall(r"[^\W_]+", paragraph.lower())


def grams_of(words):
    return {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def anchored(paragraph):
    return any(a in paragraph for a in [*licenses.ANCHOR_NAMES, *[v for a in licenses.ANCHORS for v in (a[1:], a.upper())]])


def ordinary_paragraphs(texts):
    return [p for t in texts for p in (t or "").split("\n") if len(split(p)) > 2 and not anchored(p)]


def vocabulary():
    return sorted({g for ts in licenses.NOTICES.values() for t in ts for g in grams_of(split(t))})


def corpus():
    """700 texts of six paragraphs: more than 600 texts, more than 3,000 paragraphs."""
    rng = random.Random(11)
    plain = [w for w in vocabulary() if " " not in w and not anchored(w) and not anchored(w.title())]
    pieces = [t for ts in licenses.NOTICES.values() for t in ts]
    def paragraph():
        if rng.random() < 0.05:  # a line of a notice without its anchors
            w = split(rng.choice(pieces))
            at = rng.randrange(len(w))
            return "so " + " ".join(x for x in w[at:at + rng.randrange(3, 9)] if not anchored(x) and x not in ("gnu", "cc0")) + " then and so"
        return " ".join(rng.choice(plain if rng.random() < 0.3 else ["river", "stone", "house", "of", "the", "and"]) for _ in range(rng.randrange(3, 14)))
    return ["\n".join(paragraph() for _ in range(6)) for _ in range(700)]


def table(spark, texts):
    rows = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "doc_id long, text string")
    return rows.withColumn("h", F.xxhash64("text")).repartition(4)


def held_out(spark, paragraphs):
    rows = spark.createDataFrame([(p,) for p in set(paragraphs)], "p string")
    return {r["p"]: r["held"] for r in rows.select("p", (F.pmod(F.xxhash64("p"), F.lit(5)) == 0).alias("held")).collect()}


def test_every_ordinary_paragraph_is_counted_with_its_known_grams(spark):
    texts = AWKWARD + corpus()
    paragraphs, known = ordinary_paragraphs(texts), vocabulary()
    held = held_out(spark, paragraphs)
    want = Counter((held[p], tuple(sorted(grams_of(split(p)) & set(known)))) for p in paragraphs)
    got = licenses.ordinary(table(spark, texts), known).collect()
    assert len(got) == len(want) and {(r["held"], tuple(r["grams"])): r["n"] for r in got} == dict(want)


def test_level_comes_from_all_held_out_paragraphs(spark, monkeypatch):
    monkeypatch.setattr(licenses, "LEAST_LEVEL", 0.0)
    texts = corpus()
    model, level = licenses.fit(spark, table(spark, texts))
    vectors, regression = model.stages
    at = {g: i for i, g in enumerate(vectors.vocabulary)}
    w, b = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
    paragraphs = ordinary_paragraphs(texts)
    held, p = held_out(spark, paragraphs), []
    for t in paragraphs:
        if held[t]:
            z = b + w[:, [at[g] for g in grams_of(split(t)) if g in at]].sum(axis=1)
            e = np.exp(z - z.max())
            p.append(1 - e[0] / e.sum())
    cells = sorted(math.ceil(x * 10_000) for x in p)
    assert len(p) > 700 and cells[-1] > cells[math.ceil(0.995 * len(p)) - 1] > 1
    assert level == pytest.approx(cells[math.ceil(0.995 * len(p)) - 1] / 10_000, abs=1e-9)


def test_many_ordinary_paragraphs_leave_the_notices_their_weight(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(licenses, "materialise", lambda df, name: seen.append(df.cache()) or seen[-1])
    texts = corpus()
    docs = table(spark, [*texts, *texts[:100] * 20, f"intro\n{FOUND}"])
    got = {r["doc_id"]: r["families"] for r in licenses.scanned(docs).filter("n_licenses > 0").collect()}
    assert got == {2700: "gpl"}
    assert seen[0].agg(F.sum("n")).first()[0] == len(ordinary_paragraphs([*texts, *texts[:100] * 20]))


def test_level_of_cells():
    assert licenses.level_of([], 0) == 0.0
    assert licenses.level_of([(3, 995), (7000, 5)], 1000) == 0.0003
    assert licenses.level_of([(3, 994), (7000, 6)], 1000) == 0.7
