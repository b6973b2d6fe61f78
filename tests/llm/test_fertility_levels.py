"""Texts of a rare language or length are judged too."""

import random

from pitpanel.llm import fertility


def test_few_texts_of_a_class_are_judged_by_wider_bands(spark):
    rng = random.Random(5)
    vocabulary = [w for w in "time people year work house water school night story money month right study book word business issue side kind head".split()]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice("abcdefghij") for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice("qxzjkvw#") for _ in range(9)) for _ in range(n))
    rows = [(i, prose(rng.randrange(100, 500)), "en") for i in range(80)]
    rows += [(100, noise(300), "rare"), (101, prose(300), "rare"), (102, noise(6000), "en"), (103, prose(700), "en")]
    kept = {r["doc_id"]: r["kept"] for r in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("not base_failed").collect()}
    assert not kept[100] and not kept[102]
    assert kept[101] and kept[103] and all(kept[i] for i in range(80) if i in kept)
