"""Digest trees, frequent values, logit audits and joined samples against plain Python, with odd rows."""

import math
import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import history as H
from pitpanel.operators import integrate as I
from pitpanel.operators import manifest as MF
from pitpanel.operators import quality as Q

KIND = "k string, n int, v string"


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(f"k{i}", i % 7, rng.choice(["a", "bb", None, "", "1:a"])) for i in range(400)]
    return out + [(None, 1, "x"), ("", 1, "x"), ("k1", 1, "bb"), ("k1", 1, "bb")]


def differences(spark, old, new, depth=2):
    a, b = table(spark, old), table(spark, new)
    ranges = MF.differing_ranges(MF.digest_tree(a, ["k"], ["n", "v"], depth), MF.digest_tree(b, ["k"], ["n", "v"], depth), depth)
    keys = MF.changed_keys(a, b, ["k"], ["n", "v"], ranges, depth)
    return {(r.level, r.range): (r.old_rows, r.new_rows) for r in ranges.collect()}, {r.k: r.change for r in keys.collect()}


def test_tree_levels_add_up_and_ignore_row_order(spark, rows):
    tree = {(r.level, r.range): (r.rows, int(r.digest)) for r in MF.digest_tree(table(spark, rows), ["k"], ["n", "v"], 2).collect()}
    mixed = random.Random(1).sample(rows, len(rows))
    again = {(r.level, r.range): (r.rows, int(r.digest)) for r in MF.digest_tree(table(spark, mixed).repartition(5), ["k"], ["n", "v"], 2).collect()}
    assert tree == again and tree[0, ""][0] == len(rows)
    for level in (0, 1):
        for (n, prefix), (count, digest) in tree.items():
            if n == level:
                below = [v for (m, p), v in tree.items() if m == level + 1 and p.startswith(prefix)]
                assert (sum(c for c, _ in below), sum(d for _, d in below)) == (count, digest)


def test_one_edit_is_found_along_one_path(spark, rows):
    new = [(k, n, "changed") if k == "k33" else (k, n, v) for k, n, v in rows]
    ranges, keys = differences(spark, rows, new)
    assert keys == {"k33": "changed"} and sorted(n for n, _ in ranges) == [0, 1, 2]
    paths = sorted(p for _, p in ranges)
    assert all(b.startswith(a) for a, b in zip(paths, paths[1:]))


def test_nulls_repeats_lost_and_new_rows(spark, rows):
    new = [r for r in rows if r[0] not in (None, "k50")] + [("k9x", 1, None)]
    new.remove(("k1", 1, "bb"))  # one of three equal rows
    assert differences(spark, rows, new)[1] == {None: "removed", "k50": "removed", "k9x": "added", "k1": "changed"}
    assert differences(spark, [("a", 1, None)], [("a", 1, "")])[1] == {"a": "changed"}
    assert differences(spark, [("a", 1, "1")], [("a", 11, "")])[1] == {"a": "changed"}


def test_equal_and_empty_tables(spark, rows):
    assert differences(spark, rows, list(reversed(rows))) == ({}, {})
    assert differences(spark, [], []) == ({}, {})
    ranges, keys = differences(spark, [], [("a", 1, "x")])
    assert keys == {"a": "added"} and set(ranges.values()) == {(0, 1)}


@pytest.mark.parametrize("share", [0.0, 0.05, 0.4, 1.0])
def test_frequent_values_equal_counts(spark, rows, share):
    got = Q.frequent_values(table(spark, rows), ["n"], "v", share).collect()
    for n in {r[1] for r in rows}:
        c = Counter("None" if v is None else v for _, m, v in rows if m == n)
        top = {v: k for v, k in c.items() if k >= share * sum(c.values())}
        mine = [r for r in got if r.n == n]
        assert {r.value: r.rows for r in mine if r.kept} == top
        rest = [(r.rows, r.distinct_values) for r in mine if not r.kept]
        assert rest == ([(sum(c.values()) - sum(top.values()), len(c) - len(top))] if len(c) > len(top) else [])


def test_logit_audit_leaves_out_odd_numbers(spark):
    ps = [0.2, 0.5, 0.9, 0.0, 1.0, None, float("nan"), float("inf"), 1.5]
    df = spark.createDataFrame([(2001, p) for p in ps] + [(1999, 0.25), (1998, None)], "year int, p double")
    got = {r.year: r for r in Q.extrapolation_audit(df, "year", F.col("p"), 2000).collect()}
    logits = [math.log(p / (1 - p)) for p in (0.2, 0.5, 0.9)]
    assert set(got) == {1999, 2001} and got[2001].rows == 3 and got[2001]["mean"] == pytest.approx(sum(logits) / 3)
    assert (got[1999].extrapolation, got[2001].extrapolation) == (True, False)
    assert got[1999]["std"] is None and got[1999].p01 == got[1999].p99 == pytest.approx(math.log(1 / 3))


def test_leakage_samples_keep_the_first_of_each_kind(spark):
    d = [date(2001, 1, i) for i in range(1, 6)]
    rows = [("s", f"e{i}", i, d[2], i if kind == "same" else 99, {"same": d[2], "day": d[2], "late": d[4], "ok": d[0], "none": None}[kind])
            for i, kind in enumerate(["same", "day", "late", "ok", "none"] * 4)]
    df = spark.createDataFrame(rows, "store string, entry string, contest int, day date, source_contest int, source_day date")
    got = H.leakage_samples(df, "entry", "contest", "day", 2).collect()
    assert sorted((r.status, r.sample, r.entry) for r in got) == [
        ("future", 1, "e12"), ("future", 2, "e17"), ("same_contest", 1, "e0"), ("same_contest", 2, "e10"), ("same_day", 1, "e1"), ("same_day", 2, "e11")]


def test_joined_sample_flags_and_relations(spark):
    e = spark.createDataFrame([(1, "a", 2.0), (1, "b", 20.0), (2, "c", None), (3, "d", 5.0), (None, "e", 5.0)], "c int, id string, o double")
    q = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 1.0), ("d", 50.0), ("e", 7.0), ("z", 1.0)], "id string, q double")
    k = spark.createDataFrame([(1, "x"), (3, "y")], "c int, name string")
    got = I.joined_sample(e, [F.col("id")], 5, {"contest": (k, ["c"]), "quote": (q, ["id"])}).withColumn("rel", I.quote_relation(F.col("o"), F.col("q")))
    assert {r.id: (r.joined_contest, r.joined_quote, r.rel) for r in got.collect()} == {
        "a": (1, 1, "same"), "b": (1, 1, "first_10x"), "c": (0, 1, "missing_or_zero"), "d": (1, 1, "second_10x"), "e": (0, 1, "different")}
    assert I.joined_sample(e.filter("false"), [F.col("id")], 5, {"quote": (q, ["id"])}).count() == 0
