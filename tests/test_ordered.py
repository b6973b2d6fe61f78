"""Skew-proof primitives against plain computations; one group holds more than a third of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.functions import ordered as O
from pitpanel.operators import backtest as K
from pitpanel.operators import contest as C
from pitpanel.operators import quality as Q


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(30)}" if rng.random() < 0.97 else None, i, float(rng.randrange(40)) if rng.random() < 0.95 else None,
             rng.choice([0, 0, 0, 150, 420])) for i in range(3000)]
    return spark.createDataFrame(data, "g string, id int, v double, pay int").cache(), data


def groups(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("slices", [None, 2, 7, 40])
def test_running_and_row_numbers(rows, slices):
    df, data = rows
    got = {r.id: (r.s, r.n) for r in O.running(O.row_numbers(df, ["g"], [-F.col("pay"), F.col("id")], "n", slices), ["g"], [F.col("id")], {"s": F.col("pay")}, slices).collect()}
    for part in groups(data).values():
        total = 0
        place = {r[1]: i + 1 for i, r in enumerate(sorted(part, key=lambda r: (-r[3], r[1])))}
        for r in sorted(part, key=lambda r: r[1]):
            total += r[3]
            assert got[r[1]] == (total, place[r[1]])


@pytest.mark.parametrize("slices", [None, 6])
def test_average_ranks_and_quantiles(rows, slices):
    df, data = rows
    got = {r.id: r.k for r in O.average_ranks(df, ["g"], "v", "k", slices).collect()}
    qs = {r.g: (r.q0, r.q1) for r in O.quantiles(df, ["g"], "v", [0.5, 0.93], slices).collect()}
    for g, part in groups(data).items():
        vals = [r[2] for r in part if r[2] is not None]
        for r in part:
            want = None if r[2] is None else sum(v < r[2] for v in vals) + (sum(v == r[2] for v in vals) + 1) / 2
            assert got[r[1]] == want
        assert np.allclose(qs[g], np.quantile(vals, [0.5, 0.93]))


def risk(pays):
    eq, peak, dd, cur, best = 0, 0, 0, 0, 0
    for p in pays:
        eq += p - 100
        peak = max(peak, eq)
        dd = max(dd, peak - eq)
        cur = 0 if p > 0 else cur + 1
        best = max(best, cur)
    return dd, best


@pytest.mark.parametrize("slices", [None, 3, 25])
def test_drawdown_and_streak(rows, slices):
    df, data = rows
    got = {r.g: (r.max_drawdown, r.max_losing_streak) for r in K.ordered_risk(df, ["g"], [F.col("id")], "pay", slices=slices).collect()}
    for g, part in groups(data).items():
        assert got[g] == risk([r[3] for r in sorted(part, key=lambda r: r[1])])


def test_drawdown_all_losing(spark):
    df = spark.createDataFrame([("a", i, 0) for i in range(50)] + [("b", i, 500) for i in range(50)], "g string, id int, pay int")
    got = {r.g: (r.max_drawdown, r.max_losing_streak) for r in K.ordered_risk(df, ["g"], [F.col("id")], "pay", slices=9).collect()}
    assert got == {"a": (5000, 50), "b": (0, 0)}


@pytest.mark.parametrize("slices", [None, 5])
def test_bins_and_nearest_rank(rows, slices):
    df, data = rows
    d = df.filter("v is not null")
    vals = sorted((r[2], r[1]) for r in data if r[2] is not None)
    n = len(vals)
    got = {r.id: r.bin for r in C.rank_bins(d, "v", "id", 7, slices).collect()}
    assert all(got[i] == k * 7 // n for k, (_, i) in enumerate(vals))
    distinct = sorted({v for v, _ in vals})
    want = {v: b for b, part in enumerate(np.array_split(distinct, 9)) for v in part}
    assert all(r.bin == want[r.v] for r in C.value_bins(d, "v", 9, slices).collect())
    near = Q.nearest_rank(d.withColumn("x", F.lit(1)), ["x"], "v", (0.95,), slices).first().q0
    assert near == vals[int(round((n - 1) * 0.95))][0]


def test_concentration_matches_sort(rows):
    df, data = rows
    for base in ("all", "winning"):
        got = {r.g: r.top_q_share for r in K.profit_concentration(df, ["g"], "id", "pay", 0.05, base, slices=4).collect()}
        for g, part in groups(data).items():
            gains = sorted((max(r[3] - 100, 0) for r in part), reverse=True)
            n = len(gains) if base == "all" else sum(x > 0 for x in gains)
            if sum(gains):
                assert got[g] == pytest.approx(sum(gains[: max(1, int(np.ceil(n * 0.05 - 1e-12)))]) / sum(gains))


@pytest.mark.parametrize("split", [False, True])
def test_balanced_group_join(rows, split):
    df, data = rows
    out = O.with_group(df, ["g"], split, 50, total=F.sum("pay"), top=F.max("v"))
    want = {g: (sum(r[3] for r in p), max(r[2] for r in p if r[2] is not None)) for g, p in groups(data).items()}
    got = out.collect()
    assert len(got) == len(data) and all((r.total, r.top) == want[r.g] for r in got)
    if split:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 8, 1000])
def test_slices_follow_the_order(rows, n):
    df, _ = rows
    cut = O.with_slices(df, ["g"], [F.col("v"), F.col("id")], n).orderBy("g", "v", "id").collect()
    numbers = [r["_slice"] for r in cut]
    assert numbers == sorted(numbers) and numbers[0] == 0 and numbers[-1] < n
    assert n == 1 or len(set(numbers)) > n // 2


def test_null_keys_without_statistics_are_spread(rows):
    df, data = rows
    stats = df.filter("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("pay").alias("top"))
    out = O.join_stats(df, stats, ["g"], ["top"], "n", split=True, hot_rows=100, nulls_match=False)
    want = {k: max(r[3] for r in part) for k, part in groups(data).items() if k is not None}
    assert sorted((r.id, r.top) for r in out.collect()) == [(r[1], want.get(r[0])) for r in data]
