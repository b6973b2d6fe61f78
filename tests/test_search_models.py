"""Rule search against brute force; fits against NumPy; folds and calibration use prior years only."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import folds as FO
from pitpanel.operators import grouped as G
from pitpanel.operators import models as MO
from pitpanel.operators import search as S
from tests.test_ordered import risk

DIMS = [S.Dim("rank", "rank", "<=", (1, 2, 3)), S.Dim("ev", "ev", ">=", (0.8, 1.0, 1.2)), S.Dim("odds", "odds", "band", ((1.0, 9.0), (1.0, 2.0), (1.5, 4.0)))]


@pytest.fixture(scope="module")
def bets(spark):
    rng = random.Random(11)
    data = [(rng.choice("AB") if i % 3 else "A", i, rng.randrange(1, 5), round(rng.uniform(0.6, 1.5), 3), round(rng.uniform(1, 5), 1), rng.choice([0, 0, 180, 260])) for i in range(900)]
    return spark.createDataFrame(data, "g string, id int, rank int, ev double, odds double, pay int").cache(), data


def brute(data):
    out = {}
    loose = [(3, 2, 1), (0.8, 1.0, 1.2), ((1.0, 9.0), (1.0, 2.0), (1.5, 4.0))]
    for (i, r), (j, e), (k, o) in itertools.product(*[list(enumerate(v)) for v in loose]):
        for g in "AB":
            hit = [x for x in data if x[0] == g and x[2] <= r and x[3] >= e and o[0] <= x[4] < o[1]]
            if hit:
                out[g, f"{i}-{j}-{k}"] = [x for x in sorted(hit, key=lambda x: x[1])]
    return out


def test_rule_grid_and_exact_best(bets):
    df, data = bets
    want = brute(data)
    got = {(r.g, r.rule_id): (r.bets, r["return"], r.hits) for r in S.rule_grid(df, ["g"], DIMS, "pay").collect()}
    assert got == {k: (len(v), sum(x[5] for x in v), sum(x[5] > 0 for x in v)) for k, v in want.items()}

    def score(v):
        roi = 100.0 * sum(x[5] for x in v) / (100 * len(v))
        return (1_000_000 if roi >= 90 else 0) + roi * 1000 + min(len(v), 5000) - 0.01 * risk([x[5] for x in v])[0]

    best = S.best_rules(df, ["g"], DIMS, [F.col("id")], "pay", 20, 4).collect()
    for g in "AB":
        ranked = sorted(((score(v), k[1]) for k, v in want.items() if k[0] == g and len(v) >= 20), key=lambda t: (-t[0], t[1]))[:4]
        mine = sorted((r for r in best if r.g == g), key=lambda r: r.selected_order)
        assert [r.rule_id for r in mine] == [k for _, k in ranked]
        assert [r.score for r in mine] == pytest.approx([s for s, _ in ranked])


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_drawdown_bounds_hold_and_narrow(bets, slices):
    df, data = bets
    want = brute(data)
    grid = S.bounded_grid(S.grid_slices(df, ["g"], DIMS, [F.col("id")], "pay", slices), ["g"], DIMS).collect()
    assert {(r.g, r.rule_id): (r.bets, r["return"], r.hits) for r in grid} == {k: (len(v), sum(x[5] for x in v), sum(x[5] > 0 for x in v)) for k, v in want.items()}
    for r in grid:
        exact = risk([x[5] for x in want[r.g, r.rule_id]])[0]
        assert r.dd_low <= exact <= r.dd_up
    open_ = S.finalists(S.bounded_grid(S.grid_slices(df, ["g"], DIMS, [F.col("id")], "pay", slices), ["g"], DIMS, 20), ["g"], 1).collect()
    assert len(open_) <= {1: len(grid), 3: len(grid) // 2, 16: len(grid) // 4}[slices]
    sets = {(r.g, r.rule_id): [x[1] for x in want[r.g, r.rule_id]] for r in open_}
    assert all(sets[r.g, r.rule_id] == sets[r.g, r.same_as] for r in open_)


def test_best_rules_of_equal_rules_one_group_and_empty_tables(bets):
    df, data = bets
    twice = [S.Dim("a", "rank", "<=", (3, 2)), S.Dim("b", "rank", "<=", (5, 4))]  # both values of b hold for every row
    for slices in (1, 5):
        got = S.best_rules(df, [], twice, [F.col("id")], "pay", 1, 4, slices).orderBy("selected_order").collect()
        assert sorted(r.rule_id for r in got) == ["0-0", "0-1", "1-0", "1-1"]
        assert got[0].rule_id[0] == got[1].rule_id[0] and got[0].rule_id[2] == "0" and got[0].score == got[1].score
        for r in got:
            rows = [x[5] for x in data if x[2] <= (3, 2)[int(r.rule_id[0])]]
            assert (r.max_drawdown, r.max_losing_streak) == risk(rows)
    assert S.best_rules(df.filter("false"), ["g"], DIMS, [F.col("id")], "pay", 1, 4).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.01])
def test_jaccard_pruning_equals_set_loop(bets, threshold):
    df, data = bets
    rules = S.rule_grid(df, [], DIMS, "pay", 50)
    ids = [r[0] for r in rules.orderBy(F.col("bets").desc(), "rule_id").select("rule_id").collect()]
    sets = {}
    for (g, rid), v in brute(data).items():
        sets.setdefault(rid, set()).update(x[1] for x in v)
    kept = []
    for rid in ids:
        if not any(len(sets[rid] & sets[k]) / len(sets[rid] | sets[k]) >= threshold for k in kept):
            kept.append(rid)
    got = S.greedy_prune(rules, S.rule_overlap(df, DIMS, rules), [-F.col("bets"), F.col("rule_id")], threshold)
    assert sorted(r.rule_id for r in got.collect()) == sorted(kept) and got.columns == rules.columns


def test_odd_numbers_meet_no_threshold(spark):
    rows = [(1, float("nan"), 2.0, 200), (2, float("inf"), 2.0, 200), (3, 1.1, 2.0, 200), (4, 0.5, 2.0, 0), (5, None, 2.0, 0), (6, float("-inf"), 2.0, 0)]
    df = spark.createDataFrame(rows, "id int, ev double, odds double, pay int")
    assert {r.threshold: r.bets for r in S.threshold_grid(df, [], "id", F.col("ev"), [0.4, 0.9, 1.0], "pay").collect()} == {0.4: 2, 0.9: 1, 1.0: 1}
    grid = S.rule_grid(df, [], [S.Dim("low", "ev", ">=", (0.4, 1.0)), S.Dim("high", "ev", "<=", (2.0, 0.9))], "pay")
    assert {r.rule_id: r.bets for r in grid.collect()} == {"0-0": 2, "0-1": 1, "1-0": 1}
    picked = S.select_alpha(df.withColumns({"p": F.col("ev") / 2, "q": F.lit(0.0)}), "p", "q", "odds", "pay", [1.0], 1.0)
    assert picked.first().bets == 1


def test_fold_windows_end_before_validation():
    f = FO.fold_window("r", "rolling", 2006, 2020, 10)
    assert (f.train_start, f.train_end) == (2010, 2019)
    assert FO.fold_window("e", "expanding", 2006, 2020).train_start == 2006
    with pytest.raises(ValueError):
        FO.fold_window("x", "expanding", 2020, 2020)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    n = 1500
    p = np.round(rng.uniform(0.05, 0.95, n), 3)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.7 * np.log(p / (1 - p)) - 0.2)))).astype(int)
    year = rng.integers(2016, 2020, n)
    x = rng.normal(size=n)
    rows = [(int(i), int(year[i]), float(p[i]), int(y[i]), None if i % 50 == 0 else float(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, year int, p double, y int, x double").cache(), p, y, x, year


def newton(z, y, offset=0.0, iters=30):
    X = np.column_stack([np.ones(len(y)), z])
    b = np.zeros(X.shape[1])
    for _ in range(iters):
        m = 1 / (1 + np.exp(-(X @ b + offset)))
        b += np.linalg.solve((X * (m * (1 - m))[:, None]).T @ X, X.T @ (y - m))
    return b


def one_fit(df, method, spark, slices=None):
    """Calibrator row of one fit on all rows, and the scores under it."""
    hist = G.histogram(df, F.lit("all"), "y", "p")
    m = G.members(spark, {"all": ["all"]}, "string")
    c = G.calibrators(hist, m, (method,), slices=slices)
    return c.first(), {r.p: r.calibrated for r in G.scored_histogram(hist, m, c).collect()}


def test_platt_equals_newton(panel, spark):
    df, p, y, _, _ = panel
    c, _ = one_fit(df, "platt_logit", spark)
    b = newton(np.log(p / (1 - p)), y)
    assert c.b_0 == pytest.approx(b[0], abs=1e-7) and c.b_2 == pytest.approx(b[1], abs=1e-7)
    c, got = one_fit(df, "platt_p", spark)
    b = newton(p, y)
    assert c.b_0 == pytest.approx(b[0], abs=1e-7) and c.b_1 == pytest.approx(b[1], abs=1e-7)
    assert all(got[v] == pytest.approx(1 / (1 + np.exp(-b[0] - b[1] * v)), abs=1e-7) for v in p)


def pav(p, y):
    order = np.argsort(p, kind="stable")
    blocks = []
    for v in np.unique(p):
        m = p == v
        blocks.append([y[m].mean(), m.sum(), [v]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
    assert len(order)
    return {v: b[0] for b in blocks for v in b[2]}


@pytest.mark.parametrize("size,merged,runs", [(4000, 16, 3), (7, 2, 0), (50, 3, 1)])
def test_isotonic_equals_pool_adjacent_violators(panel, spark, monkeypatch, size, merged, runs):
    """Also with many small slices, so that pools are merged over several levels."""
    df, p, y, _, _ = panel
    monkeypatch.setattr(G, "MERGED", merged)
    monkeypatch.setattr(G, "RUNS", runs)
    points = G.histogram(df, F.lit("all"), "y", "p").withColumnRenamed("part", "fit")
    r = G.isotonic(points, size=size).first()
    want = pav(p, y)
    pools = sorted({round(v, 12) for v in want.values()})
    assert len(r.value) == len(pools) and r.value == pytest.approx(pools)
    assert all(abs(want[v] - r.value[i]) < 1e-12 for i, (a, b) in enumerate(zip(r.lo, r.hi)) for v in want if a <= v <= b)


def test_isotonic_values_between_and_outside_pools(spark):
    """Scores the fit has not seen: linear between pools, constant inside and outside."""
    rows = [("train", 0.2, 0), ("train", 0.3, 1), ("train", 0.4, 0), ("train", 0.6, 1)] + [("own", q, 0) for q in (0.1, 0.2, 0.35, 0.4, 0.45, 0.5, 0.6, 0.9)]
    df = spark.createDataFrame(rows, "part string, p double, y int")
    hist = G.histogram(df, F.col("part"), "y", "p")
    c = G.calibrators(hist, G.members(spark, {"f": ["train"]}, "string"), ("isotonic",))
    got = {r.p: r.calibrated for r in G.scored_histogram(hist, G.members(spark, {"f": ["own"]}, "string"), c).collect()}
    want = {0.1: 1e-6, 0.2: 1e-6, 0.35: 0.5, 0.4: 0.5, 0.45: 0.625, 0.5: 0.75, 0.6: 1 - 1e-6, 0.9: 1 - 1e-6}
    assert got == pytest.approx(want)


def test_temperature_near_optimum(panel, spark):
    df, p, y, _, _ = panel
    c, got = one_fit(df, "temperature", spark)

    def loss(s):
        q = 1 / (1 + np.exp(-np.log(p / (1 - p)) / s))
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    assert loss(1 / c.b_2) <= min(loss(s) for s in np.linspace(0.3, 3.9, 4000)) + 1e-12
    assert all(got[v] == pytest.approx(1 / (1 + np.exp(-c.b_2 * np.log(v / (1 - v))))) for v in p)


def test_walk_forward_and_leave_one_out_use_the_right_years(panel):
    df, p, y, _, year = panel
    hist = G.histogram(df, F.col("year"), "y", "p").cache()
    for rows, used in ((G.walk_forward(hist, ("platt_logit",)), lambda a, b: a < b), (G.leave_one_out(hist, ("platt_logit",)), lambda a, b: a != b)):
        found = rows.collect()
        years = sorted({r.part for r in found})
        assert years == ([2017, 2018, 2019] if used(1, 1) or not used(2, 1) else [2016, 2017, 2018, 2019])
        for own in years:
            m = used(year, own)
            b = newton(np.log(p[m] / (1 - p[m])), y[m])
            for r in (r for r in found if r.part == own):
                assert r.calibrated == pytest.approx(1 / (1 + np.exp(-b[0] - b[1] * np.log(r.p / (1 - r.p)))), abs=1e-7)
            assert sum(r.n for r in found if r.part == own) == int((year == own).sum())


def test_choices_rank_by_the_stated_metrics(spark):
    rows = [(1, "a", 0.5, 0.2, 0.01, 0.1), (2, "a", 0.7, 0.2, 0.05, 0.1), (1, "b", 0.6, 0.2, 0.02, 0.3), (2, "b", 0.6, 0.2, 0.03, 0.2), (1, "c", 0.61, 0.1, 0.0, 0.1), (2, "c", 0.61, 0.1, 0.0, 0.1)]
    t = spark.createDataFrame(rows, "part int, method string, logloss double, brier double, ece double, mce double")
    assert [r.method for r in G.leave_one_out_choice(t).filter("selected").collect()] == ["b"]  # equal means, smaller worst ECE
    assert [r.method for r in G.forward_choice(t).filter("selected").collect()] == ["c"]


def test_fits_in_a_table_equal_fits_in_the_driver(panel, spark, monkeypatch):
    df, p, y, x, year = panel
    d = df.withColumns({"o": F.lit(0.1), "w": 1.0 + F.col("id") % 3})
    fits = G.members(spark, {"early": [2016, 2017], "late": [2018, 2019], "all": [2016, 2017, 2018, 2019], "none": [1900]})
    names = fits.select("fit").distinct()
    spec = G.plain_spec(names, ("x", "p"), {"x": F.when(F.col("fit") == "late", 0.0).otherwise(1.0)}, F.lit(1e-4))

    def fitted():
        return {r.fit: (r.b_0, r.b_1, r.b_2) for r in G.newton(d, fits, spec, ("x", "p"), "y", offset="o", weight="w", part="year").collect()}

    one = fitted()
    monkeypatch.setattr(G, "LISTED", 0)
    two = fitted()
    assert set(one) == set(two) == {"early", "late", "all", "none"} and one["none"] == (0.0, 0.0, 0.0) and one["late"][1] == 0.0
    for f in one:
        assert one[f] == pytest.approx(two[f], abs=1e-6)
    m = year > 2015
    w = 1.0 + np.arange(len(y)) % 3
    X = np.column_stack([np.ones(len(y)), np.where(np.arange(len(x)) % 50 == 0, 0.0, x), p])
    q = 1 / (1 + np.exp(-(X @ np.array(one["all"]) + 0.1)))
    assert np.abs((X * (w * (y - q))[:, None]).sum(axis=0) / w.sum() - np.array([0, 1e-4, 1e-4]) * one["all"])[m[:3]].max() < 1e-7


def test_offset_model_identity_and_fit(panel):
    df, p, y, x, _ = panel
    d = df.withColumn("offset", F.log(F.col("p") / (1 - F.col("p"))))
    m = MO.fit_offset(d, ["x"], "y", "offset", reg=0.0)
    xx = np.where(np.arange(len(x)) % 50 == 0, 0.0, x)
    b = newton(xx, y, np.log(p / (1 - p)))
    assert m.intercept == pytest.approx(b[0], abs=1e-4) and m.coefficients["x"] == pytest.approx(b[1], abs=1e-4)
    out = MO.apply_offset(d, m, "offset")
    assert out.agg(F.max(F.abs(F.col("final_logit") - F.col("offset") - F.col("residual")))).first()[0] < 1e-12


def test_baseline_imputes_and_scales(panel, spark):
    df, p, y, x, year = panel
    fits = {"early": [2016, 2017], "all": [2016, 2017, 2018, 2019]}
    got = {r.fit: r for r in G.baselines(df, G.members(spark, fits), ["x", "p"], "y", c=1e9, part="year").collect()}
    for f, years in fits.items():
        m = np.isin(year, years)
        seen = m & (np.arange(len(x)) % 50 != 0)
        med = np.median(x[seen])
        xx = np.where(np.arange(len(x)) % 50 == 0, med, x)[m]
        Z = np.column_stack([(xx - xx.mean()) / xx.std(), (p[m] - p[m].mean()) / p[m].std()])
        w = newton(Z, y[m])
        assert got[f].fill_1 == pytest.approx(med)
        assert [got[f].b_0, got[f].b_1, got[f].b_2] == pytest.approx(list(w), abs=1e-6)


def test_parity_gate_fails_on_any_difference(spark):
    a = spark.createDataFrame([("c", "1", 1, .5), ("c", "2", 0, .5)], "c string, e string, y int, p double")
    assert MO.parity_gate(a, a, ["c", "e"], "y", "p", 1e-9).first().passed
    assert not MO.parity_gate(a, a.filter("e = '1'"), ["c", "e"], "y", "p", 1e-9).first().passed
    assert not MO.parity_gate(a, a.unionAll(a.filter("e = '1'")), ["c", "e"], "y", "p", 1e-9).first().passed


def test_fit_survives_extreme_scores(spark):
    """Scores of 0 and 1 make plain reweighted least squares diverge; the damped fit must not."""
    rng = np.random.default_rng(2)
    p = np.where(rng.uniform(size=800) < 0.3, 1.0, rng.uniform(0.01, 0.99, 800).round(2))
    y = (rng.uniform(size=800) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    c, _ = one_fit(df, "platt_logit", spark)
    z = np.clip(p, 1e-6, 1 - 1e-6)
    z = np.log(z / (1 - z))
    m = 1 / (1 + np.exp(-(c.b_0 + c.b_2 * z)))
    assert abs(np.sum(y - m)) < 1e-4 and abs(np.sum((y - m) * z)) < 1e-3


def test_classifier_grid_equals_single_fits_and_knows_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((("train", "test")[i % 4 == 3], a if i % 9 else None, float("nan") if i % 11 == 0 else b, int(rng.random() < 1 / (1 + np.exp(-a))), int(b > 0.3) if i % 5 else None))
    df = spark.createDataFrame(rows, "split string, a double, b double, y int, z int")
    got = {(r.target, r.feature_set, r.split): r for r in MO.classifier_grid(df, {"y": "y", "z": "z"}, {"a": ["a"], "both": ["a", "b"]}, "split", "train").collect()}
    assert set(got) == {(t, s, p) for t in "yz" for s in ("a", "both") for p in ("train", "test")}

    def single(y, columns):
        d = [(p, [np.nan if v is None else v for v in v4], t) for p, *v4, t in [(r[0], *[r[{"a": 1, "b": 2}[c]] for c in columns], r[y]) for r in rows] if t is not None]
        x, t, train = np.array([v for _, v, _ in d], float), np.array([t for *_, t in d], float), np.array([p == "train" for p, *_ in d])
        x = np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)
        x = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
        x, b, n = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1), train.sum()
        ridge = np.array([0.0] + [1.0 / n] * len(columns))
        for _ in range(40):
            mu = 1 / (1 + np.exp(-x[train] @ b))
            b = b + np.linalg.solve((x[train] * (mu * (1 - mu))[:, None]).T @ x[train] / n + np.diag(ridge), x[train].T @ (t[train] - mu) / n - ridge * b)
        q = np.clip(1 / (1 + np.exp(-x @ b)), 1e-6, 1 - 1e-6)
        loss = -(t * np.log(q) + (1 - t) * np.log(1 - q))
        return {"train": loss[train].mean(), "test": loss[~train].mean()}

    for t, y in (("y", 3), ("z", 4)):
        for s, columns in (("a", ["a"]), ("both", ["a", "b"])):
            for part, want in single(y, columns).items():
                assert got[t, s, part].logloss == pytest.approx(want, abs=1e-6)
    assert got["z", "a", "train"].rows == sum(1 for r in rows if r[0] == "train" and r[4] is not None)
    assert MO.classifier_grid(df.filter("false"), {"y": "y"}, {"a": ["a"]}, "split", "train").count() == 0
