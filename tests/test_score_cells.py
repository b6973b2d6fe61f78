"""Calibrators by cells of the score axis give the pools and coefficients of the exact scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import grouped as G
from tests.sessions import session


@pytest.fixture(scope="module")
def spark():
    return session()


@pytest.fixture(scope="module")
def hist(spark):
    """12,000 scores of three years, most of them distinct, some crowded in one cell, some equal to one; labels hardly rise with the score."""
    r = np.random.default_rng(5)
    n = 12_000
    p = np.where(np.arange(n) % 10 == 0, 0.3 + r.random(n) * 1e-5, r.random(n))
    p[::97] = 1.0
    y = r.random(n) < 0.3 + 0.1 * (p > 0.6)
    rows = [(int(1998 + i % 3), float(p[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "year int, p double, label int")
    return G.materialise(G.histogram(df, F.col("year"), "label", "p"), "scores")


def fitted(hist, m):
    return {(r.fit, r.method): r for r in G.calibrators(hist, m).collect()}


def test_cells_change_no_pool_and_no_coefficient(hist, monkeypatch):
    m = G.materialise(G.complement_members(hist.select("part").distinct()), "members")
    plain = fitted(hist, m)
    monkeypatch.setattr(G, "FEW", 0)
    for cells in (1, 8, 64):
        monkeypatch.setattr(G, "CELLS", cells)
        got = fitted(hist, m)
        assert set(got) == set(plain) and len(got) == 15
        for k, want in plain.items():
            assert (got[k].b_0, got[k].b_1, got[k].b_2) == pytest.approx((want.b_0, want.b_1, want.b_2), abs=1e-6)
            assert got[k].lo == want.lo and got[k].hi == want.hi and got[k].value == pytest.approx(want.value)


def test_isotonic_fits_leave_most_scores_in_cells(hist, monkeypatch):
    monkeypatch.setattr(G, "FEW", 0)
    m = G.materialise(G.complement_members(hist.select("part").distinct()), "members")
    celled = G.with_cells(hist)
    sums = G.cell_sums(celled, 1e-6)
    monkeypatch.setattr(G, "CELLS", 8)
    points = G.isotonic_points(hist, celled, sums, m)
    each = m.join(hist, "part")
    assert points.count() < 0.75 * each.count()
    totals = [d.groupBy("fit").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("fit").collect() for d in (points, each)]
    assert totals[0] == totals[1]  # no row and no positive is lost


def test_exact_scores_are_read_in_few_rounds(hist, spark, monkeypatch):
    """Newton's rounds on the exact scores start from the fit on the cells."""
    monkeypatch.setattr(G, "FEW", 0)
    exact, whole = [], G.label_rows(hist, F.col("p"), F.col("p")).count()
    evaluated = G.evaluated
    monkeypatch.setattr(G, "evaluated", lambda rows, *a: (exact.append(1) if rows.count() == whole else None, evaluated(rows, *a))[1])
    G.calibrators(hist, G.forward_members(hist.select("part").distinct()), ("platt_p", "platt_logit", "temperature"))
    assert 1 <= len(exact) <= 2


def test_many_points_of_one_fit_are_numbered_in_slices(hist, monkeypatch):
    seen, row_numbers = [], G.row_numbers
    monkeypatch.setattr(G, "row_numbers", lambda *a: (seen.append(a[4]), row_numbers(*a))[1])
    points = hist.filter("part = 1998").withColumn("fit", F.lit("one"))
    want = G.isotonic(points, size=50).first()
    monkeypatch.setattr(G, "SLICED", 100)
    got = G.isotonic(points, size=50).first()
    assert seen[0] is None and seen[1] >= points.count() / 100
    assert (got.lo, got.hi) == (want.lo, want.hi) and got.value == pytest.approx(want.value)
