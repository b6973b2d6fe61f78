"""Many fits at once: logistic regressions by one grouped Newton step per round, isotonic steps by merged pools.

A *fit* is a name with the parts of the rows (years, splits, any key) that it is trained on; ``members`` lists them as
(fit, part).  One round is one aggregate of loss, gradient and Hessian per fit, whatever the number of fits; the state of a
fit (coefficients, step, loss) is a handful of numbers.  Up to LISTED members of fits keep it in the driver; beyond, it is a
table whose linear systems are solved by column arithmetic, and the driver only asks whether a fit is still open.

Isotonic regression pools the sorted scores of a slice of ``SLICE`` scores, and the pools of neighbouring slices in turn.
Pools of a slice are the lower convex hull of the running (weight, label sum), hulls merge, and a hull over N unit steps
has O(N ** (2/3)) corners, so what meets in one row stays small.

Calibrators of many scores go by *cells*, equal parts of the score axis whose number grows with the square root of the
scores.  Cells only save work.  Newton's method starts from the fit on the means of the cells and ends on the exact scores as
before.  Isotonic fits take a cell as one point where no score inside it can be a corner of the hull, and score by score elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import attach_row, row_numbers, running
from pitpanel.sources.workdir import materialise

EPS = 1e-6
SLICE = 4000  # scores of a slice
RUNS = 3  # passes that merge falling runs before the hull of a slice is taken
MERGED = 16  # neighbouring slices that are merged at a time
LISTED = 2000  # members of fits whose state may be in the driver (a few numbers each); more of them have a table
WRITTEN = 4  # rounds of a fit in one plan
FEW = 200_000  # scores of a histogram that is read as it is, without cells
CELLS = 64  # cells for each unit of the square root of the scores
SLICED = 500_000  # scores of a slice whose positions one task numbers
METHODS = ("identity", "platt_p", "platt_logit", "isotonic", "temperature")
#: which of (intercept, p, logit p) a method's line uses; a temperature is a line through the origin of the logits
LINES = {"platt_p": (1.0, 1.0, 0.0), "platt_logit": (1.0, 0.0, 1.0), "temperature": (0.0, 0.0, 1.0)}


# ---- members ----

def members(spark: SparkSession, fits: Mapping[str, Sequence[int | str]], kind: str = "int") -> DataFrame:
    """(fit, part) of named part lists (a configuration, not data)."""
    return spark.createDataFrame([(f, p) for f, parts in fits.items() for p in parts], f"fit string, part {kind}")


def part_pairs(parts: DataFrame, keep: Callable[[Column, Column], Column], prefix: str) -> DataFrame:
    """(fit, own, part): for every distinct part the parts its fit is trained on."""
    every = parts.agg(F.sort_array(F.collect_set("part")).alias("_ps"))
    own = every.select("_ps", F.explode("_ps").alias("own"))
    return own.select(F.concat(F.lit(prefix), F.col("own").cast("string")).alias("fit"), "own", F.explode(F.filter("_ps", lambda x: keep(x, F.col("own")))).alias("part"))


def forward_members(parts: DataFrame, prefix: str = "before-") -> DataFrame:
    """Each part but the first is fitted on all parts before it."""
    return part_pairs(parts, lambda x, own: x < own, prefix)


def complement_members(parts: DataFrame, prefix: str = "without-") -> DataFrame:
    """Each part is fitted on all other parts."""
    return part_pairs(parts, lambda x, own: x != own, prefix)


# ---- logistic fits ----

def plain_spec(fits: DataFrame, features: Sequence[str], use: Mapping[str, Column] | None = None, ridge: Column | None = None) -> DataFrame:
    """Fits with all features, no filling, no scaling; ``use`` gives 1 or 0 by feature ("" is the intercept)."""
    use = use or {}
    out = fits.select("*", use.get("", F.lit(1.0)).cast("double").alias("use_0"), (F.lit(0.0) if ridge is None else ridge).cast("double").alias("ridge"))
    for i, f in enumerate(features, 1):
        out = out.withColumns({f"use_{i}": use.get(f, F.lit(1.0)).cast("double"), f"fill_{i}": F.lit(0.0), f"mean_{i}": F.lit(0.0), f"scale_{i}": F.lit(1.0)})
    return out


def standardised(features: Sequence[str], i: int) -> str:
    """Feature ``i`` of a row joined to a fit: missing values filled, then centred and scaled as the fit says."""
    return f"(coalesce(cast({features[i - 1]} AS double), fill_{i}) - mean_{i}) / scale_{i}"


def sum_of(terms: Sequence[str], first: str = "") -> str:
    return " + ".join([first] * bool(first) + list(terms))


def solved(state: DataFrame, k: int) -> DataFrame:
    """Columns n_0..n_k with hess * n = grad, by Cholesky; directions without curvature get no step."""
    for j in range(k + 1):
        pivot = f"h_{j}_{j}" + "".join(f" - l_{j}_{m} * l_{j}_{m}" for m in range(j))
        state = state.selectExpr("*", f"{pivot} AS p_{j}").selectExpr("*", f"CASE WHEN p_{j} > 1e-13D THEN 1 / sqrt(p_{j}) ELSE 0D END AS d_{j}")
        state = state.selectExpr("*", *[f"(h_{j}_{i}" + "".join(f" - l_{i}_{m} * l_{j}_{m}" for m in range(j)) + f") * d_{j} AS l_{i}_{j}" for i in range(j + 1, k + 1)])
    for j in range(k + 1):
        state = state.selectExpr("*", f"(g_{j}" + "".join(f" - l_{j}_{m} * c_{m}" for m in range(j)) + f") * d_{j} AS c_{j}")
    for j in reversed(range(k + 1)):
        state = state.selectExpr("*", f"(c_{j}" + "".join(f" - l_{m}_{j} * n_{m}" for m in range(j + 1, k + 1)) + f") * d_{j} AS n_{j}")
    return state


def newton(rows: DataFrame, members_: DataFrame, spec: DataFrame, features: Sequence[str], y: str, offset: str | None = None, weight: str | None = None,
           part: str = "part", rounds: int = 60, tol: float = 1e-7, start: DataFrame | None = None) -> DataFrame:
    """``spec`` with the coefficients b_0 (intercept), b_1, ... of every fit.

    The first trial is zero, or the b_0, b_1, ... that ``start`` has for the fit.

    Each round evaluates the open fits at their trial coefficients, keeps a trial that lowers the penalised loss and
    shortens the step of one that does not.  A fit is closed when its step is below ``tol``, when no shorter step helps, or at
    the last round; one without rows has zeros.
    """
    k = len(features)
    keep = spec.columns
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    d = rows.select(F.col(part).alias("part"), *[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("double").alias("_y"), w.alias("_w"),
                    (F.lit(0.0) if offset is None else F.col(offset)).cast("double").alias("_o"))
    d = materialise(d, "fit-rows")
    member = members_.select("fit", "part").distinct()
    known = member.join(spec.select("fit"), "fit").limit(LISTED + 1).collect()
    b = [f"b_{i}" for i in range(k + 1)]
    first = spec.select("fit", *[F.lit(0.0).alias(f"t_{i}") for i in range(k + 1)])
    if start is not None:
        near = start.select(F.col("fit").alias("_fit"), *b)
        first = spec.select("fit").join(near, F.col("fit") == F.col("_fit"), "left").select("fit", *[F.coalesce(f"b_{i}", F.lit(0.0)).alias(f"t_{i}") for i in range(k + 1)])
    found = listed(d, known, spec, features, rounds, tol, first) if len(known) <= LISTED else tabled(d, member, spec, features, rounds, tol, first)
    return spec.join(found.withColumnRenamed("fit", "_fit"), F.col("fit") == F.col("_fit"), "left").select(*keep, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in b])


def tabled(d: DataFrame, member: DataFrame, spec: DataFrame, features: Sequence[str], rounds: int, tol: float, first: DataFrame) -> DataFrame:
    """Any number of fits: their state is a table, solved by column arithmetic; WRITTEN rounds follow each other in one plan."""
    k = len(features)
    zero = {n: F.lit(0.0) for i in range(k + 1) for n in (f"b_{i}", f"s_{i}")}
    open_ = spec.join(first, "fit").withColumns(zero | {"best": F.lit(float("inf")), "step": F.lit(1.0), "closed": F.lit(False)})
    columns, done = open_.columns, None
    for at in range(0, rounds, WRITTEN):
        for _ in range(WRITTEN):
            open_ = advanced(evaluated(d, member.join(open_, "fit"), features, columns, columns), k, tol).select(*columns)
        open_ = materialise(open_, "newton")
        last = at + WRITTEN >= rounds
        closed = open_ if last else open_.filter("closed")
        done = closed if done is None else done.unionByName(closed)
        open_ = open_.filter("not closed")
        if last or open_.isEmpty():
            break
    return done.select("fit", *[f"b_{i}" for i in range(k + 1)])


def listed(d: DataFrame, known: Sequence, spec: DataFrame, features: Sequence[str], rounds: int, tol: float, first: DataFrame) -> DataFrame:
    """Few fits (at most LISTED members, counted): the same rounds with the state in the driver, one small aggregate each."""
    k, spark = len(features), d.sparkSession
    r = range(k + 1)
    numbers = [f"use_{i}" for i in r] + [f"{n}_{i}" for i in r[1:] for n in ("fill", "mean", "scale")]
    own = {x["fit"]: x for x in spec.select("fit", "ridge", *numbers).collect() if x["fit"] in {m["fit"] for m in known}}
    ridge = {f: np.array([0.0] + [x["ridge"]] * k) for f, x in own.items()}
    use = {f: np.array([x[f"use_{i}"] for i in r]) for f, x in own.items()}
    zeros = np.zeros(k + 1)
    trials = {x["fit"]: np.array([x[f"t_{i}"] for i in r]) for x in first.collect() if x["fit"] in own}
    state = {f: {"b": zeros, "t": trials[f], "s": zeros, "best": math.inf, "step": 1.0} for f in own}
    open_ = set(own)
    kind = d.schema["part"].dataType.simpleString()
    for _ in range(rounds):
        if not open_:
            break
        rows = [(m["part"], m["fit"], *[own[m["fit"]][n] for n in numbers], *map(float, state[m["fit"]]["t"])) for m in known if m["fit"] in open_]
        columns = [*numbers, *[f"t_{i}" for i in r]]
        trial = spark.createDataFrame(rows, f"part {kind}, fit string, " + ", ".join(f"{c} double" for c in columns))
        for x in evaluated(d, F.broadcast(trial), features, ["fit", *columns], ["fit"]).collect():
            f, now = x["fit"], state[x["fit"]]
            t = now["t"]
            new = x["w_l"] / x["w_n"] + 0.5 * float(np.sum(ridge[f] * t * t))
            if new <= now["best"] + 1e-12 * (1.0 + abs(now["best"])):
                grad = np.array([x[f"w_g{i}"] for i in r]) / x["w_n"] - ridge[f] * t
                hess = np.array([[x[f"w_h{min(i, j)}_{max(i, j)}"] for j in r] for i in r]) / x["w_n"] + np.diag(ridge[f] * use[f])
                step = np.linalg.lstsq(hess, grad, rcond=1e-13)[0]
                done = float(np.max(np.abs(step))) < tol
                state[f] = {"b": t + step if done else t, "t": t + step, "s": step, "best": new, "step": 1.0}
            else:
                shorter = now["step"] / 4.0
                state[f] = now | {"t": now["b"] + shorter * now["s"], "step": shorter}
                done = shorter < 1e-6
            if done:
                open_.discard(f)
        open_ &= {f for f in open_ if math.isfinite(state[f]["best"])}  # fits without rows stay at zero
    found = [(f, *map(float, now["b"])) for f, now in state.items()]
    return spark.createDataFrame(found, "fit string, " + ", ".join(f"b_{i} double" for i in r))


def evaluated(rows: DataFrame, trial: DataFrame, features: Sequence[str], columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Sums of weight, loss, gradient and Hessian of every fit over its rows at the trial coefficients in ``columns``, with the columns ``by``."""
    k = range(len(features) + 1)
    z = ["use_0 AS z_0", *[f"use_{i} * {standardised(features, i)} AS z_{i}" for i in k[1:]]]
    e = rows.join(trial, "part").selectExpr(*columns, "_y", "_w", "_o", *z)
    e = e.selectExpr("*", sum_of([f"t_{i} * z_{i}" for i in k], "_o") + " AS _eta").selectExpr("*", "1 / (1 + exp(-_eta)) AS _mu")
    e = e.selectExpr("*", "_w * (_y - _mu) AS _g", "_w * _mu * (1 - _mu) AS _h", "_w * (greatest(_eta, 0D) + log1p(exp(-abs(_eta))) - _y * _eta) AS _l")
    sums = ["sum(_w) AS w_n", "sum(_l) AS w_l", *[f"sum(_g * z_{i}) AS w_g{i}" for i in k], *[f"sum(_h * z_{i} * z_{j}) AS w_h{i}_{j}" for i in k for j in k[i:]]]
    return e.groupBy(*by).agg(*[F.expr(x) for x in sums])


def advanced(j: DataFrame, k: int, tol: float) -> DataFrame:
    """State after a round: a trial that is no worse than the best (to 1e-12 of the mean loss) is kept and a new step taken."""
    ridge = ["0D", *["ridge"] * k]
    penalty = sum_of([f"0.5D * ridge * t_{i} * t_{i}" for i in range(1, k + 1)], "w_l / w_n")
    grads = [f"w_g{i} / w_n - {ridge[i]} * t_{i} AS g_{i}" for i in range(k + 1)]
    hess = [f"w_h{i}_{m} / w_n" + (f" + {ridge[i]} * use_{i}" if i == m else "") + f" AS h_{i}_{m}" for i in range(k + 1) for m in range(i, k + 1)]
    keep = [c for c in j.columns if not c.startswith(("b_", "t_", "s_", "w_")) and c not in ("best", "step", "closed")]
    j = solved(j.selectExpr("*", f"{penalty} AS w_new", *grads, *hess), k)
    j = j.selectExpr("*", "w_new <= best + 1e-12D * (1 + abs(best)) AS w_ok", "greatest(0D, " + ", ".join(f"abs(n_{i})" for i in range(k + 1)) + f") < {tol}D AS w_small", "step / 4 AS w_step")
    r = range(k + 1)
    return j.selectExpr(*keep, *[f"CASE WHEN closed THEN b_{i} WHEN w_ok AND w_small THEN t_{i} + n_{i} WHEN w_ok THEN t_{i} ELSE b_{i} END AS b_{i}" for i in r],
                        *[f"CASE WHEN w_ok THEN t_{i} + n_{i} ELSE b_{i} + w_step * s_{i} END AS t_{i}" for i in r], *[f"CASE WHEN w_ok THEN n_{i} ELSE s_{i} END AS s_{i}" for i in r],
                        "CASE WHEN w_ok THEN w_new ELSE best END AS best", "CASE WHEN w_ok THEN 1D ELSE w_step END AS step", "closed OR (w_ok AND w_small) OR (NOT w_ok AND w_step < 1e-6D) AS closed")


def linear(features: Sequence[str], offset: Column | None = None) -> Column:
    """Log-odds of a row that is joined to its fit's coefficients."""
    eta = F.expr(sum_of([f"use_{i} * b_{i} * ({standardised(features, i)})" for i in range(1, len(features) + 1)], "use_0 * b_0"))
    return eta if offset is None else eta + offset


# ---- isotonic fits ----

PUSH = """concat(slice(stack, 1, at), array(named_struct('n', top.n, 'y', top.y, 'lo', if(at < size(stack), stack[at].lo, x.lo), 'hi', x.hi)))"""
POOLS = """transform(slice(hull, 2, size(hull)), (v, i) -> named_struct('n', v.n - hull[i].n, 'y', v.y - hull[i].y, 'lo', v.lo, 'hi', v.hi))"""
HULL = """aggregate(points, array(named_struct('n', 0D, 'y', 0D, 'lo', cast(null as double), 'hi', cast(null as double))), (stack, x) ->
  element_at(transform(array(named_struct('n', element_at(stack, -1).n + x.n, 'y', element_at(stack, -1).y + x.y)), top ->
    element_at(transform(array(transform(stack, v -> (top.y - v.y) / (top.n - v.n))), slopes ->
      element_at(transform(array(cast(array_position(slopes, array_max(slopes)) as int)), at -> """ + PUSH + """), 1)), 1)), 1))"""


def pooled(df: DataFrame) -> DataFrame:
    """Replace ``points`` (sorted n, y, lo, hi) by their pools of increasing means.

    The new point is joined with the corner of the hull under which no other corner lies: the steepest line to it.
    """
    return df.withColumn("hull", F.expr(HULL)).withColumn("points", F.expr(POOLS)).drop("hull")


def merged_runs(d: DataFrame) -> DataFrame:
    """Neighbours of a slice whose means do not rise become one: every falling run at once, by a running count of the rises."""
    w = W.partitionBy("fit", "_slice").orderBy("lo")
    mean = F.col("y") / F.col("n")
    d = d.withColumn("_rise", (mean > F.lag(mean).over(w)).cast("int")).withColumn("_run", F.sum("_rise").over(w))
    return d.groupBy("fit", "_slice", F.coalesce("_run", F.lit(0)).alias("_run")).agg(
        F.sum("n").alias("n"), F.sum("y").alias("y"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def isotonic(points: DataFrame, slices: int | None = None, size: int = SLICE) -> DataFrame:
    """(fit, lo, hi, value): arrays of the pools of every fit in order of score, from rows (fit, p, n, y) with distinct p.

    Rows (fit, lo, hi, n, y) stand for neighbouring scores that are known to share a pool.  The pools equal the max-min
    formula over the exact scores; one row per fit, O(rows ** (2/3)) pools in it.
    """
    if "lo" not in points.columns:
        points = points.withColumns({"lo": F.col("p"), "hi": F.col("p")})
    points = materialise(points.select("fit", *[F.col(c).cast("double").alias(c) for c in ("lo", "hi", "n", "y")]), "points")
    if slices is None:
        many = points.count()
        if many > SLICED:
            slices = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(many / SLICED))
    rows = row_numbers(points, ["fit"], [F.col("lo")], "_at", slices)
    d = rows.select("fit", F.floor((F.col("_at") - 1) / size).alias("_slice"), "n", "y", "lo", "hi")
    for _ in range(RUNS):
        d = merged_runs(d)
    d = d.groupBy("fit", "_slice").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "y", "hi"))).alias("points"))
    d = pooled(d.withColumn("points", F.expr("transform(points, v -> named_struct('n', v.n, 'y', v.y, 'lo', v.lo, 'hi', v.hi))")))
    d = materialise(d, "pools")
    last = d.agg(F.max("_slice")).first()[0] or 0
    while last > 0:
        d = d.groupBy("fit", F.floor(F.col("_slice") / MERGED).alias("_slice")).agg(F.sort_array(F.collect_list(F.struct("_slice", "points"))).alias("points"))
        d = pooled(d.withColumn("points", F.flatten(F.col("points.points"))))
        last //= MERGED
    return d.select("fit", F.col("points.lo").alias("lo"), F.col("points.hi").alias("hi"), F.expr("transform(points, v -> v.y / v.n)").alias("value"))


def pools_below(p: Column, lo: Column) -> Column:
    """Number of pools that start at or below ``p``: halving steps from the largest power of two in the number of pools."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(lo).cast("double"))).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(lo, at + step - 1) <= p, at + step).otherwise(at))


def step_value(p: Column, lo: Column, hi: Column, value: Column) -> Column:
    """Isotonic value: constant in a pool, linear between pools, clipped outside; ``_at`` is the number of the score's pool."""
    at = F.col("_at")
    here, after = F.get(value, at - 1), F.get(value, at)
    left, right = F.get(hi, at - 1), F.get(lo, at)
    between = here + (after - here) * (p - left) / (right - left)
    return F.when((p > left) & after.isNotNull(), between).otherwise(here)


# ---- calibrators of many fits ----

def histogram(df: DataFrame, part: Column, y: str, p: str) -> DataFrame:
    """(part, p, n, y) of the exact scores: rows and positives of every score; rows without a score or label take no part."""
    usable = df.filter(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(y).isNotNull())
    return usable.groupBy(part.alias("part"), F.col(p).cast("double").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("y"))


def with_cells(hist: DataFrame) -> DataFrame | None:
    """The histogram with the number of the cell of every score, or None where the scores are few or their range is not finite."""
    one = hist.agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    if one["n"] <= FEW:
        return None
    width = (one["hi"] - one["lo"]) / math.ceil(CELLS * math.sqrt(one["n"]))
    if not 0.0 < width < math.inf:
        return None
    return hist.withColumn("cell", F.floor((F.col("p") - one["lo"]) / F.lit(width)))


def cell_sums(celled: DataFrame, eps: float) -> DataFrame:
    """One row per part and cell: number and range of its scores, rows, positives, range of the scores' rates, means of p and its log-odds."""
    rate, q = F.col("y") / F.col("n"), X.clip(F.col("p"), eps)
    sums = celled.groupBy("part", "cell").agg(
        F.count(F.lit(1)).alias("scores"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.min(rate).alias("low"), F.max(rate).alias("high"),
        (F.sum(F.col("n") * q) / F.sum("n")).alias("p"), (F.sum(F.col("n") * X.logit(F.col("p"), eps)) / F.sum("n")).alias("z"), F.sum("n").alias("n"), F.sum("y").alias("y"))
    return materialise(sums, "cells")


def open_cells(sums: DataFrame, members_: DataFrame, slices: int | None = None) -> DataFrame:
    """(fit, cell, lo, hi, n, y, open): the cells of every fit, open where a score inside may be a corner of the hull.

    The hull of the cells' ends lies on or above the hull of the scores, so a corner lies below it.  Inside a cell the
    running sums stay above the path that takes the lowest rate first and the highest last; where the bend of that path is not
    below the hull of the ends, neither is any score.
    """
    each = members_.select("fit", "part").join(sums, "part").groupBy("fit", "cell").agg(
        F.sum("scores").alias("scores"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("y").alias("y"))
    each = materialise(each, "fit-cells")
    rough = isotonic(each, slices).select(F.col("fit").alias("_fit"), F.col("lo").alias("_los"), F.col("value").alias("_values"))
    j = each.join(rough, F.col("fit") == F.col("_fit")).withColumn("_pool", pools_below(F.col("lo"), F.col("_los")))
    j = j.select(*each.columns, "_pool", F.get("_values", F.col("_pool") - 1).alias("_mean"))
    w = W.partitionBy("fit", "_pool").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)  # cells of one pool, at most the square root of the scores x CELLS
    j = j.withColumns({"_n": F.sum("n").over(w), "_y": F.sum("y").over(w)})
    last = F.try_divide(F.col("y") - F.col("low") * F.col("n"), F.col("high") - F.col("low"))  # rows at the highest rate
    bend_n, bend_y = F.col("_n") - last, F.col("_y") - F.col("high") * last
    may = (F.col("scores") > 1) & (F.col("high") > F.col("low")) & (bend_y < F.col("_mean") * bend_n + 1e-9 * (1.0 + F.abs("_n")))
    return materialise(j.select("fit", "cell", "lo", "hi", "n", "y", F.coalesce(may, F.lit(False)).alias("open")), "open-cells")


def isotonic_points(hist: DataFrame, celled: DataFrame | None, sums: DataFrame | None, members_: DataFrame, slices: int | None = None) -> DataFrame:
    """Points of the isotonic fits: cells without corners as one point each, the scores of all others."""
    if celled is None:
        return members_.select("fit", "part").join(hist, "part").groupBy("fit", "p").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    cells = open_cells(sums, members_, slices)
    wanted = materialise(members_.select("fit", "part").join(cells.filter("open").select("fit", "cell"), "fit"), "wanted-cells")
    near = celled.join(wanted, ["part", "cell"]).groupBy("fit", "p").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    return cells.filter("not open").select("fit", "lo", "hi", "n", "y").unionByName(near.select("fit", F.col("p").alias("lo"), F.col("p").alias("hi"), "n", "y"))


def label_rows(hist: DataFrame, p: Column, z: Column) -> DataFrame:
    """(part, p, z, label, w): every row counts once with its positives and once with its negatives."""
    return hist.select("part", p.alias("p"), z.alias("z"), F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("y").alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("y")).alias("w"))))).filter("w > 0")


def calibrators(hist: DataFrame, members_: DataFrame, methods: Sequence[str] = METHODS, eps: float = EPS, slices: int | None = None) -> DataFrame:
    """(fit, method, coefficients, steps) of every fit and method on the exact-score histogram."""
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown calibrator {sorted(unknown)}")
    fits = members_.select("fit").distinct()
    out = None
    empty = {"lo": F.array().cast("array<double>"), "hi": F.array().cast("array<double>"), "value": F.array().cast("array<double>")}
    lines = [m for m in methods if m in LINES]
    celled = with_cells(hist)
    sums = None if celled is None else cell_sums(celled, eps)
    if lines:
        each = fits.select(F.col("fit").alias("of"), F.explode(F.array(*[F.lit(m) for m in lines])).alias("method"))
        named = each.withColumn("fit", F.concat_ws("|", "of", "method"))
        use = {n: F.element_at(F.create_map(*[F.lit(v) for m in lines for v in (m, LINES[m][i])]), F.col("method")) for i, n in enumerate(("", "p", "z"))}
        rows = label_rows(hist, X.clip(F.col("p"), eps), X.logit(F.col("p"), eps))
        member = members_.select(F.col("fit").alias("of"), "part").join(named.select("of", "fit"), "of").select("fit", "part")
        spec = plain_spec(named.select("fit", "of", "method"), ("p", "z"), use)
        start = None if sums is None else newton(label_rows(sums, F.col("p"), F.col("z")), member, spec, ("p", "z"), "label", weight="w")
        b = newton(rows, member, spec, ("p", "z"), "label", weight="w", start=start)
        out = b.select(F.col("of").alias("fit"), "method", "b_0", "b_1", "b_2", *[c.alias(n) for n, c in empty.items()])
    if "isotonic" in methods:
        steps = isotonic(isotonic_points(hist, celled, sums, members_, slices), slices).select("fit", F.lit("isotonic").alias("method"), *[F.lit(0.0).alias(f"b_{i}") for i in range(3)], "lo", "hi", "value")
        out = steps if out is None else out.unionByName(steps)
    if "identity" in methods:
        same = fits.select("fit", F.lit("identity").alias("method"), *[F.lit(0.0).alias(f"b_{i}") for i in range(3)], *[c.alias(n) for n, c in empty.items()])
        out = same if out is None else out.unionByName(same)
    return materialise(out, "calibrators")


def calibrated(p: Column, eps: float = EPS) -> Column:
    """Calibrated probability of a score joined to a row of ``calibrators`` and its pool ``_at``; temperatures stay in [0.05, 20]."""
    z = X.logit(p, eps)
    q = (F.when(F.col("method") == "identity", p).when(F.col("method") == "isotonic", step_value(p, F.col("lo"), F.col("hi"), F.col("value")))
         .when(F.col("method") == "platt_p", X.sigmoid(F.col("b_0") + F.col("b_1") * X.clip(p, eps)))
         .when(F.col("method") == "platt_logit", X.sigmoid(F.col("b_0") + F.col("b_2") * z))
         .otherwise(X.sigmoid(z * F.least(F.lit(20.0), F.greatest(F.lit(0.05), F.col("b_2"))))))
    return X.clip(q, eps)


def scored_histogram(hist: DataFrame, own: DataFrame, fitted: DataFrame, eps: float = EPS) -> DataFrame:
    """(part, method, p, calibrated, n, y): every score under the fit that ``own`` (fit, part) names for its part.

    Only the isotonic rows carry the arrays of the pools.
    """
    j, steps, no_array = own.select("fit", "part").join(fitted, "fit"), F.col("method") == "isotonic", F.lit(None).cast("array<double>")
    lines = j.filter(~steps).drop("lo", "hi", "value").join(hist, "part").withColumns({"_at": F.lit(None).cast("int"), "lo": no_array, "hi": no_array, "value": no_array})
    pools = j.filter(steps).join(hist, "part").withColumn("_at", F.greatest(pools_below(F.col("p"), F.col("lo")), F.lit(1)))
    out = [d.select("part", "method", "p", calibrated(F.col("p"), eps).alias("calibrated"), "n", "y") for d in (lines, pools)]
    return out[0].unionByName(out[1])


def weighted_metrics(scored: DataFrame, by: Sequence[str], p: str = "calibrated", bins: int = 10) -> DataFrame:
    """rows, positives, their rate, mean_p, logloss, brier, ece and mce per group from (p, n, y) rows, in one aggregate and a fold of bins."""
    q, n, y = F.col(p), F.col("n"), F.col("y")
    cells = scored.groupBy(*by, X.bin_index(q, bins).alias("_bin")).agg(
        F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum(n * q).alias("pn"), F.sum(-y * F.log(q) - (n - y) * F.log(1.0 - q)).alias("l"),
        F.sum(y * (1.0 - q) * (1.0 - q) + (n - y) * q * q).alias("b"))
    gap = F.abs(F.col("pn") - F.col("y"))
    return cells.groupBy(*by).agg(F.sum("n").cast("long").alias("rows"), F.sum("y").cast("long").alias("positives"), (F.sum("y") / F.sum("n")).alias("positive_rate"),
                                  (F.sum("pn") / F.sum("n")).alias("mean_p"), (F.sum("l") / F.sum("n")).alias("logloss"),
                                  (F.sum("b") / F.sum("n")).alias("brier"), (F.sum(gap) / F.sum("n")).alias("ece"), F.max(gap / F.col("n")).alias("mce"))


def walk_forward(hist: DataFrame, methods: Sequence[str] = METHODS, slices: int | None = None) -> DataFrame:
    """Every part but the first under calibrators fitted on the parts before it."""
    m = materialise(forward_members(hist.select("part").distinct()), "members")
    own = m.select("fit", F.col("own").alias("part")).distinct()
    return scored_histogram(hist, own, calibrators(hist, m, methods, slices=slices))


def leave_one_out(hist: DataFrame, methods: Sequence[str] = METHODS, slices: int | None = None) -> DataFrame:
    """Every part under calibrators fitted on all other parts."""
    m = materialise(complement_members(hist.select("part").distinct()), "members")
    own = m.select("fit", F.col("own").alias("part")).distinct()
    return scored_histogram(hist, own, calibrators(hist, m, methods, slices=slices))


def leave_one_out_choice(per_part: DataFrame) -> DataFrame:
    """Method table of ``weighted_metrics`` by (part, method): mean log-loss, then mean Brier, worst part ECE and spread decide."""
    t = per_part.groupBy("method").agg(F.avg("logloss").alias("mean_logloss"), F.avg("brier").alias("mean_brier"), F.avg("ece").alias("mean_ece"),
                                       F.max("ece").alias("worst_ece"), F.stddev_pop("logloss").alias("std_logloss"), F.count(F.lit(1)).alias("parts"))
    return marked(t, ["mean_logloss", "mean_brier", "worst_ece", "std_logloss", "method"])


def forward_choice(per_part: DataFrame) -> DataFrame:
    """Method table of a nested forward pass: the sum of mean log-loss, Brier and ECE decides, then the highest MCE."""
    t = per_part.groupBy("method").agg(F.avg("logloss").alias("mean_logloss"), F.avg("brier").alias("mean_brier"), F.avg("ece").alias("mean_ece"),
                                       F.max("mce").alias("high_mce"), F.count(F.lit(1)).alias("parts"))
    return marked(t.withColumn("score", F.col("mean_logloss") + F.col("mean_brier") + F.col("mean_ece")), ["score", "high_mce", "method"])


def marked(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """Flag of the first row in the given order (one row per method)."""
    return table.withColumn("selected", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) == 1)


def calibration_lines(df: DataFrame, by: Sequence[str], y: str, p: str, eps: float = EPS) -> DataFrame:
    """(by..., rows, slope, intercept): logistic calibration line of every group, all groups in the same rounds.

    The groups may be any number; a group whose scores or labels are all equal gets slope 0.
    """
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    usable = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    hist = materialise(usable.groupBy(*by, key.alias("part"), X.logit(F.col(p), eps).alias("z"), F.col(y).cast("double").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("w")), "lines")
    fits = hist.groupBy("part", *by).agg(F.sum("w").cast("long").alias("rows")).withColumn("fit", F.col("part"))
    b = newton(hist, fits.select("fit", "part"), plain_spec(fits.select("fit", *by, "rows"), ("z",)), ("z",), "label", weight="w")
    return b.select(*by, "rows", F.col("b_1").alias("slope"), F.col("b_0").alias("intercept"))


# ---- imputed, standardised baselines of many fits ----

def weighted_medians(points: DataFrame, slices: int | None = None) -> DataFrame:
    """(fit, c, median) from (fit, c, v, n): linear interpolation between the middle values, as over the single rows."""
    cum = running(points, ["fit", "c"], [F.col("v")], {"_cum": F.col("n")}, slices)
    total = points.groupBy("fit", "c").agg(F.sum("n").alias("_total")).withColumnsRenamed({"fit": "_f", "c": "_c"})
    j = cum.join(total, (F.col("fit") == F.col("_f")) & (F.col("c") == F.col("_c")))
    h = (F.col("_total") - 1) / 2.0

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_cum") > index, F.col("v")))

    return j.groupBy("fit", "c").agg(((at(F.floor(h)) + at(F.ceil(h))) / 2.0).alias("median"))


def baseline_spec(rows: DataFrame, members_: DataFrame, features: Sequence[str], c: float = 1.0, part: str = "part", slices: int | None = None) -> DataFrame:
    """Specs whose fills are the medians of each fit's parts, whose scaling follows from the filled values, with ridge 1/(c*n).

    Values are counted once per part; the fits add the counts of their parts.
    """
    long = rows.select(F.col(part).alias("part"), F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features, 1)])))
    counts = materialise(long.groupBy("part", "c", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    points = members_.select("fit", "part").join(counts, "part").groupBy("fit", "c", "v").agg(F.sum("n").alias("n"))
    points = materialise(points, "points")
    medians = weighted_medians(points.filter("v is not null"), slices)
    sums = points.groupBy("fit", "c").agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("missing"),
                                          F.sum(F.col("v") * F.col("n")).alias("s1"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("s2"))
    j = sums.join(medians, ["fit", "c"], "left").withColumns({"median": F.coalesce("median", F.lit(0.0)), "missing": F.coalesce("missing", F.lit(0)).cast("double")})
    j = j.withColumn("mean", (F.coalesce("s1", F.lit(0.0)) + F.col("missing") * F.col("median")) / F.col("n"))
    var = (F.coalesce("s2", F.lit(0.0)) + F.col("missing") * F.col("median") * F.col("median")) / F.col("n") - F.col("mean") * F.col("mean")
    j = j.withColumn("scale", F.when(var > 1e-18, F.sqrt(var)).otherwise(1.0))
    wide = j.groupBy("fit").agg(F.max("n").alias("_n"), *[F.max(F.when(F.col("c") == i, F.col(v))).alias(f"{n}_{i}")
                                                         for i in range(1, len(features) + 1) for n, v in (("fill", "median"), ("mean", "mean"), ("scale", "scale"))])
    return wide.select("fit", *[F.lit(1.0).alias(f"use_{i}") for i in range(len(features) + 1)], *[f"{n}_{i}" for i in range(1, len(features) + 1) for n in ("fill", "mean", "scale")],
                       (1.0 / (c * F.col("_n"))).alias("ridge"))


def baselines(rows: DataFrame, members_: DataFrame, features: Sequence[str], y: str, c: float = 1.0, part: str = "part") -> DataFrame:
    """Median-imputed, standardised logistic baselines of all fits, fitted together."""
    return newton(rows, members_, baseline_spec(rows, members_, features, c, part), features, y, part=part)


def with_fit(df: DataFrame, fitted: DataFrame, features: Sequence[str], out: str, fit: str | None = None) -> DataFrame:
    """Probability of every row under one fit (the only row of ``fitted``, or the one named)."""
    one = fitted if fit is None else fitted.filter(F.col("fit") == fit)
    j = attach_row(df, one.select(*[F.col(c).alias(c) for c in one.columns if c.startswith(("use_", "b_", "fill_", "mean_", "scale_"))]))
    return j.withColumn(out, X.clip(X.sigmoid(linear(features)))).select(*df.columns, out)
