"""SQL of the fits: Newton's method and isotonic hulls as recursive CTEs, for the queries that compare with DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

ROUNDS = 14


def values(rows: Sequence[tuple]) -> str:
    return ",".join("(" + ",".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def newton(name: str, k: int, rows: str, members: str, spec: str | None = None, rounds: int = ROUNDS) -> str:
    """CTEs that end in ``name``(fit, b0, ..., bk).

    ``rows`` has (part, y, w, o, x1, ...), ``members`` (fit, part) and ``spec`` the fit's use0, ..., fill1, mean1, scale1, ...
    and ridge; without a spec every feature is used as it is.
    """
    ks = range(k + 1)
    if spec is None:
        z = ", ".join(["1.0e0 AS z0", *[f"x{i} AS z{i}" for i in ks[1:]], "0.0e0 AS ridge"])
        source = f"{rows} JOIN {members} USING (part)"
    else:
        z = ", ".join(["use0 AS z0", *[f"use{i} * ((coalesce(x{i}, fill{i}) - mean{i}) / scale{i}) AS z{i}" for i in ks[1:]], "ridge"])
        source = f"{rows} JOIN {members} USING (part) JOIN {spec} USING (fit)"
    b = ", ".join(f"b{i}" for i in ks)
    eta = "o + " + " + ".join(f"b{i} * z{i}" for i in ks)
    grads = [f"sum(g * z{i}) / sum(w) - {'ridge' if i else '0'} * b{i} AS g{i}" for i in ks]
    hess = [f"sum(h * z{i} * z{j}) / sum(w) + {'ridge' if i and i == j else '0'} AS h{i}_{j}" for i in ks for j in range(i, k + 1)]
    q = (f"SELECT fit, it, {b}, {', '.join(grads + hess)} FROM (SELECT *, w * (y - mu) AS g, w * mu * (1 - mu) AS h FROM "
         f"(SELECT *, 1 / (1 + exp(-({eta}))) AS mu FROM {name}_n JOIN {name}_z USING (fit) WHERE it < {rounds})) GROUP BY fit, it, {b}, ridge")
    for j in ks:
        pivot = f"h{j}_{j}" + "".join(f" - l{j}_{m} * l{j}_{m}" for m in range(j))
        q = f"SELECT *, CASE WHEN {pivot} > 1e-13 THEN 1 / sqrt(greatest({pivot}, 1e-13)) ELSE 0 END AS d{j} FROM ({q})"
        below = [f"(h{j}_{i}" + "".join(f" - l{i}_{m} * l{j}_{m}" for m in range(j)) + f") * d{j} AS l{i}_{j}" for i in range(j + 1, k + 1)]
        if below:
            q = f"SELECT *, {', '.join(below)} FROM ({q})"
    for j in ks:
        q = f"SELECT *, (g{j}" + "".join(f" - l{j}_{m} * c{m}" for m in range(j)) + f") * d{j} AS c{j} FROM ({q})"
    for j in reversed(ks):
        q = f"SELECT *, (c{j}" + "".join(f" - l{m}_{j} * s{m}" for m in range(j + 1, k + 1)) + f") * d{j} AS s{j} FROM ({q})"
    steps = ", ".join(f"b{i} + s{i}" for i in ks)
    zeros = ", ".join(f"0.0e0 AS b{i}" for i in ks)
    return (f"{name}_z AS MATERIALIZED (SELECT fit, y, w, o, {z} FROM {source}), "
            f"{name}_n AS (SELECT DISTINCT fit, 0 AS it, {zeros} FROM {name}_z UNION ALL SELECT fit, it + 1, {steps} FROM ({q})), "
            f"{name} AS (SELECT fit, {b} FROM {name}_n WHERE it = {rounds})")


def isotonic(name: str, points: str) -> str:
    """CTEs that end in ``name``(fit, lo, hi, v, next_lo, next_v) from ``points``(fit, p, n, y): gift wrapping of the running sums."""
    return f"""{name}_c AS MATERIALIZED (SELECT fit, p, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM {points} WINDOW w AS (PARTITION BY fit ORDER BY p)),
{name}_h AS (SELECT DISTINCT fit, 0.0e0 AS cn, 0.0e0 AS cy, NULL::double AS hi, NULL::double AS v FROM {name}_c
 UNION ALL SELECT fit, -b.c, b.y, b.p, b.s FROM (SELECT fit, min(struct_pack(s := (c.cy - h.cy) / (c.cn - h.cn), c := -c.cn, y := c.cy, p := c.p)) AS b
  FROM {name}_h h JOIN {name}_c c USING (fit) WHERE c.cn > h.cn GROUP BY fit)),
{name}_p AS (SELECT fit, hi, any_value(v) AS v, min(p) AS lo
 FROM (SELECT c.fit, c.p, h.hi, h.v FROM {name}_c c ASOF JOIN (SELECT fit, hi, v FROM {name}_h WHERE hi IS NOT NULL) h ON c.fit = h.fit AND c.p <= h.hi) GROUP BY 1, 2),
{name} AS (SELECT *, lead(lo) OVER w AS next_lo, lead(v) OVER w AS next_v FROM {name}_p WINDOW w AS (PARTITION BY fit ORDER BY lo))"""


def calibration(hist: str, members: str, own: str, e: str = "1e-6") -> str:
    """CTEs that end in ``applied``(part, method, n, y, q): all calibrators of all fits, on the parts that ``own``(fit, part) names."""
    clip = f"greatest({e}, least(1 - {e}, p))"
    lines = (f"lines AS (SELECT * FROM (VALUES ('platt_p', 1.0e0, 1.0e0, 0.0e0), ('platt_logit', 1.0e0, 0.0e0, 1.0e0), ('temperature', 0.0e0, 0.0e0, 1.0e0)) t(method, use0, use1, use2)), "
             f"line_rows AS (SELECT part, {clip} AS x1, ln({clip} / (1 - {clip})) AS x2, 0.0e0 AS o, y, w FROM (SELECT part, p, 1.0e0 AS y, y AS w FROM {hist} UNION ALL SELECT part, p, 0.0e0, n - y FROM {hist}) WHERE w > 0), "
             f"line_fits AS (SELECT DISTINCT fit AS of, fit || '|' || method AS fit, method, use0, use1, use2, 0.0e0 AS fill1, 0.0e0 AS mean1, 1.0e0 AS scale1, 0.0e0 AS fill2, 0.0e0 AS mean2, 1.0e0 AS scale2, 0.0e0 AS ridge FROM {members}, lines), "
             f"line_members AS (SELECT f.fit, m.part FROM {members} m JOIN line_fits f ON f.of = m.fit), "
             + newton("line_b", 2, "line_rows", "line_members", "line_fits"))
    points = f"iso_points AS (SELECT fit, p, sum(n) AS n, sum(y) AS y FROM {members} JOIN {hist} USING (part) GROUP BY 1, 2), " + isotonic("iso", "iso_points")
    target = f"target AS (SELECT o.fit, part, p, n, y FROM {own} o JOIN {hist} USING (part))"
    raw = (f"raw AS (SELECT part, 'identity' AS method, n, y, p AS r FROM target UNION ALL "
           f"SELECT part, method, n, y, CASE method WHEN 'platt_p' THEN 1 / (1 + exp(-(b0 + b1 * {clip}))) WHEN 'platt_logit' THEN 1 / (1 + exp(-(b0 + b2 * ln({clip} / (1 - {clip}))))) "
           f"ELSE 1 / (1 + exp(-(least(20.0, greatest(0.05, b2)) * ln({clip} / (1 - {clip}))))) END FROM target t JOIN line_fits f ON f.of = t.fit JOIN line_b b ON b.fit = f.fit UNION ALL "
           f"SELECT part, 'isotonic', n, y, CASE WHEN i.v IS NULL THEN (SELECT arg_min(v, lo) FROM iso k WHERE k.fit = t.fit) WHEN t.p <= i.hi OR next_v IS NULL THEN i.v ELSE v + (next_v - v) * (t.p - i.hi) / (next_lo - i.hi) END "
           f"FROM target t ASOF LEFT JOIN iso i ON t.fit = i.fit AND t.p >= i.lo)")
    return f"{lines}, {points}, {target}, {raw}, applied AS (SELECT part, method, n, y, greatest({e}, least(1 - {e}, r)) AS q FROM raw)"


def metrics(by: str) -> str:
    """Weighted metrics of ``applied`` by the given columns, unrounded."""
    cell = " + ".join(f"(q >= {i / 10})::int" for i in range(1, 10))
    return (f"SELECT {by}, cast(sum(n) AS bigint) AS rows, cast(sum(y) AS bigint) AS positives, sum(y) / sum(n) AS positive_rate, sum(pn) / sum(n) AS mean_p, sum(l) / sum(n) AS logloss, sum(b) / sum(n) AS brier, "
            f"sum(abs(pn - y)) / sum(n) AS ece, max(abs(pn - y) / n) AS mce FROM (SELECT {by}, {cell} AS cell, sum(n) AS n, sum(y) AS y, sum(n * q) AS pn, sum(-y * ln(q) - (n - y) * ln(1 - q)) AS l, "
            f"sum(y * (1 - q) ** 2 + (n - y) * q ** 2) AS b FROM applied GROUP BY {by}, cell) GROUP BY {by}")


def baseline_spec(k: int, rows: str, members: str, c: float = 1.0) -> str:
    """SELECT of the specs of imputed, standardised fits."""
    parts = []
    for i in range(1, k + 1):
        parts.append(f"any_value(m{i}) AS fill{i}, avg(coalesce(x{i}, m{i})) AS mean{i}, coalesce(nullif(stddev_pop(coalesce(x{i}, m{i})), 0), 1) AS scale{i}")
    uses = ", ".join(f"1.0e0 AS use{i}" for i in range(k + 1))
    medians = ", ".join(f"coalesce(median(x{i}) OVER (PARTITION BY fit), 0) AS m{i}" for i in range(1, k + 1))
    return f"SELECT fit, {uses}, {', '.join(parts)}, 1.0e0 / ({c} * count(*)) AS ridge FROM (SELECT *, {medians} FROM {rows} JOIN {members} USING (part)) GROUP BY fit"


def linear(k: int) -> str:
    return "use0 * b0" + "".join(f" + use{i} * b{i} * ((coalesce(x{i}, fill{i}) - mean{i}) / scale{i})" for i in range(1, k + 1))
