"""Rule search: threshold grids, multi-parameter rule grids, exact top-k with order-dependent scores, pruning, gates.

Rows are never paired with rules.  Every row is reduced to a *cell*: the codes of the grid
thresholds and bands it satisfies.  The number of cells depends on the grid only, so all
additive metrics of all rules follow from the cell table, one dimension at a time.  The drawdown,
which depends on the order, is bounded from the cells of ordered slices.  Rows meet rules only for
the few that these bounds leave open, through an equi-join on the cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import attach_row, row_numbers, slice_number, with_slices
from pitpanel.operators import backtest as K
from pitpanel.sources.workdir import materialise

STAKE = 100


@dataclass(frozen=True)
class Dim:
    """One grid dimension: ``>=`` or ``<=`` thresholds, or half-open bands (lo, hi); null, NaN and infinities meet none."""

    name: str
    column: str
    op: str
    values: tuple

    def code(self) -> Column:
        """Satisfied thresholds as a count (values sorted from loosest to tightest) or bands as a bit mask."""
        c = F.col(self.column)
        out = F.lit(0)
        for i, v in enumerate(self.loose_first()):
            if self.op == "band":
                hit, weight = (c >= v[0]) & (c < v[1]), 1 << i
            else:
                hit, weight = (c >= v) if self.op == ">=" else (c < v) if self.op == "<" else (c <= v), 1
            out = out + (X.is_finite(c) & F.coalesce(hit, F.lit(False))).cast("int") * weight
        return out

    def loose_first(self) -> list:
        if self.op == "band":
            return list(self.values)
        return sorted(self.values, reverse=self.op in ("<=", "<"))

    def expand(self, code: Column) -> Column:
        """Array of the value indexes a code satisfies."""
        n = len(self.values)
        if self.op == "band":
            return F.array_compact(F.array(*[F.when(F.expr(f"{self.name}_code & {1 << i}") != 0, F.lit(i)) for i in range(n)]))
        return F.when(code > 0, F.sequence(F.lit(0), code - 1)).otherwise(F.array().cast("array<int>"))

    def value_columns(self, index: Column) -> list[Column]:
        vals = self.loose_first()
        if self.op == "band":
            return [F.element_at(F.array(*[F.lit(float(v[k])) for v in vals]), index + 1).alias(f"{self.name}_{s}") for k, s in ((0, "min"), (1, "max"))]
        return [F.element_at(F.array(*[F.lit(float(v)) for v in vals]), index + 1).alias(self.name)]

    def value_names(self) -> list[str]:
        return [f"{self.name}_min", f"{self.name}_max"] if self.op == "band" else [self.name]


def with_codes(df: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """Codes of all dimensions; those that the frame already has stay."""
    return df.withColumns({f"{d.name}_code": d.code() for d in dims if f"{d.name}_code" not in df.columns})


def codes(dims: Sequence[Dim]) -> list[str]:
    return [f"{d.name}_code" for d in dims]


def rule_name(dims: Sequence[Dim]) -> Column:
    return F.concat_ws("-", *[F.col(f"{d.name}_i").cast("string") for d in dims])


def expand_rules(cells: DataFrame, keys: Sequence[str], dims: Sequence[Dim], sums: Sequence[Column]) -> DataFrame:
    """Cells to rules, one dimension at a time: every step turns a code into the value indexes it satisfies and adds up."""
    done: list[str] = []
    for i, d in enumerate(dims):
        cells = cells.withColumn(f"{d.name}_i", F.explode(d.expand(F.col(f"{d.name}_code"))))
        done.append(f"{d.name}_i")
        cells = cells.groupBy(*keys, *done, *codes(dims[i + 1:])).agg(*sums)
    return cells


def cell_table(df: DataFrame, group: Sequence[str], dims: Sequence[Dim], pay: str) -> DataFrame:
    """Bets, return and hits of every cell; size bounded by the grid, not by the data."""
    p = F.coalesce(F.col(pay), F.lit(0))
    return with_codes(df, dims).groupBy(*group, *codes(dims)).agg(
        F.count(F.lit(1)).alias("bets"), F.sum(p).alias("return"), F.count_if(p > 0).alias("hits"))


def rule_grid(df: DataFrame, group: Sequence[str], dims: Sequence[Dim], pay: str, min_bets: int = 1) -> DataFrame:
    """Bets, return, hits and ROI of every rule of the grid from the cell table."""
    return cell_grid(cell_table(df, group, dims, pay), group, dims, min_bets)


def cell_grid(cells: DataFrame, group: Sequence[str], dims: Sequence[Dim], min_bets: int = 1) -> DataFrame:
    cells = expand_rules(cells, group, dims, [F.sum(c).alias(c) for c in ("bets", "return", "hits")])
    out = cells.filter(F.col("bets") >= min_bets).withColumn("roi", F.try_divide(100.0 * F.col("return"), F.col("bets") * STAKE))
    return out.withColumn("rule_id", rule_name(dims))


def rule_values(rules: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """Replace value indexes by the grid values."""
    keep = [c for c in rules.columns if c not in {f"{d.name}_i" for d in dims}]
    return rules.select(*keep, *[v for d in dims for v in d.value_columns(F.col(f"{d.name}_i"))])


def cell_rules(df: DataFrame, dims: Sequence[Dim], rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(cell codes, rule) pairs of the given rules; size bounded by the grid, not by the data."""
    cells = with_codes(df, dims).select(*codes(dims)).distinct()
    for d in dims:
        cells = cells.withColumn(f"{d.name}_i", F.explode(d.expand(F.col(f"{d.name}_code"))))
    return cells.join(rules.select(*keys, *[f"{d.name}_i" for d in dims]), [f"{d.name}_i" for d in dims]).select(*codes(dims), *keys)


def rule_bets(df: DataFrame, dims: Sequence[Dim], rules: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows tagged with every given rule they satisfy, by an equi-join on the cell (AQE broadcasts the pairs when small)."""
    coded = with_codes(df, dims)
    pairs = cell_rules(df, dims, rules, [*group, "rule_id"])
    return coded.join(pairs, [*codes(dims), *group])


def coded_rows(df: DataFrame, dims: Sequence[Dim], keep: Sequence[Column]) -> DataFrame:
    """Codes and the columns ``keep``, written to the shared folder: all that a search of the grid reads."""
    return materialise(with_codes(df, dims).select(*codes(dims), *keep), "rule-rows")


def base_score(bets: Column, roi: Column, goal: float = 90.0) -> Column:
    """Goal bonus + ROI*1000 + min(bets, 5000); the drawdown penalty is subtracted separately."""
    return F.when(roi >= goal, 1_000_000).otherwise(0) + roi * 1000 + F.least(bets, F.lit(5000))


def grid_slices(df: DataFrame, group: Sequence[str], dims: Sequence[Dim], order: Sequence[Column], pay: str, slices: int) -> DataFrame:
    """Every rule on every slice of the ordered rows: bets, return, hits and what bounds the course of its profit there.

    A cell's rows in a slice are reduced to their total, highest and lowest prefix and worst drop.  The rows of a rule are the
    rows of its cells in some order, so the sums of these over its cells bound its own prefixes and drop inside the slice, while
    its profit at the borders of the slices is exact.  ``mark`` is a fingerprint of the rule's (cell, slice) set.  The size is
    that of the grid times the slices, whatever the data.
    """
    cs = codes(dims)
    d = with_codes(df, dims).withColumns({"_pay": F.coalesce(F.col(pay), F.lit(0)), "_o": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])})
    some = F.lit(True)
    for c in cs:
        some = some & (F.col(c) > 0)
    d = with_slices(d.filter(some).select(*group, *cs, "_o", "_pay"), group, [F.col("_o")], slices)
    w = W.partitionBy(*group, *cs, "_slice").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_c", F.sum(F.col("_pay") - STAKE).over(w))
    d = d.withColumn("_m", F.greatest(F.lit(0), F.max("_c").over(w)))
    cells = d.groupBy(*group, *cs, "_slice").agg(
        F.count(F.lit(1)).alias("bets"), F.sum("_pay").alias("return"), F.count_if(F.col("_pay") > 0).alias("hits"),
        F.greatest(F.lit(0), F.max("_c")).alias("hi"), F.least(F.lit(0), F.min("_c")).alias("lo"), F.max(F.col("_m") - F.col("_c")).alias("dd"))
    cells = cells.withColumns({"mark": F.xxhash64(*cs, "_slice"), "mark2": F.xxhash64("_slice", *reversed(cs))})
    return expand_rules(cells, [*group, "_slice"], dims, [F.sum(c).alias(c) for c in ("bets", "return", "hits", "hi", "lo", "dd")]
                        + [F.bit_xor(c).alias(c) for c in ("mark", "mark2")])


def bounded_grid(sliced: DataFrame, group: Sequence[str], dims: Sequence[Dim], min_bets: int = 1) -> DataFrame:
    """Rules with bets, return, hits, ROI and bounds ``dd_low <= maximum drawdown <= dd_up`` from ``grid_slices``.

    A drop ends in a slice at or after the one that holds its peak.  The peak is at least the profit at a border and at most
    border plus ``hi``; the end likewise with ``lo``; inside one slice the drops of the cells add up to no less than the rule's.
    """
    rule = [*group, *[f"{d.name}_i" for d in dims]]
    w = W.partitionBy(*rule).orderBy("_slice")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    d = sliced.withColumn("_s", F.col("return") - F.col("bets") * STAKE)
    d = d.withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    d = d.withColumns({"_start": F.greatest(F.lit(0), F.max("_off").over(w.rowsBetween(W.unboundedPreceding, 0))),
                       "_peak": F.greatest(F.lit(0), F.coalesce(F.max(F.col("_off") + F.col("hi")).over(before), F.lit(0)))})
    out = d.groupBy(*rule).agg(
        *[F.sum(c).alias(c) for c in ("bets", "return", "hits")], *[F.bit_xor(c).alias(c) for c in ("mark", "mark2")],
        F.greatest(F.lit(0), F.max(F.col("_start") - F.col("_off") - F.col("_s"))).alias("dd_low"),
        F.max(F.greatest(F.col("dd"), F.col("_peak") - F.col("_off") - F.col("lo"))).alias("dd_up"))
    return out.filter(F.col("bets") >= min_bets).withColumns(
        {"roi": F.try_divide(100.0 * F.col("return"), F.col("bets") * STAKE), "rule_id": rule_name(dims)})


def finalists(grid: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """Rules that can still be in the top ``k`` of a group, whatever their drawdown within its bounds.

    ``same_as`` names the first rule with the same rows, so that equal rules are computed once.
    """
    g = grid.withColumn("score_base", base_score(F.col("bets"), F.col("roi")))
    g = g.withColumn("_low", F.col("score_base") - F.col("dd_up") * 0.01)
    w = W.partitionBy(*(group or [F.lit(0)])).orderBy(F.col("_low").desc(), "rule_id")
    kth = g.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).groupBy(*group).agg(F.min("_low").alias("_kth"))
    j = g.join(F.broadcast(kth), list(group)) if group else attach_row(g, kth)
    j = j.filter(F.col("score_base") - F.col("dd_low") * 0.01 >= F.col("_kth")).drop("_kth", "_low", "dd_low", "dd_up")
    same = W.partitionBy(*group, "mark", "mark2", "bets", "return", "hits")
    return j.withColumn("same_as", F.min("rule_id").over(same)).drop("mark", "mark2")


def best_rules(df: DataFrame, group: Sequence[str], dims: Sequence[Dim], order: Sequence[Column], pay: str, min_bets: int, k: int,
               slices: int | None = None, stored: bool = False) -> DataFrame:
    """Exact top ``k`` rules per group by the full score including maximum drawdown; ties by rule id.

    The drawdown of all rules is bounded from the cells of ``slices`` slices of the ordered rows (default: the shuffle partitions);
    more slices, tighter bounds.  Rows meet only the rules that the bounds leave open, each set of equal rules once.
    The input is read twice (cells, finalist bets), so its codes, order and payout are written to the shared folder once,
    unless they are ``stored`` there already.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not stored:
        df = coded_rows(df, dims, [*[F.col(g) for g in group], *[c.alias(f"_order{i}") for i, c in enumerate(order)], F.col(pay)])
        order = [F.col(f"_order{i}") for i in range(len(order))]
    fin = materialise(finalists(bounded_grid(grid_slices(df, group, dims, order, pay, n), group, dims, min_bets), group, k), "finalist-rules")
    tagged = rule_bets(df, dims, fin.filter("rule_id = same_as"), group)
    risk = K.ordered_risk(tagged, [*group, "rule_id"], order, pay).withColumnRenamed("rule_id", "same_as")
    out = fin.join(risk, [*group, "same_as"]).withColumn("score", F.col("score_base") - F.col("max_drawdown") * 0.01)
    w = W.partitionBy(*(group or [F.lit(0)])).orderBy(F.col("score").desc(), "rule_id")
    return out.withColumn("selected_order", F.row_number().over(w)).filter(F.col("selected_order") <= k).drop("score_base", "same_as")


def threshold_grid(df: DataFrame, group: Sequence[str], contest: str, ev: Column, thresholds: Sequence[float], pay: str) -> DataFrame:
    """Bets, contests with a bet, hits, return and ROI at every EV threshold.

    A contest counts at a threshold when its best step reaches it, so contests are counted once each.
    """
    # thresholds ascend: a binary search instead of one comparison for each of them
    value = F.col("_ev")
    step = F.when(X.is_finite(value), slice_number(value, F.array(*[F.lit(float(t)) for t in thresholds]), len(thresholds))).otherwise(0)
    p = F.coalesce(F.col(pay), F.lit(0))
    per = df.withColumn("_ev", ev.cast("double")).withColumn("_step", step).filter("_step > 0").groupBy(*group, contest, "_step").agg(
        F.count(F.lit(1)).alias("bets"), F.sum(p).alias("return"), F.count_if(p > 0).alias("hits"))
    top = per.groupBy(*group, contest).agg(F.max("_step").alias("_step")).groupBy(*group, "_step").agg(F.count(F.lit(1)).alias("contests"))
    steps = per.groupBy(*group, "_step").agg(*[F.sum(c).alias(c) for c in ("bets", "return", "hits")])
    both = steps.withColumn("contests", F.lit(0).cast("long")).unionByName(
        top.select(*group, "_step", *[F.lit(0).cast("long").alias(c) for c in ("bets", "return", "hits")], "contests"))
    out = both.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_step")))).groupBy(*group, "_i").agg(
        *[F.sum(c).alias(c) for c in ("bets", "contests", "hits", "return")])
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    return out.select(*group, F.element_at(values, F.col("_i")).alias("threshold"), "bets", "contests", "hits", "return",
                      F.try_divide(100.0 * F.col("return"), F.col("bets") * STAKE).alias("roi"), F.try_divide("hits", "bets").alias("hit_rate"))


def rule_overlap(df: DataFrame, dims: Sequence[Dim], rules: DataFrame) -> DataFrame:
    """Intersection, union and Jaccard of every pair of rules from cell counts (bounded by the grid)."""
    return cell_overlap(materialise(with_codes(df, dims).groupBy(*codes(dims)).agg(F.count(F.lit(1)).alias("bets")), "cells"), dims, rules)


def cell_overlap(cells: DataFrame, dims: Sequence[Dim], rules: DataFrame) -> DataFrame:
    """``rule_overlap`` from a table of cells with their ``bets``."""
    counts = cells.select(*codes(dims), F.col("bets").alias("n"))
    pairs = cell_rules(cells, dims, rules, ["rule_id"]).join(counts, codes(dims))
    size = pairs.groupBy("rule_id").agg(F.sum("n").alias("size"))
    other = pairs.select(*codes(dims), F.col("rule_id").alias("other_id"))
    inter = pairs.join(other, codes(dims)).filter("rule_id < other_id").groupBy("rule_id", "other_id").agg(F.sum("n").alias("common"))
    j = inter.join(size, "rule_id").join(size.select(F.col("rule_id").alias("other_id"), F.col("size").alias("_o")), "other_id")
    return j.select("rule_id", "other_id", "common", (F.col("size") + F.col("_o") - F.col("common")).alias("together")).withColumn(
        "jaccard", F.col("common") / F.col("together"))


def greedy_prune(rules: DataFrame, overlap: DataFrame, order: Sequence[Column], threshold: float) -> DataFrame:
    """Rules that a pass in ``order`` keeps when it drops every rule similar to one kept before; rows of ``rules``.

    Rounds of local winners over the similarity graph: a rule that no open, better ranked neighbour precedes is kept, and its
    neighbours leave.  The set is the same as that of the sequential pass.  Any number of rules: the ranks are running
    positions, the state of a round is a table, and the driver only asks whether a rule is still open.
    """
    ranked = materialise(row_numbers(rules.select("rule_id", *[c.alias(f"_o{i}") for i, c in enumerate(order)], F.lit(0).alias("_g")), ["_g"],
                                     [F.col(f"_o{i}") for i in range(len(order))], "rank").select("rule_id", "rank"), "ranked-rules")
    close = overlap.filter(F.col("jaccard") >= threshold)
    a, b = ranked.select(F.col("rule_id"), F.col("rank").alias("x")), ranked.select(F.col("rule_id").alias("other_id"), F.col("rank").alias("y"))
    pairs = close.select("rule_id", "other_id").join(a, "rule_id").join(b, "other_id")
    edges = materialise(pairs.select(F.least("x", "y").alias("better"), F.greatest("x", "y").alias("worse")).distinct(), "similar-rules")
    kept, open_ = None, ranked.select("rank")
    while True:
        beaten = edges.select(F.col("worse").alias("rank")).distinct()
        won = materialise(open_.join(beaten, "rank", "left_anti"), "kept-rules")
        kept = won if kept is None else kept.unionByName(won)
        if edges.isEmpty():
            break
        gone = edges.join(won, edges.better == won["rank"], "left_semi").select(F.col("worse").alias("rank")).distinct()
        open_ = materialise(open_.join(won, "rank", "left_anti").join(gone, "rank", "left_anti"), "open-rules")
        left = edges.join(open_, edges.better == open_["rank"], "left_semi").join(open_, edges.worse == open_["rank"], "left_semi")
        edges = materialise(left, "similar-rules")
    return rules.join(ranked.join(kept, "rank", "left_semi").select("rule_id"), "rule_id", "left_semi").select(*rules.columns)


def classify_candidates(df: DataFrame, ev_min: Column, core_odds: float, longshot_odds: float) -> DataFrame:
    """core / value / longshot classes, one row per (entry, class); when none qualifies at all, rank-1 rows as core."""
    c = F.col
    good = X.at_least(c("ev"), ev_min)
    core = (c("model_rank") == 1) & X.at_least(c("margin"), 0.02) & good & X.is_finite(c("odds")) & (c("odds") < core_odds)
    value = (c("model_rank") <= 3) & (c("market_rank") >= 4) & (c("rank_gap") >= 1) & X.above(c("edge"), 0) & good
    longshot = (c("model_rank") <= 3) & X.at_least(c("odds"), longshot_odds) & X.above(c("edge"), 0.03) & X.at_least(c("ev"), ev_min + 0.15)
    d = df.withColumn("_tags", F.array_compact(F.array(*[
        F.when(F.coalesce(m, F.lit(False)), n) for n, m in (("core", core), ("value", value), ("longshot", longshot))])))
    d = materialise(d.filter((F.size("_tags") > 0) | (c("model_rank") == 1)), "candidates")  # no other row can get a class
    anything = d.agg(F.coalesce(F.max(F.size("_tags")), F.lit(0)) > 0).scalar()
    tags = F.when(anything, F.col("_tags")).otherwise(F.when(c("model_rank") == 1, F.array(F.lit("core"))).otherwise(F.array().cast("array<string>")))
    return d.withColumn("strategy_type", F.explode(tags)).drop("_tags")


def cap_share(df: DataFrame, condition: Column, total_rows: DataFrame, share: float, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """Keep at most max(1, floor(total*share)) rows among those matching ``condition``, best first; others pass."""
    k = total_rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share)))).scalar()
    hit = row_numbers(df.filter(condition).withColumn("_g", F.lit(0)), ["_g"], order, "_rn", slices).filter(F.col("_rn") <= k).drop("_g", "_rn")
    return hit.unionByName(df.filter(~condition))


def select_alpha(df: DataFrame, p: str, q: str, odds: str, pay: str, alphas: Sequence[float], ev_min: float) -> DataFrame:
    """ROI of EV picks for every blend weight (conditional sums, one pass), best first."""
    a = F.coalesce(F.col(pay), F.lit(0))
    aggs = []
    for i, alpha in enumerate(alphas):
        hit = X.at_least((alpha * F.col(p) + (1.0 - alpha) * F.col(q)) * F.col(odds), ev_min)
        aggs += [F.count_if(hit).alias(f"n{i}"), F.coalesce(F.sum(F.when(hit, a)), F.lit(0)).alias(f"r{i}")]
    one = df.agg(*aggs)
    out = one.select(F.inline(F.array(*[F.struct(F.lit(float(x)).alias("alpha"), F.col(f"n{i}").alias("bets"), F.col(f"r{i}").alias("return"))
                                        for i, x in enumerate(alphas)])))
    out = out.withColumn("roi", F.try_divide(100.0 * F.col("return"), F.col("bets") * STAKE))
    w = W.partitionBy(F.lit(0)).orderBy(F.col("roi").desc_nulls_last(), F.col("bets").desc(), "alpha")
    return out.withColumn("selected", F.row_number().over(w) == 1)


def gate(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Eligibility: all conditions hold (null counts as failed); the first failed one is named."""
    reason = F.lit(None).cast("string")
    for name, c in reversed(list(conditions.items())):
        reason = F.when(~F.coalesce(c, F.lit(False)), name).otherwise(reason)
    return df.withColumn("failed", reason).withColumn("eligible", F.col("failed").isNull())


def choose(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Lexicographic choice of one row per group among candidates."""
    w = W.partitionBy(*(group or [F.lit(0)])).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def near_tie_choice(df: DataFrame, metric: str, delta: float, ranks: Sequence[str], tie: str) -> DataFrame:
    """Among candidates within ``delta`` of the best metric, the smallest rank sum (candidate table, a few rows)."""
    whole = W.partitionBy(F.lit(0))
    d = df.withColumn("_best", F.min(metric).over(whole)).filter(F.col(metric) <= F.col("_best") + delta)
    total = F.lit(0)
    for c in ranks:
        total = total + F.rank().over(whole.orderBy(c))
    return d.withColumn("rank_sum", total).withColumn("_rn", F.row_number().over(whole.orderBy("rank_sum", metric, tie))).filter("_rn = 1").drop("_rn", "_best")


def nested_walk_forward(yearly: DataFrame, year: str, folds: Sequence[int], eligible, order, default: float) -> DataFrame:
    """Select the threshold on years before each fold year, validate on that year; ``default`` when none is eligible.

    ``yearly`` is the (year, threshold) grid, so every fold reads a few hundred rows.
    """
    yearly = materialise(yearly, "yearly")  # read three times below
    tags = F.array_compact(F.array(*[F.when(F.col(year) < y, F.lit(y)) for y in folds]))
    past = yearly.withColumn("fold", F.explode(tags)).groupBy("fold", "threshold").agg(
        F.sum("bets").alias("bets"), F.sum("return").alias("return"), F.count(F.lit(1)).alias("years"), F.min("bets").alias("min_yearly_bets"),
        F.min("roi").alias("min_yearly_roi"), F.count_if(F.col("roi") >= 90.0).alias("years_ge_90"))
    past = past.withColumn("roi", F.try_divide(100.0 * F.col("return"), F.col("bets") * STAKE))
    best = choose(past.filter(eligible), ["fold"], order).select("fold", F.col("threshold").alias("_t"))
    spine = yearly.filter(F.col(year).isin(*folds)).select(F.col(year).alias("fold")).distinct()
    picked = spine.join(best, "fold", "left").select("fold", F.coalesce("_t", F.lit(default)).alias("threshold"), F.col("_t").isNotNull().alias("certified"))
    val = yearly.select(F.col(year).alias("fold"), "threshold", F.col("bets").alias("validation_bets"), F.col("return").alias("validation_return"), F.col("roi").alias("validation_roi"))
    return picked.join(val, ["fold", "threshold"], "left")
