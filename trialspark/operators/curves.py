"""Success against budget, its area, and what is decided from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators import ranges

def budget_grid(attempts: DataFrame, keys: list[str], cumulative: str) -> DataFrame:
    """(keys, budget): 0 and every distinct non-negative cumulative cost of the group's attempts."""
    costs = attempts.select(*keys, F.col(cumulative).alias("budget")).where("budget >= 0")
    zero = attempts.select(*keys).distinct().withColumn("budget", F.lit(0).cast("long"))
    return costs.union(zero).distinct()


def ranged_curve(results: DataFrame, grid: DataFrame, policy_keys: list[str], grid_keys: list[str], solved: Column, cost: Column) -> DataFrame:
    """success_curve() with the ranges of its running sums, which area() can use again."""
    total = results.groupBy(*policy_keys).agg(F.count("*").alias("n"))
    paid = results.where(solved & cost.isNotNull()).groupBy(*policy_keys, cost.alias("budget")).agg(F.count("*").alias("solutions"))
    points = total.select(*policy_keys).join(grid, grid_keys).select(*policy_keys, "budget", F.lit(0).cast("long").alias("solutions"), F.lit(True).alias("on_grid"))
    both = points.unionByName(paid.withColumn("on_grid", F.lit(False))).groupBy(*policy_keys, "budget").agg(F.sum("solutions").alias("solutions"), F.bool_or("on_grid").alias("on_grid"))
    run = ranges.running_sums(ranges.with_ranges(both, policy_keys, "budget"), policy_keys, "budget", {"reached": "solutions"})
    return run.where("on_grid").join(total, policy_keys).select(*policy_keys, "budget", (F.col("reached") / F.col("n")).alias("success_rate"), ranges.RANGE)


def success_curve(results: DataFrame, grid: DataFrame, policy_keys: list[str], grid_keys: list[str], solved: Column, cost: Column) -> DataFrame:
    """(policy_keys, budget, success_rate): the share of results whose solution costs at most the budget.

    grid_keys, among policy_keys, say whose grid a policy is drawn on. Costs are counted by value first, then a running
    sum over costs and grid points together gives the curve: no join of costs with budgets.
    """
    return ranged_curve(results, grid, policy_keys, grid_keys, solved, cost).drop(ranges.RANGE)


def area(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc): trapezoids under the curve, not normalised; 0 with fewer than two points. A point's next one may lie in a later range."""
    ranged = curve if ranges.RANGE in curve.columns else ranges.with_ranges(curve, keys, "budget")
    both = ranges.with_next(ranged, keys, "budget", ["budget", "success_rate"])
    width, height = F.col("_next.budget") - F.col("budget"), (F.col("_next.success_rate") + F.col("success_rate")) / 2
    return both.groupBy(*keys).agg(F.coalesce(F.sum(width * height), F.lit(0.0)).alias("auc"))


#: Kinds of cost: the cumulative cost of attempts, which makes the grid, and the decision cost of results.
COSTS = {
    "token": ("cumulative_tokens", "decision_tokens"),
    "verifier_call": ("cumulative_verifier_calls", "decision_verifier_calls"),
    "time": ("cumulative_ms", "decision_ms"),
}
_GROUP = "_group"


def _stacked(kinds: tuple[str, ...], at: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(COSTS[k][at]).cast("long").alias("budget")) for k in kinds])).alias("x")


def _grouped(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """df with _GROUP, once for each grouping set: a struct of its number and its columns, null where a set lacks one."""
    names = sorted({c for s in sets for c in s})
    kinds = {f.name: f.dataType for f in df.schema.fields}
    of = [F.struct(F.lit(i).alias("grouping"), *[(F.col(c) if c in s else F.lit(None).cast(kinds[c])).alias(c) for c in names]) for i, s in enumerate(sets)]
    return df.withColumn(_GROUP, F.explode(F.array(*of))).drop(*names)


def scores(results: DataFrame, attempts: DataFrame, sets: list[list[str]], kinds: tuple[str, ...] = ("token", "verifier_call"), scope: str | None = None) -> DataFrame:
    """One row for each grouping set's groups and policy, on grids that a group's policies share.

    Columns: grouping (the set's number), the sets' columns, policy_name, metric_scope, number_of_results, the rates, an
    area by kind and scope (public_token_auc, ...), medians of the first kind by scope, and solve_rate, <kind>_auc and
    median_tokens_to_solution of the scope that counts: hidden if any attempt of the group has a hidden grade, else
    public, as long as none is given. Times are in seconds. All sets, kinds and scopes come from one pass: costs are
    counted by value within the finest keys, and only these counts are repeated for the sets.
    """
    names, keys = sorted({c for s in sets for c in s}), [_GROUP, "policy_name"]
    s, h, o = (F.count_if(c) for c in ("success", "hidden_success", "oracle_hidden_success"))
    fine = results.groupBy(*names, "policy_name").agg(F.count("*").alias("n"), s.alias("s"), h.alias("h"), o.alias("o"), F.count_if(F.col("success") & ~F.col("hidden_success")).alias("over"))
    base = _grouped(fine, sets).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s", "h", "o", "over")])
    present = attempts.groupBy(*names).agg(F.coalesce(F.bool_or(F.col("hidden_passed").isNotNull()), F.lit(False)).alias("any"))
    scopes = _grouped(present, sets).groupBy(_GROUP).agg(F.when(F.bool_or("any"), "hidden").otherwise("public").alias("metric_scope"))
    if scope:
        scopes = scopes.withColumn("metric_scope", F.lit(scope))
    grid = _grouped(attempts.select(*names, _stacked(kinds, 0)).select(*names, "x.*").where("budget >= 0").distinct(), sets)
    grid = grid.union(_grouped(attempts.select(*names).distinct(), sets).select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.lit(0).cast("long").alias("budget"), _GROUP).select(*grid.columns)).distinct()
    paid = results.where("success or hidden_success").select(*names, "policy_name", "success", "hidden_success", _stacked(kinds, 1)).select("*", "x.*").where("budget is not null")
    paid = paid.groupBy(*names, "policy_name", "kind", "budget").agg(F.count_if("success").alias("s"), F.count_if("hidden_success").alias("h"))
    by = [*keys, "kind"]
    none = F.lit(0).cast("long")
    points = base.select(*keys).join(grid, _GROUP).select(*by, "budget", none.alias("s"), none.alias("h"), F.lit(True).alias("on_grid"))
    both = points.union(_grouped(paid, sets).select(*by, "budget", "s", "h", F.lit(False)))
    both = both.groupBy(*by, "budget").agg(F.sum("s").alias("s"), F.sum("h").alias("h"), F.bool_or("on_grid").alias("on_grid"))
    run = ranges.running_sums(ranges.with_ranges(both, by, "budget"), by, "budget", {"public": "s", "hidden": "h"}).join(base.select(*keys, "n"), keys)
    run = run.withColumns({c: F.struct(F.col(c).alias("sum"), (F.col(c) / F.col("n")).alias("rate")) for c in ("public", "hidden")})
    lines = ranges.with_next(run.where("on_grid"), by, "budget", ["budget", "public", "hidden"])
    width = F.col("_next.budget") - F.col("budget")
    unit = F.when(F.col("kind") == "time", 1000.0).otherwise(1.0)
    areas = lines.groupBy(*by).agg(*[(F.coalesce(F.sum(width * (F.col(f"_next.{c}.rate") + F.col(f"{c}.rate")) / 2), F.lit(0.0)) / F.first(unit)).alias(c) for c in ("public", "hidden")])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = areas.groupBy(*keys).agg(*[of(k, c).alias(f"{c}_{k}_auc") for k in kinds for c in ("public", "hidden")])
    # the middle costs of the solutions: where the running count passes the middle places
    count = {"public": F.max("public.sum"), "hidden": F.max("hidden.sum")}
    first_kind = run.where(F.col("kind") == kinds[0])
    ends = first_kind.groupBy(*keys).agg(*[count[c].alias(f"all_{c}") for c in count])
    middle = lambda c, place: F.min(F.when(F.col(f"{c}.sum") > place, F.col("budget")))
    medians = first_kind.join(ends, keys).groupBy(*keys).agg(*[
        ((middle(c, F.floor((F.col(f"all_{c}") - 1) / 2)) + middle(c, F.floor(F.col(f"all_{c}") / 2))) / 2).alias(f"median_tokens_to_{c}_solution") for c in count
    ])
    out = base.join(scopes, _GROUP).join(wide, keys).join(medians, keys, "left")
    counted = F.col("metric_scope") == "hidden"
    chosen = lambda hidden, public: F.when(counted, hidden).otherwise(public)
    share = lambda c: F.col(c) / F.col("n")
    return out.select(
        f"{_GROUP}.*", "policy_name", "metric_scope", F.col("n").alias("number_of_results"),
        chosen(share("h"), share("s")).alias("solve_rate"),
        *[chosen(F.col(f"hidden_{k}_auc"), F.col(f"public_{k}_auc")).alias(f"{k}_auc") for k in kinds],
        chosen(F.col("median_tokens_to_hidden_solution"), F.col("median_tokens_to_public_solution")).alias("median_tokens_to_solution"),
        share("s").alias("public_solve_rate"), share("h").alias("hidden_solve_rate"), share("o").alias("oracle_hidden_solve_rate"),
        (share("s") - share("h")).alias("public_hidden_gap"), share("over").alias("overfit_rate"),
        *[F.col(f"{c}_{k}_auc") for k in kinds for c in ("public", "hidden")], "median_tokens_to_public_solution", "median_tokens_to_hidden_solution",
        F.col("s").alias("solved_count"), F.col("h").alias("hidden_solved_count"), F.col("o").alias("oracle_hidden_solved_count"),
    )


def policy_scores(results: DataFrame, attempts: DataFrame, group: list[str], scope: str | None = None, kinds: tuple[str, ...] = tuple(COSTS)) -> DataFrame:
    """(group, policy_name, n, metric_scope, solve_rate, <kind>_auc) of scores() with one grouping set."""
    one = scores(results, attempts, [group], kinds, scope).withColumnRenamed("number_of_results", "n")
    return one.select(*group, "policy_name", "n", "metric_scope", "solve_rate", *[f"{k}_auc" for k in kinds])


def best_baseline(scores: DataFrame, group: list[str], baselines: tuple[str, ...]) -> DataFrame:
    """The baseline with the highest solve rate, then token area, then the first in the order given."""
    position = F.array_position(F.array(*map(F.lit, baselines)), F.col("policy_name"))
    order = Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.desc("solve_rate"), F.desc("token_auc"), "position")
    return scores.where(F.col("policy_name").isin(*baselines)).withColumn("position", position).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "position")


def relationship(d: Column, d_auc: Column, b: Column, b_auc: Column) -> tuple[Column, Column]:
    """(status, relationship) of a decision policy against a baseline; no solve rate on a side is insufficient data."""
    zero, ahead, strict = (d == 0) & (b == 0), (d > 0) & (d >= b) & (d_auc >= b_auc), (d > b) | (d_auc > b_auc)
    missing = d.isNull() | b.isNull()
    status = F.when(missing, "insufficient_data").when(zero, "inconclusive").when(ahead & strict, "promising").when(ahead, "matches_baseline").otherwise("needs_analysis")
    relation = F.when(missing, "unknown").when(zero, "inconclusive").when(ahead & strict, "win").when(ahead, "tie").otherwise("loss")
    return status, relation


def budget_comparisons(scores: DataFrame, decision: str, baselines: tuple[str, ...], budgets: DataFrame | None = None, group: tuple[str, ...] = ("budget_name",)) -> DataFrame:
    """One row a group: the decision policy against the group's best baseline, in one aggregate of scores.

    The best baseline has the highest solve rate, then token area, then comes first in the order given. budgets adds
    groups that scores may lack.
    """
    position = F.array_position(F.array(*map(F.lit, baselines)), F.col("policy_name"))
    metrics = [F.col("solve_rate").alias("rate"), F.col("token_auc").alias("auc")]
    own = F.max(F.when(F.col("policy_name") == decision, F.struct(*metrics)))
    best = F.max(F.when(F.col("policy_name").isin(*baselines), F.struct(*metrics, (-position).alias("place"), F.col("policy_name").alias("name"))))
    both = scores.groupBy(*group).agg(own.alias("o"), best.alias("b"))
    if budgets is not None:
        both = budgets.join(both, list(group), "left")
    named = both.select(*group, *[F.col(f"o.{k}").alias(f"decision_{k}") for k in ("rate", "auc")], F.col("b.name").alias("baseline"), *[F.col(f"b.{k}").alias(f"baseline_{k}") for k in ("rate", "auc")])
    status, relation = relationship(*map(F.col, ("decision_rate", "decision_auc", "baseline_rate", "baseline_auc")))
    return named.withColumn("status", status).withColumn("relationship", relation)


def _verdict(compared: DataFrame, overall: Column, decision: str) -> DataFrame:
    """One row from comparisons, of which those where overall holds are over all budgets."""
    one = compared.agg(
        *[F.max(F.when(overall, F.col(c))).alias(c) for c in ("baseline", "decision_rate", "decision_auc", "baseline_rate", "baseline_auc")],
        *[F.count_if(~overall & (F.col("relationship") == x)).alias(x) for x in ("win", "tie", "loss")],
        F.count_if(~overall & F.col("relationship").isin("inconclusive", "unknown")).alias("unresolved"),
    )
    d, da, b, ba = map(F.col, ("decision_rate", "decision_auc", "baseline_rate", "baseline_auc"))
    level = (d >= b) & (da >= ba)
    clean = (F.col("loss") == 0) & (F.col("unresolved") == 0)
    value = (
        F.when(d.isNull() | b.isNull(), "insufficient_data").when((d == 0) & (b == 0), "inconclusive").when(level & (F.col("win") > 0) & clean, "promising").when(level & clean, "matches_baseline").otherwise("needs_analysis")
    )
    return one.select(F.lit(decision).alias("decision"), "baseline", d, da, b, ba, "win", "tie", "loss", "unresolved", value.alias("verdict"))


def decided(both: DataFrame, decision: str, baselines: tuple[str, ...]) -> DataFrame:
    """One row: the verdict from scores() by budget (grouping 0) and over all budgets (grouping 1), read once."""
    return _verdict(budget_comparisons(both, decision, baselines, group=("grouping", "budget_name")), F.col("grouping") == 1, decision)


def verdict(overall: DataFrame, per_budget: DataFrame, decision: str, baselines: tuple[str, ...]) -> DataFrame:
    """One row: the overall comparison and the verdict over the comparisons of all budgets."""
    all_ = budget_comparisons(overall.withColumn("all", F.lit(True)), decision, baselines, group=("all",))
    columns = [c for c in all_.columns if c != "all"]
    return _verdict(all_.union(per_budget.select(F.lit(False), *columns)), F.col("all"), decision)


def portfolio_relationship(d: Column, d_auc: Column, b: Column, b_auc: Column) -> Column:
    """The report's rule: a higher solve rate wins whatever the area; the area only breaks ties."""
    return F.when(d.isNull() | b.isNull(), "unknown").when((d > b) | ((d == b) & (d_auc > b_auc)), "win").when((d == b) & (d_auc == b_auc), "tie").otherwise("loss")
