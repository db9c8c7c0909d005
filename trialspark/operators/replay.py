"""Search policies replayed over a frozen pool, and the ledger that admits attempts, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _task(*order: str):
    return Window.partitionBy("task_id").orderBy(*(order or ("candidate_index",)))


def greedy(pool: DataFrame) -> DataFrame:
    """One attempt a task, selected if it passes."""
    return pool.where("candidate_index = 0").withColumn("selected", F.col("base_passed"))


def best_of_n(pool: DataFrame, n: int) -> DataFrame:
    """Attempts up to the first pass, or n; the pass is selected."""
    before = F.coalesce(F.max(F.col("base_passed").cast("int")).over(_task().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pool.where(F.col("candidate_index") < n).withColumn("_b", before).where("_b = 0").drop("_b").withColumn("selected", F.col("base_passed"))


def sample_n(pool: DataFrame, n: int) -> DataFrame:
    """All n attempts; the first is selected whether it passes or not, and the decision costs all of them."""
    return pool.where(F.col("candidate_index") < n).withColumn("selected", F.col("candidate_index") == 0)


def replay_result(attempts: DataFrame, whole_cost: bool = False) -> DataFrame:
    """(task_id, calls, tokens, success, selected_index, decision_tokens, decision_calls) of a replay."""
    upto = F.sum("total_tokens").over(_task().rowsBetween(Window.unboundedPreceding, 0))
    summed = attempts.withColumn("cumulative", upto)
    chosen = F.max(F.when(F.col("selected"), F.col("candidate_index")))
    return summed.groupBy("task_id").agg(
        F.count("*").alias("calls"),
        F.sum("total_tokens").alias("tokens"),
        F.bool_or(F.col("selected") & F.col("base_passed")).alias("success"),
        chosen.alias("selected_index"),
        (F.sum("total_tokens") if whole_cost else F.max(F.when(F.col("selected"), F.col("cumulative")))).alias("decision_tokens"),
        (F.count("*") if whole_cost else chosen + 1).cast("long").alias("decision_calls"),
    )


def width_depth_steps(pool: DataFrame, width: int, depth: int) -> DataFrame:
    """The steps of a width-by-depth search that replays the pool in order.

    Roots come first, one a round; then depth by depth one repair of each root's latest node. The n-th step takes the
    pool's n-th candidate; a publicly passing step is selected and is the task's last.
    """
    return shaped_steps(pool, [(width, depth)])


def shaped_steps(pool: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """The steps of width_depth_steps() of each shape (width, depth), the pool being replayed once for all of them."""
    index = F.col("candidate_index")

    def placed(width: int, depth: int) -> Column:
        level = F.floor(index / width).cast("long")
        step = F.struct(
            F.lit(f"{width}x{depth}").alias("pool_id"),
            F.when(level == 0, "sample").otherwise("repair").alias("operator"),
            (index % width).alias("root_index"),
            level.alias("depth"),
            F.when(level == 0, index).otherwise(F.lit(width) + level - 1).alias("round_index"),
            F.when(level > 0, index - width).alias("parent_candidate_index"),
        )
        return F.when(index < width * depth, step)

    steps = best_of_n(pool, max(w * d for w, d in shapes))
    each = steps.withColumn("_p", F.explode(F.array_compact(F.array(*[placed(w, d) for w, d in shapes]))))
    place = [F.col(f"_p.{c}") for c in ("operator", "root_index", "depth", "round_index", "parent_candidate_index")]
    return each.select("_p.pool_id", "task_id", "candidate_index", *place, "selected", "base_passed", "input_tokens", "output_tokens", "total_tokens", "code")


def admitted(attempts: DataFrame, keys: list[str], max_attempts: int | None = None, max_tokens: int | None = None, max_calls: int | None = None, discard_overshoot: bool = False) -> DataFrame:
    """The attempts a ledger admits, in order of attempt_index: those before the first that it turns away.

    An attempt is turned away if attempts or calls are spent, or unless tokens spent so far plus its prompt's tokens
    are below the limit. With discard_overshoot an attempt that would pass the token limit is turned away as well;
    without, it is charged.
    """
    own = Window.partitionBy(*keys).orderBy("attempt_index")
    spent = F.coalesce(F.sum("total_tokens").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = F.row_number().over(own) - 1
    ok = F.lit(True)
    if max_attempts is not None:
        ok &= done < max_attempts
    if max_calls is not None:
        ok &= done < max_calls
    if max_tokens is not None:
        ok &= spent + F.col("input_tokens") < max_tokens
        if discard_overshoot:
            ok &= spent + F.col("total_tokens") <= max_tokens
    marked = attempts.withColumn("_ok", ok)
    refused = F.sum((~F.col("_ok")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_refused", refused).where("_refused = 0").drop("_ok", "_refused")


def sampling_limit(max_output_tokens: Column, requested: Column, remaining: Column) -> Column:
    """The output tokens a generation may use: the least of what is set, what is asked and what is left, 1 at least."""
    return F.greatest(F.least(max_output_tokens, requested, remaining), F.lit(1))


#: What an error adds to an operator's score: fixed values.
ERROR_BONUSES = {
    "syntax_error": {"repair_from_error": 0.25},
    "wrong_answer": {"repair_from_error": 0.15, "plan_then_code": 0.10},
    "test_failure": {"repair_from_error": 0.15, "plan_then_code": 0.10},
    "timeout": {"local_revision": 0.15, "plan_then_code": 0.10},
    "duplicate": {"direct_sample": 0.10, "plan_then_code": 0.10},
    "no_progress": {"direct_sample": 0.10, "plan_then_code": 0.10},
}


def error_bonus(error_type: Column, operator: Column) -> Column:
    found = F.lit(0.0)
    for error, bonuses in ERROR_BONUSES.items():
        for name, value in bonuses.items():
            found = F.when((error_type == error) & (operator == name), value).otherwise(found)
    return found


def step_cost(metric: str, tokens: Column, calls: Column, seconds: Column, epsilon: float = 1e-9) -> Column:
    """What a step cost: tokens fall back to calls if none were used, and every cost is positive."""
    at_least_one = F.greatest(calls, F.lit(1)).cast("double")
    return {"tokens": F.when(tokens > 0, tokens.cast("double")).otherwise(at_least_one), "verifier_calls": at_least_one, "unit": F.lit(1.0), "wall_clock_seconds": F.greatest(seconds, F.lit(epsilon))}[metric]


def ucb_scores(stats: DataFrame, group: list[str], exploration: float = 1.0, cost_weight: float = 0.05, epsilon: float = 1e-9) -> DataFrame:
    """stats (group, operator, n, mean_success, mean_cost, last_error) with step, bonus and score."""
    step = F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy(*group)) + 1)
    discount = F.greatest(1.0 + cost_weight * F.log1p(F.greatest(F.col("mean_cost"), F.lit(0.0))), F.lit(epsilon))
    explore = exploration * F.sqrt(F.log(F.col("step") + 1) / (1 + F.col("n")))
    scored = stats.withColumn("step", step).withColumn("bonus", error_bonus(F.col("last_error"), F.col("operator")))
    return scored.withColumn("score", F.col("mean_success") / discount + explore + F.col("bonus"))


def chosen_arms(scored: DataFrame, group: list[str], position: str, exploration: float = 1.0) -> DataFrame:
    """The arm each group takes, the first on ties: an untried one with the largest bonus, else the one with the highest score.

    Untried arms come first only where there is exploration; without it they compete by their scores.
    """
    untried = (F.col("n") == 0) & F.lit(exploration > 0)
    order = Window.partitionBy(*group).orderBy(F.desc(untried), F.when(untried, F.col("bonus")).otherwise(F.col("score")).desc(), position)
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
