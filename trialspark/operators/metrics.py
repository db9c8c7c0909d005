"""Rates and costs over results and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_rate, pass_at_k, rate
from trialspark.operators import ranges

MISSING = "unknown"
#: Slices in which copies of a code are summed before they meet.
COPY_SLICES = 64


def hidden_pass(public: Column, hidden: Column) -> Column:
    """A hidden pass counts only with the public one; a missing label is no pass."""
    return F.coalesce(public & hidden, F.lit(False))


def decision_cost(decision: Column, selected_cumulative: Column) -> Column:
    """The result's own decision cost if it has one, else the selected attempt's cumulative cost."""
    return F.coalesce(decision, selected_cumulative)


def should_grade_hidden(error_type: Column, operator: Column) -> Column:
    """Plans are not graded."""
    return (F.coalesce(error_type, F.lit("")) != "not_verified_plan") & ~operator.endswith("/plan")


def metric_scope(hidden_present: Column) -> Column:
    """hidden if any attempt has a hidden grade, else public."""
    return F.when(F.coalesce(F.bool_or(hidden_present), F.lit(False)), "hidden").otherwise("public")


def single_value(c: Column) -> Column:
    """The one value of a group, or mixed; null counts as unknown."""
    v = F.coalesce(c, F.lit(MISSING))
    return F.when(F.count_distinct(v) == 1, F.min(v)).otherwise("mixed")


def rate_columns() -> dict[str, Column]:
    """Aggregates over results: success, hidden_success, oracle_hidden_success."""
    s, h, o = F.col("success"), F.col("hidden_success"), F.col("oracle_hidden_success")
    return {
        "solve_rate": rate(s),
        "hidden_solve_rate": rate(h),
        "oracle_hidden_solve_rate": rate(o),
        "public_hidden_gap": rate(s) - rate(h),
        "overfit_rate": rate(s & ~h),
    }


def solve_rates(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.count("*").alias("n_results"), *[c.alias(n) for n, c in rate_columns().items()])


#: Costs whose medians over the results with a solution are taken: name -> (which results, cost, unit).
MEDIANS = {
    "median_tokens_to_solution": ("success", "decision_tokens", 1),
    "median_calls_to_solution": ("success", "decision_verifier_calls", 1),
    "median_tokens_to_hidden_solution": ("hidden_success", "decision_tokens", 1),
    "median_calls_to_hidden_solution": ("hidden_success", "decision_verifier_calls", 1),
    "median_tokens_to_oracle_hidden": (None, "oracle_hidden_tokens", 1),
    "median_calls_to_oracle_hidden": (None, "oracle_hidden_calls", 1),
    "median_seconds_to_solution": ("success", "decision_ms", 1000),
    "median_seconds_to_hidden_solution": ("hidden_success", "decision_ms", 1000),
    "median_seconds_to_oracle_hidden": (None, "oracle_hidden_ms", 1000),
}


def solution_costs(results: DataFrame, keys: list[str]) -> DataFrame:
    """Medians by keys: interpolated, null without a solution. The oracle's cost is its own attempt's."""
    values = {n: F.when(F.col(of), F.col(cost)) if of else F.col(cost) for n, (of, cost, _) in MEDIANS.items()}
    out = ranges.medians(results, keys, values)
    return out.withColumns({n: F.col(n) / unit for n, (_, _, unit) in MEDIANS.items() if unit != 1})


def fixed_sample_pass_at_k(results: DataFrame, ks: list[int], keys: list[str]) -> DataFrame:
    """Mean Pass@k by keys over eligible results: flagged as fixed samples, not cut by the budget, k graded attempts."""
    each = results.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])))
    eligible = F.col("fixed_sample") & ~F.col("truncated") & (F.col("graded") >= F.col("k"))
    value = F.when(eligible, pass_at_k(F.col("graded"), F.col("hidden_correct"), F.col("k")))
    return each.withColumn("v", value).groupBy(*keys, "k").agg(F.count("v").alias("eligible"), F.avg("v").alias("mean_pass_at_k"))


def experiment_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rates, medians of costs and totals of results by keys."""
    seed = F.coalesce(F.col("seed").cast("string"), F.lit(MISSING)) if "seed" in results.columns else F.lit(MISSING)
    counts = results.groupBy(*keys).agg(
        F.count("*").alias("n_results"),
        F.count_distinct("task_id").alias("n_tasks"),
        F.count_distinct(seed).alias("n_seeds"),
        *[c.alias(n) for n, c in rate_columns().items()],
        F.sum("total_tokens").alias("sum_tokens"),
        F.avg("total_tokens").alias("mean_tokens"),
        F.sum("total_verifier_calls").alias("sum_verifier_calls"),
        F.avg("total_verifier_calls").alias("mean_verifier_calls"),
        (F.sum("total_ms") / 1000).alias("sum_seconds"),
        (F.avg("total_ms") / 1000).alias("mean_seconds"),
    )
    return counts.join(solution_costs(results, keys), keys)


def pool_diagnostics(candidates: DataFrame, hidden: DataFrame, cap: int, pilot: tuple[int, int] = (5, 4), parts: int | None = None) -> DataFrame:
    """Counts and rates over a whole pool; the pilot gate is null unless the pool has the pilot's tasks and size.

    A task's few labels are joined as one list by task alone, where candidates and labels are dealt by task. Rows are then
    summed by the code's digest, in `parts` partitions, copies of a code by slices first, and tasks are counted by their
    first rows: no task holds more of either as the pool grows, if parts grow with it.
    """
    index, blank, capped = F.col("candidate_index"), F.col("code").rlike(r"^\s*$"), F.col("output_tokens") >= cap
    labels = hidden.groupBy("task_id").agg(F.collect_list(F.struct(index, "plus_passed")).alias("_labels"))
    labelled = candidates.join(labels, "task_id").withColumn("_label", F.explode(F.filter("_labels", lambda x: x["candidate_index"] == index)))
    first = F.row_number().over(Window.partitionBy("task_id").orderBy("candidate_index")) == 1
    flags = {"empty_code": blank, "at_cap": capped, "base": F.col("base_passed"), "plus": F.col("_label.plus_passed")}
    digest = F.unhex(F.sha2(F.col("code").cast("binary"), 256)).alias("_code")
    slice_ = F.pmod(F.xxhash64("task_id"), F.lit(COPY_SLICES)).alias("_slice")
    rows = labelled.select(digest, slice_, first.alias("_first"), *[c.alias(n) for n, c in flags.items()], "total_tokens")
    counts = {"n": F.count("*"), "tasks": F.count_if("_first"), "tokens": F.sum("total_tokens")} | {f"{n}_of": F.count(n) for n in flags} | {n: F.count_if(n) for n in flags}
    dealt = [parts] if parts else []
    by_slice = rows.repartition(*dealt, "_code", "_slice").groupBy("_code", "_slice").agg(*[c.alias(n) for n, c in counts.items()])
    by_code = by_slice.repartition(*dealt, "_code").groupBy("_code").agg(*[F.sum(n).alias(n) for n in counts])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    share = lambda n: F.coalesce(F.try_divide(F.sum(n).cast("double"), F.sum(f"{n}_of").cast("double")), F.lit(0.0))
    out = by_code.agg(
        total("n").alias("n_candidates"),
        total("tasks").alias("n_tasks"),
        total("empty_code").alias("empty_code"),
        share("empty_code").alias("empty_code_rate"),
        total("at_cap").alias("at_cap"),
        share("at_cap").alias("at_cap_rate"),
        F.count("_code").alias("unique_codes"),
        share("base").alias("base_rate"),
        share("plus").alias("plus_rate"),
        F.sum("tokens").alias("sum_tokens"),
    )
    is_pilot = (F.col("n_tasks") == pilot[0]) & (F.col("n_candidates") == pilot[0] * pilot[1])
    return out.withColumn("pilot_gate", F.when(is_pilot, (F.col("empty_code") == 0) & (F.col("base_rate") > 0)))


def operator_statistics(attempts: DataFrame, operator: str, cost: str) -> DataFrame:
    """Runs, successes, costs and the last error of each operator."""
    return attempts.groupBy(operator).agg(
        F.count("*").alias("n"),
        F.count_if("success").alias("successes"),
        F.sum(cost).alias("total_cost"),
        F.avg(as_rate(F.col("success"))).alias("mean_success"),
        F.avg(cost).alias("mean_cost"),
        F.max_by("error_type", "position").alias("last_error_type"),
    )


def result_model(attempts: DataFrame, default: str) -> DataFrame:
    """(task_id, policy_name, budget_name, model): the first attempt's model that is there, else the default."""
    first = F.min_by("model_id", F.when(F.col("model_id").isNotNull(), F.col("attempt_index")))
    return attempts.groupBy("task_id", "policy_name", "budget_name").agg(F.coalesce(first, F.lit(default)).alias("model"))


def model_summary(results: DataFrame, models: DataFrame) -> DataFrame:
    """Counts, solve rate, medians and totals by policy and model; number_of_tasks counts results, not distinct tasks.

    models is (task_id, policy_name, budget_name, model), as result_model() makes it.
    """
    s, median = F.col("success"), lambda c: F.percentile(c, 0.5)
    named = results.join(models, ["task_id", "policy_name", "budget_name"])
    return named.groupBy("policy_name", "model").agg(
        F.count("*").alias("number_of_tasks"),
        F.count_if(s).alias("solved_count"),
        rate(s).alias("solve_rate"),
        median(F.when(s, F.col("decision_tokens"))).alias("median_tokens_to_solution"),
        median(F.when(s, F.col("decision_verifier_calls"))).alias("median_calls_to_solution"),
        F.sum("total_verifier_calls").alias("total_attempts"),
        F.sum("total_tokens").alias("sum_tokens"),
    )


def graded_attempts(attempts: DataFrame, grades: DataFrame) -> DataFrame:
    """attempts with hidden_passed, by (task_id, candidate_index) of grades (.., plus_passed).

    It counts only with the public pass. An attempt that no grade can be traced to is an error, so no label is guessed.
    """
    of = grades.select("task_id", "candidate_index", "plus_passed")
    joined = attempts.join(of, ["task_id", "candidate_index"], "left")
    where = F.concat(F.lit("no grade for task "), F.col("task_id").cast("string"), F.lit(", candidate "), F.col("candidate_index").cast("string"))
    traced = F.when(F.col("plus_passed").isNull(), F.raise_error(where).cast("boolean")).otherwise(F.col("plus_passed"))
    return joined.withColumn("hidden_passed", hidden_pass(F.col("base_passed"), traced)).drop("plus_passed")


def has_hidden_tests(tasks: DataFrame) -> Column:
    """Whether a task has hidden tests, in its column or among what its verifier may read."""
    listed = F.coalesce(F.size("hidden_tests"), F.lit(0)) > 0 if "hidden_tests" in tasks.columns else F.lit(False)
    named = F.coalesce(F.element_at("allowed_verifier_inputs", "hidden_tests"), F.lit("")) != "" if "allowed_verifier_inputs" in tasks.columns else F.lit(False)
    return listed | named


def flattened_attempts(results: DataFrame, attempts: str = "attempts") -> DataFrame:
    """One row an attempt of nested results, with its place and its parent's keys."""
    keys = [c for c in results.columns if c != attempts]
    return results.select(*keys, F.posexplode(attempts).alias("attempt_index", "_a")).select(*keys, F.col("attempt_index").cast("long"), "_a.*")


def failure_examples(results: DataFrame, attempts: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """The first `limit` results without success, in order of keys, with their last attempt's error."""
    last = attempts.groupBy(*keys).agg(F.max_by("error_type", "attempt_index").alias("last_error"), F.max("attempt_index").alias("last_index"))
    return results.where(~F.col("success")).join(last, keys).orderBy(*keys).limit(limit).select(*keys, "last_error", "last_index")


def first_in_order(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row with the least position for each key: duplicates dropped, the first kept."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where("_r = 1").drop("_r")
