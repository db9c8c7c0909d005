"""The wide summary of an experiment: counts, rates, Pass@k, medians and areas by model, policy and budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.scalars import pass_at_k
from trialspark.operators import curves, ranges
from trialspark.operators.metrics import MISSING, single_value

MODEL = ("model_name", "model_id", "model_tier")
PASS_AT_K = (1, 2, 4, 8, 16, 18)


def named(df: DataFrame) -> DataFrame:
    """df with all of MODEL; a column or value that is missing is `unknown`."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING)) if c in df.columns else F.lit(MISSING) for c in MODEL})


def full_summary(results: DataFrame, attempts: DataFrame, ks: tuple[int, ...] = PASS_AT_K) -> DataFrame:
    """One row for each model, policy and budget; areas on grids that the policies of a model and budget share.

    Medians and areas run over ranges of counted costs, so no task holds a group's values. results have the columns of
    views.results() and may have MODEL, seed, policy_state_scope, and fixed_sample, truncated, graded and hidden_correct
    for Pass@k; without fixed samples it is null.
    """
    results, attempts = named(results), named(attempts)
    keys, c = [*MODEL, "policy_name", "budget_name"], F.col
    has = lambda name, default: c(name) if name in results.columns else F.lit(default)
    eligible = has("fixed_sample", False) & ~has("truncated", False)
    graded, correct = has("graded", 0).cast("long"), has("hidden_correct", 0).cast("long")
    at_k = [F.avg(F.when(eligible & (graded >= k), pass_at_k(graded, correct, F.lit(k).cast("long")))).alias(f"fixed_sample_pass_at_{k}") for k in ks]
    counts = results.groupBy(*keys).agg(
        F.count_distinct("task_id").alias("number_of_tasks"),
        F.count_distinct(F.coalesce(has("seed", None).cast("string"), F.lit(MISSING))).alias("number_of_seeds"),
        single_value(has("policy_state_scope", None).cast("string")).alias("policy_state_scope"),
        *at_k,
        F.sum(has("n_attempts", None) if "n_attempts" in results.columns else c("total_verifier_calls")).alias("total_attempts"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_verifier_calls").alias("total_verifier_calls"),
    )
    calls = ranges.medians(results, keys, {
        "median_verifier_calls_to_solution": F.when(c("success"), c("decision_verifier_calls")),
        "median_verifier_calls_to_hidden_solution": F.when(c("hidden_success"), c("decision_verifier_calls")),
    })
    scored = curves.scores(results, attempts, [[*MODEL, "budget_name"]]).drop("grouping", "metric_scope", "solve_rate", "token_auc", "verifier_call_auc", "median_tokens_to_solution")
    renamed = {"public_token_auc": "token_auc", "public_verifier_call_auc": "verifier_call_auc", "median_tokens_to_public_solution": "median_tokens_to_solution"}
    wide = reduce(lambda a, b: a.join(b, keys), [scored.withColumnsRenamed(renamed).withColumn("solve_rate", c("public_solve_rate")), counts, calls])
    order = [
        *keys, "number_of_results", "number_of_tasks", "number_of_seeds", "policy_state_scope", "solved_count", "solve_rate", "public_solve_rate", "hidden_solved_count", "hidden_solve_rate",
        "oracle_hidden_solved_count", "oracle_hidden_solve_rate", *[f"fixed_sample_pass_at_{k}" for k in ks], "public_hidden_gap", "overfit_rate", "median_tokens_to_solution",
        "median_tokens_to_hidden_solution", "median_verifier_calls_to_solution", "median_verifier_calls_to_hidden_solution", "token_auc", "verifier_call_auc", "hidden_token_auc",
        "hidden_verifier_call_auc", "total_attempts", "total_tokens", "total_verifier_calls",
    ]
    return wide.select(*order)
