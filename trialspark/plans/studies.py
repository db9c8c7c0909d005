"""Whole studies: configuration, run grid, summary, decision, and reports from small result tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import curves, metrics, trajectory
from trialspark.sources import lines


@dataclass(frozen=True)
class Config:
    """An experiment: names must be there and unique, the decision policy among the policies, at least one baseline."""

    experiment_id: str
    models: list[dict]
    budgets: list[dict]
    policies: list[str]
    seeds: list[int]
    tasks: list[str]
    decision_policy: str
    baselines: list[str] = field(default_factory=list)

    def __post_init__(self):
        for name, values in (("models", [m["name"] for m in self.models]), ("budgets", [b["name"] for b in self.budgets]), ("policies", self.policies), ("seeds", self.seeds), ("tasks", self.tasks)):
            if not values or len(set(values)) != len(values):
                raise ValueError(f"{name} must be there, each once")
        if self.decision_policy not in self.policies or not self.baselines or not set(self.baselines) <= set(self.policies):
            raise ValueError("the decision policy and at least one baseline must be among the policies")
        for b in self.budgets:
            if not any(b.get(k) is not None for k in ("max_attempts", "max_tokens", "max_verifier_calls", "max_seconds")):
                raise ValueError(f"budget {b['name']} has no limit")


def read_config(text: str) -> Config:
    return Config(**json.loads(text))


def gated_models(config: Config, real_models: bool = False, unsandboxed: bool = False) -> tuple[list[dict], list[dict]]:
    """(run, skipped): disabled models, real ones without leave, and those that execute code without acknowledgement are skipped."""
    run, skipped = [], []
    for m in config.models:
        why = "disabled" if not m.get("enabled", True) else "real_model" if m.get("real") and not real_models else "unsandboxed" if m.get("real") and not unsandboxed else None
        (skipped if why else run).append(m | ({"reason": why} if why else {}))
    return run, skipped


def run_grid(spark: SparkSession, config: Config, models: list[dict]) -> DataFrame:
    """(run, model, seed, budget, policy, task_id): every combination, in nested order; a list is small, its product is not."""
    lists = {"model": [m["name"] for m in models], "seed": config.seeds, "budget": [b["name"] for b in config.budgets], "policy": config.policies, "task_id": config.tasks}
    total = 1
    for v in lists.values():
        total *= len(v)
    frame, below = spark.range(total).withColumnRenamed("id", "run"), total
    for name, values in lists.items():
        below //= max(len(values), 1)
        frame = frame.withColumn(name, F.get(F.array(*map(F.lit, values)), (F.floor(F.col("run") / below) % len(values)).cast("int")))
    return frame


def summary_and_decision(results: DataFrame, attempts: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The wide summary by (policy, budget) with its areas, and the verdict over all budgets, from one pass over costs."""
    both = curves.scores(results, attempts, [["budget_name"], []])
    per = both.where("grouping = 0")
    wide = metrics.experiment_summary(results, ["policy_name", "budget_name"]).join(per.select("policy_name", "budget_name", "token_auc", "verifier_call_auc"), ["policy_name", "budget_name"])
    return wide, curves.decided(both, config.decision_policy, tuple(config.baselines))


def markdown_table(df: DataFrame, order: list[str], limit: int = 200) -> str:
    """The first `limit` rows in order as a Markdown table; for result tables, which are small."""
    shown = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = df.orderBy(*order).limit(limit).collect()
    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *(f"| {' | '.join(map(shown, r))} |" for r in rows)])


def experiment_report(title: str, summary: DataFrame, decision: DataFrame, failures: DataFrame) -> str:
    parts = [f"# {title}", "## Decision", markdown_table(decision, ["decision"]), "## Summary", markdown_table(summary, ["budget_name", "policy_name"]), "## Failures", markdown_table(failures, ["task_id", "policy_name"])]
    return "\n\n".join(parts) + "\n"


def portfolio_failures(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """(run, task_id, policy_name, last_error, line, record): the failures of all runs whose folders pattern matches.

    One scan for all runs; fields that only some runs have are in record. Of failures with the same keys, the first in
    its file stays.
    """
    text = lambda f: F.try_variant_get("record", f"$.{f}", "string").alias(f)
    keys = ["task_id", "policy_name", "last_error"]
    rows = lines.runs(spark, pattern, name).select("run", "line", "record", *map(text, keys))
    first = rows.groupBy("run", *keys).agg(F.min("line").alias("line"))
    return rows.join(first.select("run", "line"), ["run", "line"], "left_semi")


def portfolio_report(runs: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> str:
    """Decisions, summaries and failures of several runs; a failure named twice by run, task, policy and error comes once."""
    parts = ["# Portfolio"]
    for name in sorted(runs):
        summary, decision, failures = runs[name]
        keys = ["task_id", "policy_name", "last_error"]
        position = [c for c in failures.columns if c not in keys] or keys
        once = lines.first_of_each(failures, keys, position)
        parts += [f"## {name}", markdown_table(decision, ["decision"]), markdown_table(summary, ["budget_name", "policy_name"]), markdown_table(once, ["task_id", "policy_name"])]
    return "\n\n".join(parts) + "\n"


def trajectory_study(observed: DataFrame, pools: list[str], max_calls: int, seed: int = 0, resamples: int = 10_000) -> dict[str, DataFrame]:
    """policies, comparisons with the first of pools, and their ranking, with seeded intervals.

    pools are width x depth, like 16x1; the first is the baseline and must have depth 1.
    """
    if len(set(pools)) != len(pools) or not pools or not pools[0].endswith("x1"):
        raise ValueError("the first pool must be of depth 1, and each named once")
    summary = trajectory.policy_summary(observed.where(F.col("pool_id").isin(pools)), max_calls)
    policies = summary.join(trajectory.policy_intervals(observed, pools, seed, resamples), "pool_id")
    out = {"policies": policies, "ranking": trajectory.ranking(summary)}
    if pools[1:]:
        each = [trajectory.paired_comparison(observed, pools[0], c) for c in pools[1:]]
        pairs = each[0]
        for more in each[1:]:
            pairs = pairs.union(more)
        out["comparisons"] = pairs.join(trajectory.comparison_intervals(observed, pools[0], pools[1:], seed, resamples), ["baseline", "challenger"])
        outcome = trajectory.confirmation(F.col("hidden_difference"), F.col("hidden_ci_low"))
        out["confirmations"] = out["comparisons"].select("baseline", "challenger", outcome.alias("outcome"))
    return out


def trajectory_report(title: str, study: dict[str, DataFrame]) -> str:
    """Policies, comparisons, ranking and outcomes of a trajectory_study() as Markdown."""
    orders = {"policies": ["pool_id"], "comparisons": ["challenger"], "ranking": ["rank"], "confirmations": ["challenger"]}
    parts = [f"# {title}"]
    for name, order in orders.items():
        if name in study:
            parts += [f"## {name.capitalize()}", markdown_table(study[name], order)]
    return "\n\n".join(parts) + "\n"


def pool_report(title: str, diagnostics: DataFrame, summaries: DataFrame, comparisons: DataFrame, gains: DataFrame, stopping: DataFrame) -> str:
    """A pool's diagnostics, selectors, pairs, coverage and stopping as Markdown."""
    parts = [f"# {title}", "## Pool", markdown_table(diagnostics, ["n_candidates"]), "## Selectors", markdown_table(summaries, ["selector_name", "k"])]
    parts += ["## Comparisons", markdown_table(comparisons, ["challenger", "k"]), "## Coverage", markdown_table(gains, ["k"]), "## Stopping", markdown_table(stopping, ["k"])]
    return "\n\n".join(parts) + "\n"


def write_new(path: str, text: str) -> None:
    """Write a report on the driver; an artifact that is there is never overwritten."""
    with Path(path).open("x", encoding="utf-8") as f:
        f.write(text)


def plotted_points(curve: DataFrame, points: int = 1_000) -> DataFrame:
    """The last point of a curve in each of `points` equal ranges of its budgets, with the first point: what a picture can show."""
    ends = curve.groupBy("policy_name").agg(F.min("budget").alias("_lo"), F.max("budget").alias("_hi"))
    range_ = F.when(F.col("budget") == F.col("_lo"), -1).otherwise(F.floor((F.col("budget") - F.col("_lo")) * points / (F.col("_hi") - F.col("_lo") + 1)))
    last = curve.join(F.broadcast(ends), "policy_name").withColumn("_range", range_).groupBy("policy_name", "_range")  # a row a policy
    return last.agg(F.max(F.struct("budget", "success_rate")).alias("p")).select("policy_name", "p.*")


def plot_curves(curve: DataFrame, path: str) -> bool:
    """A picture of success curves by policy, if matplotlib is there; whether it was drawn."""
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return False
    frame = plotted_points(curve).orderBy("policy_name", "budget").toPandas()
    for name, own in frame.groupby("policy_name"):
        plt.step(own["budget"], own["success_rate"], where="post", label=name)
    plt.legend()
    plt.savefig(path)
    plt.close()
    return True


#: Replies that a scripted provider gives for each policy, the last one again and again: for dry runs.
SCRIPTS = {
    "greedy": ["return wrong"],
    "best_of_n": ["return wrong", "return right"],
    "repair_only": ["return wrong", "return right"],
    "plan_then_code": ["first add, then return", "return right"],
}


def scripted(calls: DataFrame, max_tokens: int) -> DataFrame:
    """calls (policy, call) with `reply`: the call's script entry, the last one beyond its end, cut to the token limit."""
    from trialspark.functions.scalars import truncated

    reply = F.lit(None).cast("string")
    for name, script in SCRIPTS.items():
        at = F.least(F.col("call"), F.lit(len(script) - 1)).cast("int")
        reply = F.when(F.col("policy") == name, F.get(F.array(*map(F.lit, script)), at)).otherwise(reply)
    return calls.withColumn("reply", truncated(reply, max_tokens))
