"""Search policies that carry state from one attempt to the next, over a replayed pool.

The n-th generation of a task is the pool's n-th candidate, so a policy decides only what to ask for and when to stop.
A group handed to Python is a task's few candidates, or a run's tasks where the state lives as long as a run; what is
sequential by nature runs in one group, and groups run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators.replay import ERROR_BONUSES

ARMS = ("direct_sample", "repair_from_error", "plan_then_code", "local_revision")
STEPS = "operator string, attempt_index long, candidate_index long, verified boolean, passed boolean, error_type string, cumulative_tokens long, cumulative_calls long, selected boolean"
ARROW_STEPS = [(name, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[kind]) for name, kind in (c.split() for c in STEPS.split(","))]
#: Scopes whose candidates a worker holds as Python values at a time.
SCOPES = 64


@dataclass
class Limits:
    """A budget; None is no limit."""

    attempts: int | None = None
    tokens: int | None = None
    calls: int | None = None


@dataclass
class Search:
    """One task's ledger over its candidates (dicts in order of candidate_index)."""

    candidates: list[dict]
    limits: Limits
    discard: bool = True
    steps: list[dict] = field(default_factory=list)
    tokens: int = 0
    calls: int = 0

    def may(self, verify: bool) -> bool:
        """Whether a generation is admitted: limits not reached, and its prompt fits below the token limit."""
        if len(self.steps) >= len(self.candidates):
            return False
        limit, prompt = self.limits, self.candidates[len(self.steps)]["input_tokens"]
        return not (
            (limit.attempts is not None and len(self.steps) >= limit.attempts)
            or (verify and limit.calls is not None and self.calls >= limit.calls)
            or (limit.tokens is not None and self.tokens + prompt >= limit.tokens)
        )

    def generate(self, operator: str, verify: bool = True) -> dict | None:
        """The next attempt, or None if it is not admitted or would overshoot the tokens where that discards it."""
        if not self.may(verify):
            return None
        one = self.candidates[len(self.steps)]
        if self.discard and self.limits.tokens is not None and self.tokens + one["total_tokens"] > self.limits.tokens:
            return None
        self.tokens += one["total_tokens"]
        self.calls += verify
        passed = bool(verify and one["base_passed"])
        error = None if passed else "wrong_answer" if verify else "not_verified_plan"
        step = {
            "operator": operator, "attempt_index": len(self.steps), "candidate_index": one["candidate_index"], "verified": verify, "passed": passed,
            "error_type": error, "cumulative_tokens": self.tokens, "cumulative_calls": self.calls, "selected": passed,
        }
        self.steps.append(step)
        return step

    def open(self) -> bool:
        limit = self.limits
        return not (
            (limit.attempts is not None and len(self.steps) >= limit.attempts)
            or (limit.calls is not None and self.calls >= limit.calls)
            or (limit.tokens is not None and self.tokens >= limit.tokens)
        )


def draft_then(operator: str, follow: str, tries: int = 1):
    """A draft, then up to `tries` more attempts that each build on the last, until one passes."""

    def run(search: Search, state: dict) -> None:
        step = search.generate(f"{operator}/draft")
        for _ in range(tries):
            if step is None or step["passed"]:
                return
            step = search.generate(f"{operator}/{follow}")

    return run


def plan_then_code(search: Search, state: dict) -> None:
    if search.generate("plan_then_code/plan", verify=False):
        search.generate("plan_then_code/code")


def _apply(arm: str, search: Search) -> None:
    if arm == "plan_then_code":
        plan_then_code(search, {})
    else:
        search.generate(arm)


def _ready(arm: str, search: Search) -> bool:
    if arm in ("repair_from_error", "local_revision") and not search.steps:
        return False
    return search.may(verify=arm != "plan_then_code")


def score(stats: dict, step: int, bonus: float, exploration: float, cost_weight: float, epsilon: float) -> float:
    mean_success = stats["successes"] / stats["n"] if stats["n"] else 0.0
    mean_cost = stats["cost"] / stats["n"] if stats["n"] else 0.0
    return mean_success / max(1 + cost_weight * math.log1p(max(mean_cost, 0.0)), epsilon) + exploration * math.sqrt(math.log(step + 1) / (1 + stats["n"])) + bonus


def bandit(exploration: float = 1.0, cost_weight: float = 0.1, epsilon: float = 1e-6, metric: str = "tokens", bonuses: dict | None = None):
    """Cost-normalised UCB over ARMS: untried arms first, by bonus, then the highest score; the first arm on ties."""
    table = ERROR_BONUSES if bonuses is None else bonuses

    def run(search: Search, state: dict) -> None:
        stats = state.setdefault("arms", {a: {"n": 0, "successes": 0, "cost": 0.0} for a in ARMS})
        while search.open():
            ready = [a for a in ARMS if _ready(a, search)]
            if not ready:
                return
            error = search.steps[-1]["error_type"] if search.steps else None
            bonus = lambda a: table.get(error, {}).get(a, 0.0)  # noqa: B023, E731
            untried = [a for a in ready if not stats[a]["n"]] if exploration > 0 else []
            step = sum(s["n"] for s in stats.values()) + 1
            arm = max(untried, key=bonus) if untried else max(ready, key=lambda a: score(stats[a], step, bonus(a), exploration, cost_weight, epsilon))  # noqa: B023
            before, tokens, calls = len(search.steps), search.tokens, search.calls
            _apply(arm, search)
            made = search.steps[before:]
            if not made:
                return
            spent = search.calls - calls
            cost = 1.0 if metric == "unit" else float(max(spent, 1)) if metric == "verifier_calls" or search.tokens == tokens else float(search.tokens - tokens)
            success = any(s["passed"] for s in made)
            own = stats[arm]
            own["n"], own["successes"], own["cost"] = own["n"] + 1, own["successes"] + success, own["cost"] + cost
            if success:
                return

    return run


def fixed_order(search: Search, state: dict) -> None:
    """ARMS in turn, those that cannot run skipped, nothing learned."""
    at = 0
    while search.open():
        arm = next((a for k in range(len(ARMS)) if _ready(a := ARMS[(at + k) % len(ARMS)], search)), None)
        if arm is None:
            return
        at = (ARMS.index(arm) + 1) % len(ARMS)
        before = len(search.steps)
        _apply(arm, search)
        if len(search.steps) == before or any(s["passed"] for s in search.steps[before:]):
            return


def behaviour_select(n: int = 4):
    """n samples; the medoid of the larger cluster of behaviours is selected, pass or not."""

    def run(search: Search, state: dict) -> None:
        while len(search.steps) < n and search.generate("behaviour_select/sample"):
            pass
        _select(search, public_tie_break=False)

    return run


def controller(low: int = 2, high: int = 4, threshold: float = 0.75):
    """low samples; none passing asks for a repair, split behaviour for samples up to high, agreement stops."""

    def run(search: Search, state: dict) -> None:
        from trialspark.operators.clustering import consensus, ratio

        while len(search.steps) < low and search.generate("controller/sample"):
            pass
        passes = sum(s["passed"] for s in search.steps)
        agreed = bool(search.steps) and ratio(consensus(_traces(search))[1]) >= threshold
        if not passes:
            if search.steps:
                search.generate("controller/repair")
        elif not agreed:
            while len(search.steps) < high and search.generate("controller/sample_more"):
                pass
        _select(search, public_tie_break=True)

    return run


def _traces(search: Search) -> list[tuple]:
    return [tuple(search.candidates[i]["trace"]) for i in range(len(search.steps))]


def _select(search: Search, public_tie_break: bool) -> None:
    from trialspark.operators.clustering import consensus

    if not search.steps:
        return
    chosen = consensus(_traces(search))[0]
    passing = [i for i, s in enumerate(search.steps) if s["passed"]]
    if public_tie_break and not search.steps[chosen]["passed"] and len(passing) == 1:
        chosen = passing[0]
    for i, s in enumerate(search.steps):
        s["selected"] = i == chosen


POLICIES = {
    "repair_only": (draft_then("repair_only", "repair"), False),
    "plan_then_code": (plan_then_code, False),
    "local_revision_basic": (draft_then("local_revision_basic", "revise"), False),
    "operator_bandit": (bandit(), True),
    "operator_bandit_no_error_bonus": (bandit(bonuses={}), True),
    "operator_bandit_unit_cost": (bandit(metric="unit"), True),
    "fixed_operator_order": (fixed_order, True),
    "behaviour_select": (behaviour_select(), True),
    "bottleneck_controller": (controller(), True),
}


def run_policy(pool: DataFrame, name: str, limits: Limits, scope: str | None = None) -> DataFrame:
    """The steps (task_id, STEPS) of a policy over a public pool.

    scope names a column of pool whose groups share the policy's state, in order of task_id; without it every task
    starts anew. A scope's tasks are sequential, so a scope is kept to a bounded number of tasks.
    """
    policy, discard = POLICIES[name]
    fields = ("candidate_index", "input_tokens", "total_tokens", "base_passed", "trace")

    def searched(candidates: list[dict], state: dict) -> list[dict]:
        search = Search(candidates, limits, discard)
        policy(search, state)
        return search.steps

    if scope is None:  # a task is a row with the array of its candidates, so that batches hold many tasks
        lists = pool.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))

        @F.pandas_udf(f"array<struct<{STEPS.replace(', ', ',').replace(' ', ':')}>>")
        def run(column: pd.Series) -> pd.Series:
            return pd.Series([searched(list(c), {}) for c in column])

        return lists.select("task_id", F.explode(run("c")).alias("s")).select("task_id", "s.*")

    # a scope is a row with the array of its tasks' candidates; a few rows at a time are turned to Python's values
    lists = pool.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct("task_id", *fields))).alias("c")).select("c")

    def scoped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            kinds = pa.schema([("task_id", column.type.value_type.field("task_id").type), *ARROW_STEPS])
            for at in range(0, len(column), SCOPES):
                rows = []
                for own in column.slice(at, SCOPES).to_pylist():
                    state: dict = {}
                    for task, one in groupby(own, itemgetter("task_id")):
                        rows += [{"task_id": task, **s} for s in searched(list(one), state)]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    kind = pool.schema["task_id"].dataType.simpleString()
    return lists.mapInArrow(scoped, f"task_id {kind}, {STEPS}")
