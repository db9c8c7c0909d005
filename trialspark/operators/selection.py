"""Selection regret: what a selector loses against the best candidate of a prefix.

A selector sees candidates' public columns only. Labels are joined by task and candidate after every choice is made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_rate, pass_at_k
from trialspark.operators.bootstrap import exact_intervals, measured_intervals
from trialspark.plans.hidden import public_only


def eligible_ks(ks: list[int] | tuple[int, ...], pool_size: int) -> list[int]:
    """The distinct k in order with 0 < k <= pool_size."""
    return sorted({k for k in ks if 0 < k <= pool_size})


def _prefixes(candidates: DataFrame, ks: list[int]) -> DataFrame:
    """Each candidate once for each k whose prefix holds it: a range join against a handful of constants."""
    return candidates.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in ks]), lambda k: F.col("candidate_index") < k)))


def _first_sample(inside: Column) -> Column:
    return F.lit(0).cast("long")


def _first_base_pass(inside: Column) -> Column:
    return F.coalesce(F.min(F.when(inside & F.col("base_passed"), F.col("candidate_index"))), F.lit(0)).cast("long")


#: Selectors as aggregates over the public columns of a task's candidates inside a prefix, so that one pass serves all of
#: them and all prefixes.
SELECTORS = {"first_base_pass": _first_base_pass, "first_sample": _first_sample}


def first_sample(candidates: DataFrame, ks: list[int]) -> DataFrame:
    """(task_id, k, selected_index): the first candidate."""
    return public_only(_prefixes(candidates, ks)).groupBy("task_id", "k").agg(_first_sample(F.lit(True)).alias("selected_index"))


def first_base_pass(candidates: DataFrame, ks: list[int]) -> DataFrame:
    """(task_id, k, selected_index): the first publicly passing candidate of the prefix, the first of all if none passes."""
    return public_only(_prefixes(candidates, ks)).groupBy("task_id", "k").agg(_first_base_pass(F.lit(True)).alias("selected_index"))


def custom_selector(choose: Callable[[pd.DataFrame], int]) -> Callable[[DataFrame, list[int]], DataFrame]:
    """A selector from a function of a prefix in order (public columns) to the index it chooses, which must be in range."""

    def select(candidates: DataFrame, ks: list[int]) -> DataFrame:
        def one(frame: pd.DataFrame) -> pd.DataFrame:
            ordered = frame.sort_values("candidate_index")
            index = int(choose(ordered.drop(columns=["k"])))
            if not 0 <= index < len(ordered):
                raise ValueError(f"selector chose {index} of {len(ordered)} candidates")
            return pd.DataFrame({"task_id": frame["task_id"].iloc[:1], "k": frame["k"].iloc[:1], "selected_index": index})

        shape = f"task_id {candidates.schema['task_id'].dataType.simpleString()}, k long, selected_index long"
        return public_only(_prefixes(candidates, ks)).groupBy("task_id", "k").applyInPandas(one, shape)

    return select


#: Candidates of a task that are kept as bits of a number.
BITS = 63


def _by_index(value: str, most: int) -> Column:
    """A boolean of a task's first `most` candidates, for _at(): as bits, which any hash aggregate holds, or a map of more."""
    if most > BITS:
        return F.map_from_entries(F.collect_list(F.struct("candidate_index", value)))
    own, bit = F.col("candidate_index") < most, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("candidate_index").cast("int"))
    of = lambda c: F.coalesce(F.bit_or(F.when(own & c, bit)), F.lit(0).cast("long"))
    return F.struct(of(F.lit(True)).alias("seen"), of(F.col(value).isNotNull()).alias("known"), of(F.col(value)).alias("true"), F.count_if(own).alias("rows"))


def _at(by: str, index: Column, most: int) -> Column:
    """The value of a candidate in a _by_index() column, null if there is none; candidates are distinct."""
    if most > BITS:
        return F.col(by)[index]
    is_set = lambda part: F.call_function("shiftright", F.col(by)[part], index.cast("int")).bitwiseAND(1) == 1
    distinct = F.bit_count(F.col(by)["seen"]) == F.col(by)["rows"]
    return F.when(~distinct, F.raise_error(F.lit("a task has two candidates of one index")).cast("boolean")).when(is_set("known"), is_set("true"))


def observations(candidates: DataFrame, hidden: DataFrame, ks: list[int], custom: dict | None = None, pool_size: int = 4) -> DataFrame:
    """One row for each task, k and selector; Pass@k counts correct candidates in the whole pool.

    Public columns are read once and hidden ones once, each summed by task, and the two sums, a row a task, are joined:
    choices are made before that join. custom is a dict of functions of (candidates, ks) in place of SELECTORS.
    """
    ks = eligible_ks(ks, pool_size)
    most, index = max(ks, default=0), F.col("candidate_index")
    first_correct = F.min(F.when(F.col("plus_passed"), F.col("candidate_index")))
    labels = hidden.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("plus_passed").alias("correct_in_pool"), first_correct.alias("first_correct"), _by_index("plus_passed", most).alias("plus"))
    labels = labels.withColumns({f"_pass_{k}": pass_at_k(F.col("n"), F.col("correct_in_pool"), F.lit(k)) for k in ks})
    public = public_only(candidates).groupBy("task_id")
    if custom is None:
        selected = [of(index < k).alias(f"_{name}_{k}") for k in ks for name, of in SELECTORS.items()]
        own = public.agg(_by_index("base_passed", most).alias("base"), *[F.count_if(index < k).alias(f"_in_{k}") for k in ks], *selected)
        each = [F.when(F.col(f"_in_{k}") > 0, F.struct(F.lit(k).cast("long").alias("k"), F.lit(n).alias("selector_name"), F.col(f"_{n}_{k}").alias("selected_index"))) for k in ks for n in SELECTORS]
        chosen = own.join(labels, "task_id").withColumn("_s", F.explode(F.array_compact(F.array(*each)))).select("*", "_s.*")
    else:
        picks = [select(candidates, ks).withColumn("selector_name", F.lit(name)) for name, select in custom.items()]
        chosen = public.agg(_by_index("base_passed", most).alias("base")).join(reduce(DataFrame.unionByName, picks), "task_id").join(labels, "task_id")
    joined = chosen.withColumn("prefix_has_correct", F.coalesce(F.col("first_correct") < F.col("k"), F.lit(False)))
    plus = _at("plus", F.col("selected_index"), most)
    return joined.select(
        "task_id",
        "selector_name",
        "k",
        "selected_index",
        _at("base", F.col("selected_index"), most).alias("selected_base_passed"),
        plus.alias("selected_plus_passed"),
        "correct_in_pool",
        "prefix_has_correct",
        reduce(lambda a, k: F.when(F.col("k") == k, F.col(f"_pass_{k}")).otherwise(a), ks, F.lit(None).cast("double")).alias("pass_at_k"),
        (as_rate(F.col("prefix_has_correct")) - as_rate(plus)).alias("selection_regret"),
    )


def summaries(observed: DataFrame) -> DataFrame:
    """Rates by selector and k; false acceptance is over publicly passing choices, null if there are none."""
    plus = as_rate(F.col("selected_plus_passed"))
    return observed.groupBy("selector_name", "k").agg(
        F.count("*").alias("task_count"),
        F.avg(as_rate(F.col("selected_base_passed"))).alias("base_rate"),
        F.avg(plus).alias("plus_rate"),
        F.avg(F.when(F.col("selected_base_passed"), 1.0 - plus)).alias("false_accept_rate"),
        F.avg(as_rate(F.col("prefix_has_correct"))).alias("prefix_rate"),
        F.avg("pass_at_k").alias("mean_pass_at_k"),
        F.avg("selection_regret").alias("mean_regret"),
    )


def paired(observed: DataFrame, challenger: str, baseline: str) -> DataFrame:
    """(k, task_id, difference): plus grades of two selectors' choices, paired by task in one aggregate, not a join."""
    of = lambda name: F.max(F.when(F.col("selector_name") == name, as_rate(F.col("selected_plus_passed"))))
    both = observed.where(F.col("selector_name").isin(challenger, baseline)).groupBy("k", "task_id").agg((of(challenger) - of(baseline)).alias("difference"))
    return both


def comparisons(observed: DataFrame, challenger: str, baseline: str) -> DataFrame:
    one = paired(observed, challenger, baseline)
    return one.groupBy("k").agg(
        F.lit(challenger).alias("challenger"),
        F.lit(baseline).alias("baseline"),
        F.count("*").alias("task_count"),
        F.avg("difference").alias("mean_difference"),
        F.count_if(F.col("difference") > 0).alias("wins"),
        F.count_if(F.col("difference") < 0).alias("losses"),
        F.count_if(F.col("difference") == 0).alias("ties"),
    )


def _gains(observed: DataFrame) -> DataFrame:
    """(task_id, k, reference_k, gain): Pass@k over that of the least k; selectors agree on Pass@k."""
    one = observed.groupBy("task_id", "k").agg(F.first("pass_at_k").alias("pass_at_k"))
    task = Window.partitionBy("task_id")
    over = F.col("pass_at_k") - F.first("pass_at_k").over(task.orderBy("k"))
    gain = one.withColumn("gain", over).withColumn("reference_k", F.min("k").over(task))
    return gain.where("k > reference_k")


def coverage_gains(observed: DataFrame) -> DataFrame:
    """Mean Pass@k over the smallest k's, by k above it."""
    return _gains(observed).groupBy("k", "reference_k").agg(F.count("*").alias("task_count"), F.avg("gain").alias("mean_gain"))


def default_pairs(selectors: list[str]) -> list[tuple[str, str]]:
    """(baseline, challenger) of every two selectors, in their order."""
    return list(combinations(selectors, 2))


def _numbered(keys: DataFrame, *by: str) -> DataFrame:
    """The distinct rows of keys, a few, with their place from 0 in order."""
    return keys.distinct().withColumn("place", F.row_number().over(Window.orderBy(*by)) - 1)


def summary_intervals(observed: DataFrame, seed: int = 0, resamples: int = 10_000, position: str = "task_id") -> DataFrame:
    """(selector_name, k, plus_ci_low, plus_ci_high, regret_ci_low, regret_ci_high): exact seeded intervals.

    Group g of the selectors and k's in order draws with seed + 2 g and seed + 2 g + 1.
    """
    place = F.dense_rank().over(Window.orderBy("selector_name", "k")) - 1
    measures = {"plus": as_rate(F.col("selected_plus_passed")), "regret": F.col("selection_regret")}
    drawn = measured_intervals(observed, ["selector_name", "k"], measures, position, seed + 2 * place + F.col("_more"), resamples)
    of = lambda measure, c: F.max(F.when(F.col("_measure") == measure, F.col(c))).alias(f"{measure}_{c}")
    return drawn.groupBy("selector_name", "k").agg(*[of(m, c) for m in ("plus", "regret") for c in ("ci_low", "ci_high")])


def all_comparisons(observed: DataFrame, pairs: list[tuple[str, str]], seed: int = 0, resamples: int = 10_000) -> DataFrame:
    """comparisons() of each (baseline, challenger) with ci_low and ci_high, drawn in the order of pairs and k's."""
    if len(set(pairs)) != len(pairs) or any(a == b for a, b in pairs):
        raise ValueError("pairs must be distinct, and of two selectors each")
    each = [paired(observed, c, b).withColumn("pair", F.lit(i)) for i, (b, c) in enumerate(pairs)]
    rows = [comparisons(observed, c, b).withColumn("pair", F.lit(i)) for i, (b, c) in enumerate(pairs)]
    ks = _numbered(observed.select("k"), "k")
    n = ks.agg(F.count("*").alias("n"))
    long = reduce(DataFrame.union, each).join(F.broadcast(ks), "k").withColumn("one", F.lit(1)).join(F.broadcast(n.withColumn("one", F.lit(1))), "one")
    of = seed + 1_000_000 + F.col("pair") * F.col("n") + F.col("place")
    drawn = exact_intervals(long, ["pair", "k"], "difference", "task_id", of, resamples)
    return reduce(DataFrame.union, rows).join(drawn, ["pair", "k"]).drop("pair")


def coverage_intervals(observed: DataFrame, seed: int = 0, resamples: int = 10_000) -> DataFrame:
    """(k, reference_k, ci_low, ci_high) of coverage_gains(); the k's above the least draw in order."""
    gain = _gains(observed)
    ks = _numbered(gain.select("k"), "k")
    return exact_intervals(gain.join(F.broadcast(ks), "k"), ["k", "reference_k"], "gain", "task_id", seed + 2_000_000 + F.col("place"), resamples)


def stopping(candidates: DataFrame, k: int) -> DataFrame:
    """(task_id, used, used_tokens, full_tokens, stopped): calls up to the first public pass, or all k."""
    prefix = public_only(candidates).where(F.col("candidate_index") < k)
    first = F.min(F.when(F.col("base_passed"), F.col("candidate_index"))).over(Window.partitionBy("task_id"))
    used = F.coalesce(first + 1, F.lit(k)).cast("long")
    marked = prefix.withColumn("used", used).withColumn("stopped", first.isNotNull())
    return marked.groupBy("task_id").agg(
        F.first("used").alias("used"), F.first("stopped").alias("stopped"), F.sum(F.when(F.col("candidate_index") < F.col("used"), F.col("total_tokens"))).alias("used_tokens"), F.sum("total_tokens").alias("full_tokens")
    )


def stopping_efficiency(stopped: DataFrame, k: int) -> DataFrame:
    calls, tokens = F.sum("used"), F.sum("used_tokens")
    return stopped.agg(
        F.lit(k).cast("long").alias("k"),
        F.count("*").alias("task_count"),
        calls.alias("used_calls"),
        (F.count("*") * k).alias("full_calls"),
        (1.0 - calls / (F.count("*") * k)).alias("call_savings"),
        tokens.alias("used_tokens"),
        F.sum("full_tokens").alias("full_tokens"),
        (1.0 - tokens / F.sum("full_tokens")).alias("token_savings"),
        F.avg("used").alias("mean_calls"),
        F.expr("percentile(used, 0.5)").alias("median_calls"),
    )


def stop_counts(stopped: DataFrame) -> DataFrame:
    """How many tasks stopped after each number of calls, keyed by its text."""
    return stopped.groupBy(F.col("used").cast("string").alias("calls")).agg(F.count("*").alias("tasks"))
