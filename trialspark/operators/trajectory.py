"""Trajectories: per-task observations, policy summaries, paired comparison, ranking and shared roots."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions import sha256
from trialspark.functions.canonical import canonical_object, comparable
from trialspark.functions.scalars import as_rate, rate
from trialspark.operators.bootstrap import exact_intervals
from trialspark.operators.integrity import guarded
from trialspark.sources.shared import new_path, scratch

GATE_DIFFERENCE, GATE_CALLS, FIXED_CALLS = 0.03, 8, 16
#: Characters of JSON of a stored chunk, and of what one task of a digest reads, about.
CHUNK, LINK = 2**20, 2**27
CHUNKS = "part long, chunk long, text string, length long, roots long, compared long"


def task_observations(steps: DataFrame, hidden: DataFrame) -> DataFrame:
    """One row a pool and task: the selected step, else the first; hidden grades are joined after that.

    A task's few labels are joined as one list by task alone: steps and labels that are dealt by task are not dealt
    again, and their partitions grow in number with the input.
    """
    index = F.col("candidate_index")
    chosen = F.coalesce(F.min(F.when(F.col("selected"), index)), F.min(index))
    seen = steps.groupBy("pool_id", "task_id").agg(
        F.count("*").alias("calls"),
        F.sum("total_tokens").alias("generation_tokens"),
        F.count_if(F.col("operator") == "repair").alias("repair_calls"),
        F.bool_or("selected").alias("public_passed"),
        chosen.alias("selected_candidate_index"),
        F.collect_list(F.struct(index, "operator")).alias("_steps"),
    )
    labels = hidden.groupBy("task_id").agg(F.collect_list(F.struct(index, "plus_passed")).alias("_labels"))
    of_chosen = lambda c: F.explode(F.filter(c, lambda x: x["candidate_index"] == F.col("selected_candidate_index")))
    operated = seen.withColumn("_step", of_chosen("_steps")).drop("_steps")
    labelled = operated.join(labels, "task_id").withColumn("_label", of_chosen("_labels"))
    passed, accepted = F.col("_label.plus_passed"), F.col("public_passed")
    won = accepted & passed
    return labelled.select("pool_id", "task_id", "calls", "generation_tokens", "repair_calls", "public_passed", "selected_candidate_index", F.col("_step.operator").alias("selected_operator"), won.alias("hidden_passed"), (accepted & ~won).alias("false_accept"))


def policy_summary(observed: DataFrame, max_calls: int = 4) -> DataFrame:
    calls = F.sum("calls")
    accepted = F.col("public_passed")
    return observed.groupBy("pool_id").agg(
        F.count("*").alias("task_count"),
        rate(F.col("hidden_passed")).alias("hidden_rate"),
        rate(accepted).alias("public_rate"),
        F.avg(F.when(accepted, as_rate(F.col("false_accept")))).alias("false_accept_rate"),
        calls.alias("total_calls"),
        F.avg("calls").alias("mean_calls"),
        F.expr("percentile(calls, 0.5)").alias("median_calls"),
        F.sum("generation_tokens").alias("total_tokens"),
        F.avg("generation_tokens").alias("mean_tokens"),
        F.sum("repair_calls").alias("repair_calls"),
        F.count_if(F.col("repair_calls") > 0).alias("repaired_tasks"),
        F.count_if(F.col("hidden_passed") & (F.col("selected_operator") == "repair")).alias("repair_wins"),
        F.count_if(F.col("calls") >= max_calls).alias("full_budget_tasks"),
        F.least(F.lit(1.0), calls / (F.lit(FIXED_CALLS) * F.count("*"))).alias("fixed_call_fraction"),
    )


def full_policy_summary(steps: DataFrame, observed: DataFrame, max_calls: int, cap: int) -> DataFrame:
    """All columns of a policy's summary but its interval: one row a pool, which is named by its width and depth.

    Steps are summed by pool before they meet the observations' sums. steps has latency_ms.
    """
    size, accepted = F.split("pool_id", "x"), F.col("public_passed")
    repaired = F.col("selected_operator") == "repair"
    of_steps = steps.groupBy("pool_id").agg(
        (F.sum("latency_ms") / 1000).alias("generation_latency_seconds"), rate(F.col("code").rlike(r"^\s*$")).alias("empty_candidate_rate"), rate(F.col("output_tokens") >= cap).alias("possible_truncation_rate")
    )
    of_tasks = observed.groupBy("pool_id").agg(
        F.count("*").alias("task_count"),
        rate(accepted).alias("public_pass_rate"),
        rate(F.col("hidden_passed")).alias("hidden_pass_rate"),
        F.avg(F.when(accepted, as_rate(F.col("false_accept")))).alias("false_accept_rate"),
        F.count_if(accepted & repaired).alias("selected_by_repair_count"),
        F.count_if(F.col("hidden_passed") & repaired).alias("hidden_solved_by_repair_count"),
        F.sum("calls").alias("total_calls"),
        F.avg("calls").alias("mean_calls"),
        F.expr("percentile(calls, 0.5)").alias("median_calls"),  # of max_calls values at most
        F.count_if(F.col("calls") == max_calls).alias("full_budget_task_count"),
        F.least(F.lit(1.0), F.sum("calls") / (F.lit(FIXED_CALLS) * F.count("*"))).alias("fixed_n16_call_fraction"),
        F.sum("generation_tokens").alias("total_generation_tokens"),
        F.avg("generation_tokens").alias("mean_generation_tokens"),
    )
    shape = {"width": size[0].cast("long"), "depth": size[1].cast("long"), "maximum_calls_per_task": F.lit(max_calls).cast("long")}
    return of_tasks.withColumns(shape).join(of_steps, "pool_id")


def step_rates(steps: DataFrame, cap: int) -> DataFrame:
    """Shares over steps, not tasks: empty code, and output at the cap."""
    return steps.groupBy("pool_id").agg(rate(F.col("code").rlike(r"^\s*$")).alias("empty_rate"), rate(F.col("output_tokens") >= cap).alias("truncation_rate"))


def paired_comparison(observed: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """One row: means over tasks paired in one aggregate, wins and losses, and the gate."""
    of = lambda pool, c: F.max(F.when(F.col("pool_id") == pool, c))
    won = as_rate(F.col("hidden_passed"))
    both = observed.where(F.col("pool_id").isin(baseline, challenger)).groupBy("task_id").agg(
        (of(challenger, won) - of(baseline, won)).alias("d"),
        (of(challenger, F.col("calls")) - of(baseline, F.col("calls"))).alias("calls"),
        (of(challenger, F.col("generation_tokens")) - of(baseline, F.col("generation_tokens"))).alias("tokens"),
        of(challenger, F.col("calls")).alias("own_calls"),
    )
    return both.agg(
        F.lit(baseline).alias("baseline"),
        F.lit(challenger).alias("challenger"),
        F.count("*").alias("task_count"),
        F.avg("d").alias("hidden_difference"),
        F.avg("calls").alias("calls_difference"),
        F.avg("tokens").alias("tokens_difference"),
        F.count_if(F.col("d") > 0).alias("wins"),
        F.count_if(F.col("d") < 0).alias("losses"),
        F.count_if(F.col("d") == 0).alias("ties"),
        ((F.avg("d") >= GATE_DIFFERENCE) & (F.avg("own_calls") <= GATE_CALLS)).alias("gate"),
    )


def policy_intervals(observed: DataFrame, pools: list[str], seed: int = 0, resamples: int = 10_000, position: str = "task_id") -> DataFrame:
    """(pool_id, hidden_ci_low, hidden_ci_high) of each of pools; the i-th draws with seed + i."""
    place = F.create_map(*[F.lit(x) for i, p in enumerate(pools) for x in (p, i)])[F.col("pool_id")]
    own = observed.where(F.col("pool_id").isin(pools)).withColumn("won", as_rate(F.col("hidden_passed")))
    drawn = exact_intervals(own, ["pool_id"], "won", position, seed + place, resamples)
    return drawn.select("pool_id", F.col("ci_low").alias("hidden_ci_low"), F.col("ci_high").alias("hidden_ci_high"))


def comparison_intervals(observed: DataFrame, baseline: str, challengers: list[str], seed: int = 0, resamples: int = 10_000) -> DataFrame:
    """(baseline, challenger) with the intervals of the differences in hidden passes, calls and tokens.

    The i-th challenger draws with seed + 10,000 + 10 i, and one and two more.
    """
    measures = {"hidden": as_rate(F.col("hidden_passed")), "calls": F.col("calls").cast("double"), "tokens": F.col("generation_tokens").cast("double")}
    values = F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value"), F.lit(i).alias("more")) for i, (m, v) in enumerate(measures.items())])
    long = observed.select("pool_id", "task_id", F.explode(values).alias("m")).select("pool_id", "task_id", "m.*")
    base = F.max(F.when(F.col("pool_id") == baseline, F.col("value")))
    each = [F.struct(F.lit(c).alias("challenger"), F.lit(i).alias("place"), (F.max(F.when(F.col("pool_id") == c, F.col("value"))) - base).alias("difference")) for i, c in enumerate(challengers)]
    paired = long.groupBy("task_id", "measure", "more").agg(F.array(*each).alias("pairs")).select("task_id", "measure", "more", F.explode("pairs").alias("p"))
    rows = paired.select("task_id", "measure", "more", "p.*").where("difference is not null")
    drawn = exact_intervals(rows, ["challenger", "measure"], "difference", "task_id", seed + 10_000 + 10 * F.col("place") + F.col("more"), resamples)
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    wide = drawn.groupBy("challenger").agg(*[of(m, c) for m in measures for c in ("ci_low", "ci_high")])
    return wide.select(F.lit(baseline).alias("baseline"), "*")


def confirmation(difference: Column, low: Column) -> Column:
    """strong: the gap reached with its interval above 0; suggestive: reached; failed: not."""
    reached = difference >= GATE_DIFFERENCE
    return F.when(reached & (low > 0), "strong_confirmation").when(reached, "suggestive_confirmation").otherwise("failed_confirmation")


def ranking(summary: DataFrame) -> DataFrame:
    """Policies in order: hidden rate, then fewer tokens, fewer calls, more width, less depth, name."""
    size = F.split("pool_id", "x")
    wide = summary.withColumn("width", size[0].cast("long")).withColumn("depth", size[1].cast("long"))
    order = Window.orderBy(F.desc("hidden_rate"), "total_tokens", "total_calls", F.desc("width"), "depth", "pool_id")
    return wide.select(F.row_number().over(order).cast("long").alias("rank"), "pool_id", "hidden_rate", "total_tokens", "total_calls", "width", "depth")


#: What must be equal in roots that policies share, beside the task.
ROOT_FIELDS = (
    "candidate_index", "root_index", "depth", "round_index", "operator", "parent_candidate_index", "prompt_sha256", "raw_completion_sha256", "sanitized_code_sha256",
    "input_tokens", "output_tokens", "total_tokens", "sampling", "status", "verification_passed", "error_type", "public_feedback", "selected",
)


def shared_roots(steps: DataFrame, baseline: str, challenger: str, width: int, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(task_id, root_index, same): each root that both pools have, below the challenger's width; nulls match nulls.

    fields are those of ROOT_FIELDS that steps has, or others.
    """
    fields = fields or tuple(c for c in ROOT_FIELDS if c in steps.columns)
    roots = steps.where("depth = 0").select("pool_id", "task_id", "root_index", F.struct(*fields).alias("record"))
    a, b = (roots.where(F.col("pool_id") == p).select("task_id", "root_index", F.col("record").alias(n)) for p, n in ((baseline, "a"), (challenger, "b")))
    return a.where(F.col("root_index") < width).join(b, ["task_id", "root_index"]).select("task_id", "root_index", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def root_differences(steps: DataFrame, widths: dict[str, int], fields: tuple[str, ...] = ROOT_FIELDS) -> DataFrame:
    """(challenger, task_id, root_index, field): where the roots of a pool differ from the first one's.

    widths is pool -> width, the first pool being the baseline; a challenger must have just the baseline's roots below
    its width, equal in all fields, nulls to nulls. A root that only one side has differs in `missing` or `unexpected`.
    """
    pools = list(widths)
    own = steps.where((F.col("depth") == 0) & F.col("pool_id").isin(pools))
    record = F.struct(*[comparable(F.col(f), own.schema[f].dataType).alias(f) for f in fields])
    by = own.groupBy("task_id", "root_index").agg(*[F.max(F.when(F.col("pool_id") == p, record)).alias(f"p{i}") for i, p in enumerate(pools)])

    def found(i: int, p: str) -> Column:
        a, b, inside = F.col("p0"), F.col(f"p{i}"), F.col("root_index") < widths[p]
        differ = F.array_compact(F.array(*[F.when(~a[f].eqNullSafe(b[f]), F.lit(f)) for f in fields]))
        differ = F.when(a.isNotNull() & b.isNotNull(), differ)
        wrong = F.when(a.isNotNull() & inside & b.isNull(), F.array(F.lit("missing"))).when(b.isNotNull() & (a.isNull() | ~inside), F.array(F.lit("unexpected"))).otherwise(F.coalesce(differ, F.array().cast("array<string>")))
        return F.transform(wrong, lambda f: F.struct(F.lit(p).alias("challenger"), f.alias("field")))

    each = F.flatten(F.array(*[found(i, p) for i, p in enumerate(pools) if i]))
    return by.select("task_id", "root_index", F.explode(each).alias("d")).select("d.challenger", "task_id", "root_index", "d.field")


def _chunks(batches: Iterator[pa.RecordBatch], size: int, part: int) -> Iterator[pa.RecordBatch]:
    """Texts in order, joined by commas to chunks of `size` characters, about; a part holds `part` characters, about, of a partition."""
    first, texts, length, held, chunk, pairs = TaskContext.get().partitionId() << 32, [], 0, 0, 0, 0

    def made() -> pa.RecordBatch:
        row = ([first + held // part], [chunk], [",".join(texts)], [length], [len(texts)], [pairs])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "chunk", "text", "length", "roots", "compared"])

    for batch in batches:
        for text, compared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.append(text)
            length, pairs = length + len(text), pairs + compared
            if length >= size:
                yield made()
                texts, length, held, chunk, pairs = [], 0, held + length, chunk + 1, 0
    if texts:
        yield made()


def _links(parts: list, size: int) -> list[list]:
    """Parts in order, in runs of at most `size` characters; a larger part is a run of its own."""
    links, length = [], 0
    for p in parts:
        if not links or length + p.length > size:
            links, length = [*links, []], 0
        links[-1].append(p)
        length += p.length
    return links


def _chained_digest(chunks: DataFrame) -> tuple[int, int, str]:
    """Pairs, roots and the SHA-256 of stored _chunks() as one list: links of LINK characters, about, in order, each one
    task that goes on from the state that the link before it left."""
    sums = [F.sum(c).alias(c) for c in ("length", "roots", "compared")]
    parts = chunks.groupBy("part").agg(*sums).orderBy("part").collect()  # one row for LINK characters or a partition
    handed_on = sha256.library() is not None  # else the whole list is one link
    links = _links(parts, LINK if handed_on else sum(p.length for p in parts))
    state, digest = None, hashlib.sha256(b"[]").hexdigest()
    for i, link in enumerate(links):
        begun, last = state, i == len(links) - 1

        def absorbed(batches: Iterator[pa.RecordBatch], begun=begun, first=i == 0, last=last) -> Iterator[pa.RecordBatch]:
            own = sha256.Sha256(begun) if handed_on else hashlib.sha256()
            before = b"[" if first else b","
            for batch in batches:
                for text in batch.column(0):
                    own.update(before)
                    own.update(text.as_py().encode())
                    before = b","
            if last:
                own.update(b"]")
            found = ([None if last else own.state()], [own.hexdigest() if last else None])
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.string())], names=["state", "digest"])

        read = chunks.where(F.col("part").between(link[0].part, link[-1].part)).coalesce(1).sortWithinPartitions("part", "chunk")
        state, digest = read.select("text").mapInArrow(absorbed, "state binary, digest string").first()
        state = None if state is None else bytes(state)
    return sum(p.compared for p in parts), sum(p.roots for p in parts), digest


def root_digest(steps: DataFrame, widths: dict[str, int], fields: tuple[str, ...] = ROOT_FIELDS, parts: int | None = None) -> DataFrame:
    """One row: pool_ids, compared_root_count, unique_root_count and canonical_sha256, the SHA-256 of the shared roots.

    That is of their canonical JSON in order of task and root, one list. A digest is one value of all rows in order, so
    they are sorted by ranges, in `parts` of them, and stored in order as chunks, which a chain of tasks of bounded input
    absorbs. The chain runs when the query is built. Reading the row raises if roots differ.
    """
    spark, pools = steps.sparkSession, list(widths)
    base = steps.where((F.col("depth") == 0) & (F.col("pool_id") == pools[0]))
    shared = pools[1:]
    top = max([widths[p] for p in shared], default=0)
    named = tuple(dict.fromkeys(("task_id", *fields)))
    kinds = base.select(*named).schema
    compared = sum((F.when(F.col("root_index") < widths[p], 1).otherwise(0) for p in shared), F.lit(0)).cast("long")
    own = base.where(F.col("root_index") < top).select(*dict.fromkeys((*named, "root_index")))
    ranged = own.repartitionByRange(*([parts] if parts else []), "task_id", "root_index").sortWithinPartitions("task_id", "root_index")
    texts = ranged.select(canonical_object(kinds).alias("json"), compared.alias("compared"))
    with scratch(spark):
        path = new_path(spark, "root-chunks")
        texts.mapInArrow(partial(_chunks, size=CHUNK, part=LINK), CHUNKS).write.partitionBy("part").parquet(path)
        pairs, roots, digest = _chained_digest(spark.read.schema(CHUNKS).parquet(path))
    found = {"compared_root_count": F.lit(pairs).cast("long"), "unique_root_count": F.lit(roots).cast("long"), "canonical_sha256": F.lit(digest)}
    one = spark.range(0, 1, 1, 1).select(*[c.alias(n) for n, c in found.items()])
    checked = guarded(one, root_differences(steps, widths, fields), "shared roots")
    return checked.select(F.array(*map(F.lit, pools)).alias("pool_ids"), "*")


def roots_digest(records: list[dict]) -> str:
    """SHA-256 of canonical JSON: keys sorted, no blanks, ASCII; records in order of task and root."""
    ordered = sorted(records, key=lambda r: (r["task_id"], r["root_index"]))
    return hashlib.sha256(json.dumps(ordered, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
