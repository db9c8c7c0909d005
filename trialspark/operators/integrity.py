"""Integrity rules as queries for the rows that break them; no rows means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broken(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule): a row for each rule whose condition holds; a null condition is broken too."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(failed).alias("rule"))


def guarded(rows: DataFrame, violations: DataFrame, what: str) -> DataFrame:
    """rows as they are, if there are no violations; or else reading them raises an error that counts them and shows one.

    The check is part of the plan: violations are counted in one aggregate, whose single row is joined to rows, so that
    nothing runs before the query does.
    """
    shown = F.to_json(F.struct(*[f"`{c}`" for c in violations.columns]))
    one = violations.agg(F.count("*").alias("_violations"), F.min(shown).alias("_shown"))
    told = F.concat(F.lit(f"{what}: "), F.col("_violations").cast("string"), F.lit(" violations, such as "), F.col("_shown"))
    fine = F.when(F.col("_violations") == 0, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))
    return rows.join(F.broadcast(one), fine).drop("_violations", "_shown")  # one row


def attempt_accounting(attempts: DataFrame) -> DataFrame:
    """Token sums, cumulative costs at least own ones, public grade equal to the scalar one."""
    c = F.col
    rules = {"token_sum": c("total_tokens") == c("input_tokens") + c("output_tokens"), "cumulative_tokens": c("cumulative_tokens") >= c("total_tokens"), "cumulative_calls": c("cumulative_verifier_calls") >= 0}
    if "public_passed" in attempts.columns:
        rules["public_scalar"] = c("public_passed").eqNullSafe(c("verification_passed"))
    return broken(attempts, ["task_id", "policy_name", "attempt_index"], rules)


def result_consistency(results: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts numbered without gaps, at most one selected, success only with a passing selection, decision costs bounded."""
    seen = attempts.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("attempt_index").alias("lo"), F.max("attempt_index").alias("hi"), F.count_distinct("attempt_index").alias("distinct"),
        F.count_if("selected").alias("n_selected"), F.count_if(F.col("selected") & F.col("verification_passed")).alias("n_passing"),
    )
    both = results.join(seen, keys, "left")
    c = F.col
    none = c("decision_tokens").isNull() & c("decision_verifier_calls").isNull()
    whole = c("decision_tokens").isNotNull() & c("decision_verifier_calls").isNotNull()
    bounded = (c("decision_tokens") <= c("total_tokens")) & (c("decision_verifier_calls") <= c("total_verifier_calls"))
    return broken(both, keys, {
        "attempts_unique": (c("n") == c("distinct")) & (c("lo") == 0) & (c("hi") == c("n") - 1),
        "one_selected": c("n_selected") <= 1,
        "success_selected": ~c("success") | (c("n_passing") == 1),
        "decision_costs": none | (whole & bounded),
    })


def hash_mismatches(candidates: DataFrame, text: str, digest: str) -> DataFrame:
    return candidates.where(~F.sha2(F.col(text).cast("binary"), 256).eqNullSafe(F.col(digest))).select("task_id", "candidate_index")


def incomplete_pool(candidates: DataFrame, tasks: DataFrame, size: int) -> DataFrame:
    """(task_id, candidate_index, problem) against the grid of tasks and 0 .. size - 1: missing, unexpected, duplicate.

    Both sides are grouped by task, not joined by task and candidate: sides that are dealt alike by task are not dealt
    again. A task of null is equal to none.
    """
    grid = tasks.select("task_id").distinct().select("task_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("candidate_index"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("wanted"))
    have = candidates.groupBy("task_id", "candidate_index").agg(F.count("*").alias("n")).withColumn("wanted", F.lit(False))
    side = F.when(F.col("task_id").isNull(), F.col("wanted"))
    both = grid.union(have).groupBy("task_id", "candidate_index", side.alias("_side")).agg(F.sum("n").alias("n"), F.bool_or("wanted").alias("wanted"))
    problem = F.when(F.col("n") == 0, "missing").when(~F.col("wanted"), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.select("task_id", "candidate_index", problem.alias("problem")).where("problem is not null")


def out_of_order(rows: DataFrame, keys: list[str], position: str, partition: list[str]) -> DataFrame:
    """Rows whose keys are below those of the row before in file order, a file (partition) at a time."""
    w = Window.partitionBy(*partition).orderBy(position)
    own = F.struct(*keys)
    return rows.withColumn("_before", F.lag(own).over(w)).where(F.col("_before") > own).select(*partition, *keys, position)


def exact_cover(left: DataFrame, right: DataFrame, keys: list[str], digest: str | None = None) -> DataFrame:
    """(keys, problem) where right does not hold exactly one row for each of left: missing, unknown, duplicate, digest."""
    a = left.select(*keys, *([F.col(digest).alias("_a")] if digest else [])).withColumn("_l", F.lit(True))
    b = right.groupBy(*keys).agg(F.count("*").alias("_n"), *([F.min(digest).alias("_b")] if digest else []))
    both = a.join(b, keys, "full_outer")
    problem = F.when(F.col("_l").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
    if digest:
        problem = problem.when(~F.col("_a").eqNullSafe(F.col("_b")), "digest")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def grade_rules(grades: DataFrame, scope: str) -> DataFrame:
    """Passing means status pass; a plus grade has no feedback; a base grade's feedback has its status and its counts."""
    c = F.col
    rules = {"passed_status": c("verification_passed") == (c("status") == "pass")}
    if scope == "plus":
        rules["no_feedback"] = c("feedback_status").isNull()
    else:
        rules["feedback_status"] = c("feedback_status").isNull() | (c("feedback_status") == c("status"))
        rules["feedback_counts"] = c("total_failed_inputs").isNull() | ((c("total_failed_inputs") >= c("kept_failed_inputs")) & (c("feedback_truncated") == (c("total_failed_inputs") > c("kept_failed_inputs"))))
    return broken(grades, ["task_id", "candidate_index"], rules)


def step_lineage(steps: DataFrame) -> DataFrame:
    """Row rules: samples are roots, repairs have an earlier parent, a selected step passed."""
    c = F.col
    sample = c("operator") == "sample"
    return broken(steps, ["pool_id", "task_id", "candidate_index"], {
        "sample_root": ~sample | ((c("depth") == 0) & c("parent_candidate_index").isNull()),
        "repair_parent": sample | ((c("depth") > 0) & c("parent_candidate_index").isNotNull()),
        "parent_before": c("parent_candidate_index").isNull() | (c("parent_candidate_index") < c("candidate_index")),
        "selected_passed": ~c("selected") | c("base_passed"),
    })


def trajectory_rules(steps: DataFrame, tasks: DataFrame, max_calls: int) -> DataFrame:
    """Set rules by task: covered, numbered from 0, within calls, one pass which is last and selected, else all calls used; and parents."""
    c = F.col
    seen = steps.groupBy("task_id").agg(
        F.count("*").alias("n"), F.min("candidate_index").alias("lo"), F.max("candidate_index").alias("hi"), F.count_if("base_passed").alias("passes"),
        F.max(F.when(c("base_passed"), c("candidate_index"))).alias("pass_at"), F.max(F.when(c("selected"), c("candidate_index"))).alias("selected_at"),
    )
    both = tasks.select("task_id").distinct().join(seen, "task_id", "full_outer")
    by_task = broken(both, ["task_id"], {
        "covered": c("n").isNotNull(),
        "contiguous": c("n").isNull() | ((c("lo") == 0) & (c("hi") == c("n") - 1)),
        "max_calls": c("n").isNull() | (c("n") <= max_calls),
        "one_pass_last": c("n").isNull() | (c("passes") == 0) | ((c("passes") == 1) & (c("pass_at") == c("hi")) & c("selected_at").eqNullSafe(c("pass_at"))),
        "exhausted": c("n").isNull() | (c("passes") > 0) | (c("n") == max_calls),
    })
    parent = steps.select("task_id", c("candidate_index").alias("parent_candidate_index"), c("root_index").alias("p_root"), c("depth").alias("p_depth"))
    repairs = steps.where("parent_candidate_index is not null").join(parent, ["task_id", "parent_candidate_index"], "left")
    lineage = broken(repairs, ["task_id"], {"parent": (c("p_root") == c("root_index")) & (c("p_depth") + 1 == c("depth"))})
    return by_task.union(lineage)


def manifest_differences(manifests: DataFrame, fields: list[str], position: str) -> DataFrame:
    """(pool_id, field): fields in which a manifest differs from the first one's; nulls are equal."""
    base = manifests.orderBy(position).limit(1).select(*[F.col(f).alias(f"_{f}") for f in fields])
    both = manifests.join(F.broadcast(base), F.lit(True))  # one row
    return broken(both, ["pool_id"], {f: F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields}).withColumnRenamed("rule", "field")


def base_recheck(searched: DataFrame, regraded: DataFrame, fields: list[str]) -> DataFrame:
    """(task_id, candidate_index, field) where a grade made again differs from the one the search saw; nulls are equal."""
    again = regraded.select("task_id", "candidate_index", *[F.col(f).alias(f"_{f}") for f in fields])
    both = searched.join(again, ["task_id", "candidate_index"])
    return broken(both, ["task_id", "candidate_index"], {f: F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields}).withColumnRenamed("rule", "field")


def selectors_disagree(observed: DataFrame) -> DataFrame:
    """(task_id, k) for which selectors hold different Pass@k."""
    return observed.groupBy("task_id", "k").agg(F.count_distinct("pass_at_k").alias("n")).where("n > 1").select("task_id", "k")


def unpaired(observed: DataFrame, one: str, other: str) -> DataFrame:
    """(task_id, k, lacks): tasks that one of two selectors has and the other lacks."""
    sides = observed.where(F.col("selector_name").isin(one, other)).groupBy("task_id", "k").agg(F.bool_or(F.col("selector_name") == one).alias("a"), F.bool_or(F.col("selector_name") == other).alias("b"))
    return sides.where("not (a and b)").select("task_id", "k", F.when(F.col("a"), other).otherwise(one).alias("lacks"))


def falling_curve(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Points below the point before, or a first point below 0."""
    before = F.coalesce(F.lag("success_rate").over(Window.partitionBy(*keys).orderBy("budget")), F.lit(0.0))
    return curve.withColumn("before", before).where("success_rate < before").select(*keys, "budget", "success_rate")


def unknown_tasks(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Asked ids that are not known, and known ids not asked, named by side; an id of null is equal to none.

    Both sides are grouped together, so sides that are dealt alike by task are not dealt again.
    """
    sides = asked.select("task_id", F.lit(True).alias("asked")).union(known.select("task_id", F.lit(False).alias("asked")))
    lone = F.when(F.col("task_id").isNull(), F.col("asked"))
    both = sides.groupBy("task_id", lone.alias("_side")).agg(F.bool_or("asked").alias("a"), F.bool_and("asked").alias("only"))
    return both.where("only or not a").select("task_id", F.when(F.col("a"), "unknown").otherwise("not_asked").alias("problem"))


def bundle_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, rule) of a bundle: files is the binaryFile source with relative paths; manifest has path, bytes, sha256, records.

    A path that is absolute or climbs out is refused; a file that is not there is missing.
    """
    have = files.select(F.col("path").alias("path"), F.col("length").alias("have_bytes"), F.sha2("content", 256).alias("have_sha"), F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != "")).cast("long").alias("have_records"))
    both = manifest.join(have, "path", "left")
    c = F.col
    gone = c("have_bytes").isNull()
    return broken(both, ["path"], {
        "inside": ~c("path").startswith("/") & ~F.array_contains(F.split("path", "/"), ".."),
        "exists": ~gone,
        "bytes": gone | (c("bytes") == c("have_bytes")),
        "sha256": gone | (c("sha256") == c("have_sha")),
        "records": gone | c("records").isNull() | (c("records") == c("have_records")),
    })


def evaluator_rows(evaluated: DataFrame, column: str, candidates: DataFrame) -> DataFrame:
    """(task_id, candidate_index, rule) where evaluator JSON does not fit the candidates (task_id, candidate_index, code_sha256).

    dataset_hash: the JSON names no dataset. tasks: a task that only one side has. count: a task with other than its
    candidates' number of rows. digest: a row whose solution is not the code of the candidate at its place. identity: a
    candidate that comes twice.
    """
    json = evaluated.select(F.from_json(column, "struct<hash:string,eval:map<string,array<struct<solution:string>>>>").alias("j"))
    hashes = json.where(F.coalesce(F.col("j.hash"), F.lit("")) == "").select(F.lit(None).cast("string").alias("task_id"), F.lit(None).cast("long").alias("candidate_index"), F.lit("dataset_hash").alias("rule"))
    tasks = json.select(F.explode("j.eval").alias("task_id", "entries"))
    own = candidates.select(F.col("task_id").cast("string").alias("task_id"), "candidate_index", "code_sha256")
    counts = own.groupBy("task_id").agg(F.count("*").alias("n"), F.count_distinct("candidate_index").alias("distinct"))
    both = tasks.select("task_id", F.size("entries").alias("rows")).join(counts, "task_id", "full_outer")
    rule = F.when(F.col("rows").isNull() | F.col("n").isNull(), "tasks").when(F.col("distinct") < F.col("n"), "identity").when(F.col("rows") != F.col("n"), "count")
    by_task = both.select("task_id", F.lit(None).cast("long").alias("candidate_index"), rule.alias("rule")).where("rule is not null")
    rows = tasks.select("task_id", F.posexplode("entries").alias("place", "e")).select("task_id", F.col("place").cast("long").alias("candidate_index"), F.sha2(F.col("e.solution").cast("binary"), 256).alias("_sha"))
    nth = F.row_number().over(Window.partitionBy("task_id").orderBy("candidate_index")) - 1
    placed = own.withColumn("_place", nth.cast("long")).select("task_id", F.col("candidate_index").alias("_index"), F.col("_place").alias("candidate_index"), "code_sha256")
    digests = rows.join(placed, ["task_id", "candidate_index"]).where(~F.col("_sha").eqNullSafe(F.col("code_sha256")))
    return hashes.union(by_task).union(digests.select("task_id", F.col("_index"), F.lit("digest")))


#: What the first attempt of a run must have: fixed names of the format.
REQUIRED_ATTEMPT_FIELDS = ("model_id", "policy_name", "operator_name", "input_tokens", "output_tokens", "total_tokens", "verification_passed", "cumulative_tokens", "cumulative_verifier_calls")


def first_attempts(attempts: DataFrame) -> DataFrame:
    """(run, attempts_logged, missing_fields, token_accounting_ok, budget_name_present): a check of each run's first attempt.

    attempts is (run, line, record), records as variants, as lines.runs() reads them: the first one is that of the least
    line. A field that is null counts as there; tokens count as right only if all three are whole numbers that add up.
    """
    kinds = lambda r: F.schema_of_variant(r)
    first = attempts.groupBy("run").agg(F.count("*").alias("attempts_logged"), F.min("line").alias("line"))
    one = attempts.join(first, ["run", "line"])
    field = lambda name, kind="string": F.try_variant_get("record", f"$.{name}", kind)
    there = lambda name: F.try_variant_get("record", f"$.{name}", "variant").isNotNull()
    missing = F.array_compact(F.array(*[F.when(~there(f), F.lit(f)) for f in REQUIRED_ATTEMPT_FIELDS]))
    tokens = ("input_tokens", "output_tokens", "total_tokens")
    whole = [F.coalesce(kinds(F.try_variant_get("record", f"$.{f}", "variant")) == "BIGINT", F.lit(False)) for f in tokens]
    adds = F.coalesce(field("total_tokens", "long") == field("input_tokens", "long") + field("output_tokens", "long"), F.lit(False))
    named = there("metadata.budget_name") | there("result_metadata.budget_name")
    return one.select("run", "attempts_logged", missing.alias("missing_fields"), (whole[0] & whole[1] & whole[2] & adds).alias("token_accounting_ok"), named.alias("budget_name_present"))


def sandbox_flags(commands: DataFrame, required: list[str]) -> DataFrame:
    """(shard, flag) for required flags that a container command (array of words) lacks."""
    wanted = F.array(*map(F.lit, required))
    return commands.select("shard", F.explode(F.array_except(wanted, F.col("command"))).alias("flag"))
