"""Readers and writers of pools, grades, trajectories, results, evaluator output and task lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.operators import integrity
from trialspark.operators.clustering import task_shards
from trialspark.sources.lines import ordered_json, out_of_order

SAMPLING = "struct<temperature:double,top_p:double,do_sample:boolean,max_output_tokens:bigint,seed:bigint,seed_offset:bigint,stop_sequences:array<string>>"
GENERATION = f"struct<prompt:string,generation_text:string,input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,latency_seconds:double,sampling:{SAMPLING},model_name:string,provider_name:string,metadata:variant>"
VERIFICATION = "struct<verification_passed:boolean,verification_score:double,scope:string,verifier_name:string,stdout:string,stderr:string,error_type:string>"
CANDIDATES = f"pool_id string, task_id string, candidate_index bigint, generation {GENERATION}, sanitized_code string, prompt_sha256 string, raw_completion_sha256 string, sanitized_code_sha256 string, metadata variant"
GRADES = (
    "pool_id string, task_id string, candidate_index bigint, sanitized_code_sha256 string, scope string, status string, verification_passed boolean, runtime_seconds double, error_type string, stdout string, stderr string,"
    " public_feedback struct<status:string,failed_inputs:array<variant>,total_failed_inputs:bigint,feedback_truncated:boolean>, metadata variant"
)
STEPS = "pool_id string, task_id string, candidate_index bigint, operator string, root_index bigint, depth bigint, round_index bigint, parent_candidate_index bigint, selected boolean"
ATTEMPT = (
    f"attempt_id:string,task_id:string,model_id:string,operator_name:string,prompt:string,generation_text:string,input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,latency_seconds:double,verification_passed:boolean,"
    f"verification_score:double,public_verification:{VERIFICATION},hidden_verification:{VERIFICATION},error_type:string,stdout:string,stderr:string,cumulative_tokens:bigint,cumulative_verifier_calls:bigint,cumulative_seconds:double,selected:boolean,run_id:string,policy_name:string,provider_name:string,metadata:variant"
)
RESULTS = (
    "task_id string, policy_name string, budget struct<name:string,max_attempts:bigint,max_tokens:bigint,max_verifier_calls:bigint,max_seconds:double>,"
    f" attempts array<struct<{ATTEMPT}>>, selected_attempt_id string, success boolean, total_tokens bigint, total_verifier_calls bigint, total_seconds double, decision_tokens bigint, decision_verifier_calls bigint, decision_seconds double, metadata variant"
)
MANIFEST = (
    "schema_version string, pool_id string, dataset_name string, dataset_version string, dataset_sha256 string, task_ids array<string>, repository_commit string, model_id string, model_revision string, tokenizer_revision string, provider_name string,"
    " prompt_style string, temperature double, top_p double, max_output_tokens bigint, pool_size bigint, pool_seed bigint, created_at_utc string, hardware variant, dependencies map<string,string>, metadata variant"
)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a declared schema: blank lines are skipped, a torn line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document over several lines, as one row; a missing schema version is version 1."""
    one = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return one.withColumn("schema_version", F.coalesce("schema_version", F.lit("1")))


def manifest_tasks(manifest: DataFrame) -> DataFrame:
    """(pool_id, task_pos, task_id) in the manifest's order."""
    return manifest.select("pool_id", F.posexplode("task_ids").alias("task_pos", "task_id"))


def read_pool(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return read_manifest(spark, f"{folder}/manifest.json"), read_lines(spark, f"{folder}/candidates.jsonl", CANDIDATES)


def read_checked_pool(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, candidates) of a pool; reading the candidates raises if the pool is damaged.

    Checked: each task has exactly its candidates, codes and completions have their digests, and the file's lines are in
    the order of tasks and candidates.
    """
    manifest = read_manifest(spark, f"{folder}/manifest.json")
    lines = ordered_json(spark, f"{folder}/candidates.jsonl", CANDIDATES)
    tasks = manifest.select("pool_size", F.posexplode("task_ids").alias("task_pos", "task_id"))
    grid = tasks.select("task_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pool_size") - 1)).alias("candidate_index"))
    have = lines.groupBy("task_id", "candidate_index").agg(F.count("*").alias("n"))
    both = grid.withColumn("wanted", F.lit(True)).join(have, ["task_id", "candidate_index"], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    cover = both.select("task_id", "candidate_index", problem.alias("problem")).where("problem is not null")
    digests = integrity.hash_mismatches(lines, "sanitized_code", "sanitized_code_sha256").select("task_id", "candidate_index", F.lit("digest"))
    placed = lines.join(tasks.select("task_id", "task_pos"), "task_id")
    order = out_of_order(placed, ["task_pos", "candidate_index"]).select(F.lit(None).cast("string"), "line", F.lit("order"))
    return manifest, integrity.guarded(lines.drop("file", "line"), cover.union(digests).union(order), f"pool {folder}")


def read_checked_steps(spark: SparkSession, path: str, tasks: DataFrame, max_calls: int, schema: str = STEPS) -> DataFrame:
    """The steps of a trajectory pool; reading them raises if a step's lineage or a task's set of steps is broken.

    schema must have the columns of STEPS and base_passed; a pool's steps are those of one pool_id.
    """
    steps = read_lines(spark, path, f"{schema}, base_passed boolean" if schema == STEPS else schema)
    by_step = integrity.step_lineage(steps).select(F.col("task_id").cast("string"), "rule")
    by_task = integrity.trajectory_rules(steps, tasks, max_calls).select(F.col("task_id").cast("string"), "rule")
    return integrity.guarded(steps, by_step.union(by_task), f"trajectories {path}")


def _in_order(df: DataFrame, order: list[str], files: int | None) -> DataFrame:
    """df sorted within ranges of order, a file each: as many as the session's shuffle partitions, or `files`."""
    ranged = df.coalesce(1) if files == 1 else df.repartitionByRange(*([files] if files else []), *order)
    return ranged.sortWithinPartitions(*order)


def write_lines(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists", files: int | None = None, records: int = 0) -> None:
    """JSON lines in the order of the columns, in files whose names keep the order; one file only if it is asked for.

    A task whose rows are more than `records` goes on in further files, numbered at the end of their names.
    """
    _in_order(df, order, files).write.mode(mode).option("ignoreNullFields", False).option("maxRecordsPerFile", records).json(path)


def write_csv(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists", files: int | None = None) -> None:
    """CSV with a header in the order of columns, in files as write_lines() makes them; null is an empty field."""
    out = _in_order(df, order, files).write.mode(mode)
    out.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def preview(df: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """The first rows in order."""
    return df.orderBy(*order).limit(rows)


def task_ids(text: str) -> list[str]:
    """A JSON list of ids: strings, not empty, each once."""
    ids = json.loads(text)
    if not isinstance(ids, list) or not ids or not all(isinstance(x, str) and x for x in ids) or len(set(ids)) != len(ids):
        raise ValueError("a task list holds distinct non-empty strings")
    return ids


def sample_rows(candidates: DataFrame, code: str) -> DataFrame:
    """What an evaluator reads: task and solution, and the row's number, counted by range so that no task numbers all rows."""
    sizes = candidates.groupBy("task_id").agg(F.count("*").alias("n"))
    rank = task_shards(sizes, 1).withColumnRenamed("shard", "task_rank").join(sizes, "task_id")
    blocks = rank.withColumn("block", F.floor(F.col("task_rank") / 10_000))
    totals = blocks.groupBy("block").agg(F.sum("n").alias("t"))
    until = totals.withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    own = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("task_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("own", own).join(until, "block").select("task_id", (F.col("before") + F.col("own")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("task_id").orderBy("candidate_index")) - 1
    return candidates.withColumn("nth", nth).join(starts, "task_id").select((F.col("start") + F.col("nth")).cast("long").alias("sample_row"), "task_id", "candidate_index", F.col(code).alias("solution"))


#: What evaluators write: for each task, one entry a candidate in order.
EVALUATED = "struct<eval:map<string,array<struct<solution:string,base_status:string,plus_status:string,base_fail_tests:array<string>>>>>"
KEPT_FAILED_INPUTS = 3


def status_of(raw: Column) -> Column:
    """pass, fail and timeout stay; anything else is an error."""
    return F.when(raw.isin("pass", "fail", "timeout"), raw).otherwise("error")


def evaluator_grades(evaluated: DataFrame, column: str) -> DataFrame:
    """(task_id, candidate_index, base_status, plus_status, errors, bounded feedback) of evaluator JSON.

    A candidate that fails the base tests has the base status in both scopes; one that passes them without a plus
    status is named by `problem`.
    """
    rows = evaluated.select(F.explode(F.from_json(column, EVALUATED)["eval"]).alias("task_id", "entries")).select("task_id", F.posexplode("entries").alias("candidate_index", "e"))
    base, plus = status_of(F.col("e.base_status")), status_of(F.col("e.plus_status"))
    combined = F.when(base == "pass", F.when(F.col("e.plus_status").isNotNull(), plus)).otherwise(base)
    failed = F.coalesce(F.col("e.base_fail_tests"), F.array().cast("array<string>"))
    error = lambda s: F.when(s != "pass", F.concat(F.lit("evalplus_"), s))
    wrong = base != "pass"
    return rows.select(
        "task_id",
        F.col("candidate_index").cast("long").alias("candidate_index"),
        F.sha2(F.col("e.solution").cast("binary"), 256).alias("solution_sha256"),
        base.alias("base_status"),
        error(base).alias("base_error"),
        combined.alias("plus_status"),
        error(combined).alias("plus_error"),
        F.when(wrong, F.slice(failed, 1, KEPT_FAILED_INPUTS)).alias("failed_inputs"),
        F.when(wrong, F.size(failed)).cast("long").alias("total_failed_inputs"),
        F.when(wrong, F.size(failed) > KEPT_FAILED_INPUTS).alias("feedback_truncated"),
        F.when((base == "pass") & F.col("e.plus_status").isNull(), "missing_plus_status").alias("problem"),
    )


def verification(passed: Column, error_type: Column) -> Column:
    """A grade as a verification struct."""
    return F.struct(passed.alias("verification_passed"), F.when(passed, 1.0).otherwise(0.0).alias("verification_score"), error_type.alias("error_type"))


def subset(dataset: DataFrame, ids: DataFrame) -> DataFrame:
    """The dataset's rows for the ids; check integrity.unknown_tasks for ids it lacks."""
    return dataset.join(ids.select("task_id").distinct(), "task_id", "left_semi")
