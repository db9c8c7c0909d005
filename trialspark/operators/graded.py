"""Grades by content: a stored table of grades keyed by task, code digest and scope, so that equal code is graded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["task_id", "code_sha256", "scope"]


def with_digest(candidates: DataFrame, code: str = "code") -> DataFrame:
    return candidates.withColumn("code_sha256", F.sha2(F.col(code).cast("binary"), 256))


def to_grade(candidates: DataFrame, store: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """(task_id, code_sha256, scope): distinct contents of candidates, in each of scopes, that the store has no grade of.

    Both sides are grouped together by content, so that a table dealt by task is not dealt again.
    """
    asked = candidates.select("task_id", "code_sha256", F.lit(None).cast("string").alias("scope"))
    by = asked.union(store.select(*KEYS)).groupBy("task_id", "code_sha256").agg(F.bool_or(F.col("scope").isNull()).alias("asked"), *[F.coalesce(F.bool_or(F.col("scope") == s), F.lit(False)).alias(f"_{i}") for i, s in enumerate(scopes)])
    lacking = F.array_compact(F.array(*[F.when(~F.col(f"_{i}"), F.lit(s)) for i, s in enumerate(scopes)]))
    return by.where("asked").select("task_id", "code_sha256", F.explode(lacking).alias("scope"))


def of_contents(grades: DataFrame, contents: DataFrame) -> DataFrame:
    """(task_id, code_sha256, scope, passed): the grades of contents (task_id, code_sha256, scope); each content has one."""
    both = grades.select(*KEYS, "passed", F.lit(False).alias("_asked")).union(contents.select(*KEYS, F.lit(None).cast("boolean"), F.lit(True)))
    by = both.groupBy(*KEYS).agg(F.min("passed").alias("passed"), F.bool_or("_asked").alias("_asked"), F.bool_or(~F.col("_asked")).alias("_graded"))
    return by.where("_asked and _graded").drop("_asked", "_graded")


def conflicts(grades: DataFrame) -> DataFrame:
    """(task_id, code_sha256, scope) of contents with several grades that disagree."""
    return grades.groupBy(*KEYS).agg(F.count_distinct("passed").alias("n")).where("n > 1").drop("n")


def merged(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new grades, one row a content; reading it raises if a grade is not what the store has already."""
    both = store.select(*KEYS, "passed").unionByName(new.select(*KEYS, "passed"))
    by = both.groupBy(*KEYS).agg(F.min("passed").alias("passed"), F.max("passed").alias("_most"))
    told = F.concat(F.lit("grades disagree: "), F.to_json(F.struct(*KEYS)))
    return by.where(F.when(F.col("passed") != F.col("_most"), F.raise_error(told).cast("boolean")).otherwise(True)).drop("_most")


def attached(candidates: DataFrame, store: DataFrame, scope: str, name: str, missing: Column | None = None) -> DataFrame:
    """candidates with `name`, the grade of their content in scope; one that the store has not graded is an error, or `missing`."""
    return all_attached(candidates, store, {scope: name}, missing)


def all_attached(candidates: DataFrame, store: DataFrame, names: dict[str, str], missing: Column | None = None) -> DataFrame:
    """attached() for several scopes (scope -> name) in one pass.

    Grades lie among the candidates of their content and are spread over them, so that tables dealt by task are not dealt again.
    """
    of = store.where(F.col("scope").isin(*names)).select("task_id", "code_sha256", F.col("scope").alias("_scope"), F.col("passed").alias("_passed"))
    both = candidates.withColumn("_scope", F.lit("")).unionByName(of, allowMissingColumns=True)
    content = Window.partitionBy("task_id", "code_sha256")
    known = F.col("task_id").isNotNull() & F.col("code_sha256").isNotNull()
    out = both.withColumns({n: F.min(F.when(known & (F.col("_scope") == s), F.col("_passed"))).over(content) for s, n in names.items()}).where("_scope = ''").drop("_scope", "_passed")
    where = lambda s: F.concat(F.lit(f"no {s} grade for task "), F.col("task_id").cast("string"), F.lit(", code "), F.col("code_sha256"))
    return out.withColumns({n: F.coalesce(F.col(n), F.raise_error(where(s)).cast("boolean") if missing is None else missing) for s, n in names.items()})


def replayed(attempts: DataFrame, searched: DataFrame) -> DataFrame:
    """attempts with base_passed of the candidate that each repeats, by (task_id, candidate_index) and equal digests.

    Reading it raises where an attempt's code is not the searched candidate's, or no candidate is found.
    """
    of = searched.select("task_id", "candidate_index", F.col("code_sha256").alias("_digest"), "base_passed")
    joined = attempts.join(of, ["task_id", "candidate_index"], "left")
    where = F.concat(F.lit("task "), F.col("task_id").cast("string"), F.lit(", candidate "), F.col("candidate_index").cast("string"))
    problem = F.when(F.col("_digest").isNull(), F.concat(F.lit("no candidate for "), where)).when(F.col("_digest") != F.col("code_sha256"), F.concat(F.lit("other code for "), where))
    return joined.withColumn("base_passed", F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(F.col("base_passed"))).drop("_digest")
