"""Task suites: splits, slices, lookups and run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.scalars import hash_bucket


def with_split(tasks: DataFrame, salt: str, buckets: int = 5) -> DataFrame:
    """tasks with `split`: development for one bucket of the salted id's hash, evaluation for the others."""
    return tasks.withColumn("split", F.when(hash_bucket(F.col("task_id").cast("string"), salt, buckets) == 0, "development").otherwise("evaluation"))


def task_slice(tasks: DataFrame, split: str, offset: int, limit: int) -> DataFrame:
    """`limit` ids of a split from `offset` on, in order; an error if there are fewer. A slice is small by intent."""
    part = tasks.where(F.col("split") == split).select("task_id").distinct().orderBy("task_id").offset(offset).limit(limit)
    found = part.count()
    if found < limit:
        raise ValueError(f"{split} has {found} tasks from {offset} on, not {limit}")
    return part


def hash_ordered_sample(tasks: DataFrame, salt: str, size: int) -> DataFrame:
    """The `size` ids whose salted SHA-256 is least: a sample that does not depend on order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("task_id").cast("string")).cast("binary"), 256)
    return tasks.select("task_id").distinct().withColumn("key", key).orderBy("key").limit(size).select("task_id")


def annotated(rows: DataFrame, column: str, values: dict[str, Column]) -> DataFrame:
    """rows whose map column also holds values; a value replaces one of the same key."""
    added = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    merged = F.map_zip_with(F.coalesce(F.col(column), F.create_map().cast("map<string,string>")), added, lambda k, a, b: F.when(F.map_contains_key(added, k), b).otherwise(a))
    return rows.withColumn(column, merged)


def candidate_metadata(candidates: DataFrame, tasks: DataFrame, sampling: str = "sampling") -> DataFrame:
    """candidates with `metadata`, a struct of the task's split (null without one) and the sampling that was asked for."""
    split = tasks.select("task_id", F.col("split").alias("_split"))
    joined = candidates.join(split, "task_id", "left")
    return joined.withColumn("metadata", F.struct(F.col("_split").alias("task_split"), F.col(sampling).alias("requested_sampling"))).drop("_split")
