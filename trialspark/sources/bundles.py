"""Published bundles: tables as JSON lines in many parts, with a manifest that is written last.

    bundle/data/<version>/<table>/part-*.json
    bundle/manifests/<version>/     one line a part: path, table, bytes, sha256, records
    bundle/about/<version>/         what describes the version, one JSON line

A version is there once its manifest's folder is committed; data without a manifest is a torn write, which readers never
see. Appending adds a version; a version that is there is never written again.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.operators.integrity import bundle_files, guarded
from trialspark.sources.lines import ordered_json
from trialspark.sources.records import write_lines

#: Records of a part at most: a part is read whole where it is verified, so its size must not grow with the table.
PART_RECORDS = 50_000
MANIFEST = "path string, table string, bytes long, sha256 string, records long"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The committed versions in order: those whose manifest is whole."""
    at, fs = _files(spark, f"{folder}/manifests")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(n for n in names if fs.exists(_files(spark, f"{folder}/manifests/{n}/_SUCCESS")[0]))


def _parts(spark: SparkSession, folder: str, version: str, table: str) -> DataFrame:
    """(path, length, content) of a table's parts, with paths below the bundle."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data/{version}/{table}")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("path", F.concat(F.lit(f"data/{version}/{table}/"), name))


def publish(spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, list[str]]], about: dict, append: bool = False, files: int | None = None) -> str:
    """Write tables, each (rows, order), as the next version and return its name; refused if there is one and append is not asked.

    A table is written by as many tasks as write_lines() makes, or `files`, each in parts of PART_RECORDS.
    """
    there = versions(spark, folder)
    if there and not append:
        raise FileExistsError(f"{folder} is published; append adds a version")
    version = f"{int(there[-1]) + 1 if there else 0:05d}"
    at, fs = _files(spark, f"{folder}/data/{version}")
    if fs.exists(at):  # of a write that was torn before its manifest
        fs.delete(at, True)
    manifest = spark.createDataFrame([], MANIFEST)
    for name, (rows, order) in tables.items():
        write_lines(rows, f"{folder}/data/{version}/{name}", order, files=files, records=PART_RECORDS)
        records = F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != "")).cast("long")
        parts = _parts(spark, folder, version, name)
        manifest = manifest.union(parts.select("path", F.lit(name), "length", F.sha2("content", 256), records))
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about/{version}")
    manifest.write.json(f"{folder}/manifests/{version}")
    return version


def _verified(spark: SparkSession, folder: str, table: str, there: list[str], rows: DataFrame) -> DataFrame:
    manifest = spark.read.schema(MANIFEST).json([f"{folder}/manifests/{v}" for v in there]).where(F.col("table") == table)
    files = reduce(DataFrame.union, [_parts(spark, folder, v, table) for v in there])
    unknown = files.select("path").join(manifest, "path", "left_anti").select("path", F.lit("unknown").alias("rule"))
    return guarded(rows, bundle_files(files, manifest).union(unknown), f"{table} of {folder} differs from its manifest")


def _committed(spark: SparkSession, folder: str) -> list[str]:
    there = versions(spark, folder)
    if not there:
        raise FileNotFoundError(f"{folder} has no committed version")
    return there


def read(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """A table's rows over all committed versions; reading them raises if a part is not as its manifest says.

    Parts are verified inside the plan, each in the task that reads it.
    """
    there = _committed(spark, folder)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json([f"{folder}/data/{v}/{table}" for v in there])
    return _verified(spark, folder, table, there, rows)


def read_ordered(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """read() with `line`, the place of a row over all parts and versions: a part's own line after the rows of earlier parts."""
    there = _committed(spark, folder)
    rows = ordered_json(spark, [f"{folder}/data/{v}/{table}" for v in there], schema)
    part = F.substring_index("file", "/data/", -1)
    counts = spark.read.schema(MANIFEST).json([f"{folder}/manifests/{v}" for v in there]).where(F.col("table") == table)
    counts = counts.select(F.substring_index("path", "data/", -1).alias("_part"), "records")
    nth = r"-c(\d+)\.[^/]*$"  # of a task's parts
    in_order = (F.regexp_replace("_part", nth, ""), F.regexp_extract("_part", nth, 1).cast("int"))
    before = F.coalesce(F.sum("records").over(Window.orderBy(*in_order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    placed = rows.withColumn("_part", part).join(counts.withColumn("_before", before), "_part")
    named = placed.withColumn("line", F.col("line") + F.col("_before")).drop("file", "_part", "records", "_before")
    return _verified(spark, folder, table, there, named)


def read_about(spark: SparkSession, folder: str) -> list[dict]:
    """What describes each committed version, in order."""
    return [json.loads(spark.read.text(f"{folder}/about/{v}").first()[0]) for v in versions(spark, folder)]
