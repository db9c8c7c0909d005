"""Files read in their own order: lines numbered over splits, JSON by a schema, many runs in one scan.

A split numbers its own lines; the lines of a file's earlier splits are added from counts. A task numbers a split at
most, whatever the file's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.operators import ranges


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): every line of the text files at path, numbered from 0 in each file; blank lines count."""
    meta = F.col("_metadata")
    raw = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("_split"))
    rows = raw.withColumn("_at", F.monotonically_increasing_id())
    counts = raw.groupBy("file", "_split").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_at")) - 1
    return rows.withColumn("_own", own).join(counts, ["file", "_split"]).select("file", (F.col("_before") + F.col("_own")).cast("long").alias("line"), "value")


def ordered_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines by a declared schema with `file` and `line`: blank lines are skipped, a torn line is an error."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    return rows.withColumn("_row", parsed).select("file", "line", "_row.*")


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of numbered lines, in the order of files and their lines."""
    return rows.orderBy("file", "line").limit(n)


def out_of_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(file, line): lines after which the keys fall, found between neighbours in ranges of lines."""
    own = rows.select("file", "line", F.struct(*keys).alias("_key"))
    after = ranges.with_next(ranges.with_ranges(own, ["file"], "line"), ["file"], "line", ["_key"])
    return after.where(F.col("_next._key") < F.col("_key")).select("file", "line")


def runs(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """(run, line, record): the lines of the file `name` in every run folder that pattern matches, as variants, in one scan.

    The run is the name of the folder. Fields that some runs lack or type otherwise are read from the variant.
    """
    rows = numbered_lines(spark, f"{pattern}/{name}").where(F.trim("value") != "")
    return rows.select(F.element_at(F.split("file", "/"), -2).alias("run"), "line", F.parse_json("value").alias("record"))


def first_of_each(rows: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """The row that comes first in position for each key; a reread gives the same rows. One aggregate, no sort of a key's rows."""
    whole = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*position)).alias("_row")).select(*keys, "_row.*")
