"""Tables in the folder that the driver and all executors share: written and read back, so that lineage ends there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
#: Paths of stored tables that are still there.
_stored: dict[str, SparkSession] = {}
#: Names of those that are tables of the session's catalog.
_tables: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or on one machine our own where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="trialspark-"))
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that goes when the scratch() around it ends, or else when Python ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _stored[path] = spark
    return path


def _written(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation of what led to it.

    The table goes when the scratch() around it ends, or else when Python ends.
    """
    return _written(df, label)[1]


def stored_buckets(df: DataFrame, label: str, *by: str) -> DataFrame:
    """stored() in a table bucketed by columns, one file a bucket: joins and groupings by them read it without a shuffle."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    _stored[path] = spark
    _tables[path] = name
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).option("path", path).saveAsTable(name)
    return spark.table(name)


def _remove(paths: list[str]) -> None:
    for path in paths:
        spark = _stored.pop(path, None)
        if spark is not None and spark.sparkContext._jsc is not None:
            if path in _tables:
                spark.sql(f"drop table if exists {_tables.pop(path)}")
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    _remove(list(_stored))


class Kept:
    """What outlives a scratch(): tables stored by stored() of its own."""

    def __init__(self) -> None:
        self.paths: set[str] = set()

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path, out = _written(df, label)
        self.paths.add(path)
        return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Kept]:
    """Tables stored inside are deleted at the end, but for the kept ones; nothing lazy may still read the others."""
    before, kept = set(_stored), Kept()
    try:
        yield kept
    finally:
        _remove([p for p in _stored if p not in before and p not in kept.paths and _stored[p] is spark])
