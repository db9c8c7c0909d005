"""Behaviour clusters: trace distances, medoids and the consensus choice."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.scalars import trace_distance


def distances(traces: DataFrame) -> DataFrame:
    """(task_id, left, right, distance) for all ordered pairs of a task's candidates; a task has a bounded few."""
    a, b = (traces.select("task_id", F.col("candidate_index").alias(side), F.col("trace").alias(f"{side}_trace")) for side in ("left", "right"))
    return a.join(b, "task_id").select("task_id", "left", "right", trace_distance(F.col("left_trace"), F.col("right_trace")).alias("distance"))


def medoids(pairs: DataFrame) -> DataFrame:
    """(task_id, medoid, total): the candidate with the least sum of distances to the others, the first on ties.

    Sums are rounded to 9 places, so that the order in which Spark adds does not decide ties.
    """
    others = F.sum(F.when(F.col("left") != F.col("right"), F.col("distance")))
    total = pairs.groupBy("task_id", "left").agg(F.round(F.coalesce(others, F.lit(0.0)), 9).alias("total"))
    order = Window.partitionBy("task_id").orderBy("total", "left")
    return total.withColumn("r", F.row_number().over(order)).where("r = 1").select("task_id", F.col("left").alias("medoid"), "total")


def distance(a: tuple, b: tuple) -> float:
    short = min(len(a), len(b))
    if not short:
        return 1.0
    return (sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))) / max(len(a), len(b))


def ratio(clusters: list[list[int]]) -> float:
    total = sum(map(len, clusters))
    return max(map(len, clusters)) / total if total else 0.0


def two_clusters(d: list[list[float]]) -> list[list[int]]:
    """Average linkage down to two clusters. The first least pair in list order merges, and the merged cluster goes last."""
    clusters = [[i] for i in range(len(d))]
    while len(clusters) > 2:
        pairs = [(i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))]
        mean = {(i, j): sum(d[x][y] for x in clusters[i] for y in clusters[j]) / (len(clusters[i]) * len(clusters[j])) for i, j in pairs}
        i, j = min(pairs, key=mean.__getitem__)
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [sorted(clusters[i] + clusters[j])]
    return sorted(clusters, key=lambda c: (c[0], len(c)))


def _spread(i: int, cluster: list[int], d: list[list[float]]) -> float:
    return sum(d[i][j] for j in cluster if j != i)


def consensus(traces: list[tuple]) -> tuple[int, list[list[int]]]:
    """(selected, clusters): the medoid of the larger cluster, the tighter one on ties, else the first.

    That depends only on which traces are equal at which place, so it is made once for each such pattern.
    """
    places = [{} for _ in range(max(map(len, traces), default=0))]
    return _consensus(tuple(tuple(seen.setdefault(x, len(seen)) for x, seen in zip(t, places, strict=False)) for t in traces))


@lru_cache(maxsize=2**16)
def _consensus(traces: tuple[tuple, ...]) -> tuple[int, list[list[int]]]:
    if len(set(traces)) == 1:
        return 0, [list(range(len(traces)))]
    d = [[distance(a, b) for b in traces] for a in traces]
    clusters = two_clusters(d)
    best = max(clusters, key=lambda c: (len(c), -min(_spread(i, c, d) for i in c)))
    return min(best, key=lambda i: (_spread(i, best, d), i)), clusters


def consensus_choices(traces: DataFrame) -> DataFrame:
    """(task_id, selected_index, cluster_sizes) of each task's traces in order of candidate_index."""

    lists = traces.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("candidate_index", "trace"))).alias("c"))

    @F.pandas_udf("struct<at:int,cluster_sizes:array<long>>")
    def choose(column: pd.Series) -> pd.DataFrame:
        found = [consensus([tuple(t) for t in one]) for one in column]
        return pd.DataFrame({"at": [at for at, _ in found], "cluster_sizes": [[len(c) for c in clusters] for _, clusters in found]})

    chosen = lists.withColumn("s", choose(F.transform("c", lambda x: x["trace"])))
    return chosen.select("task_id", F.get("c", F.col("s.at"))["candidate_index"].alias("selected_index"), "s.cluster_sizes")


def task_shards(tasks: DataFrame, size: int) -> DataFrame:
    """(task_id, shard): shards of at most `size` whole tasks, in order of task id.

    Ranks come from counts by range of ids, so no task numbers all rows.
    """
    ids = tasks.select("task_id").distinct()
    parts = ids.repartitionByRange("task_id").withColumn("part", F.spark_partition_id())
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("part").orderBy("task_id")) - 1
    return parts.withColumn("own", own).join(before, "part").select("task_id", F.floor((F.col("before") + F.col("own")) / size).cast("long").alias("shard"))
