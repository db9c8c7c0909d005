"""Centroid clustering by Lloyd's rounds with the dimensions of vectors and centroids in shards.

Vectors are cut twice: rows into tiles of some thousand vectors, as the scan gives them, and columns into shards of SHARD
dimensions. A stored row is one tile in one shard, a small matrix of integers, in a table bucketed by both. In a round

1. each such row meets its shard's slice of the centroids and yields exact partial squared distances;
2. the partials of a tile are added over its shards, reduced by tile, and the nearest centroid is taken;
3. the assignment goes back to the tile's rows, which stay where they are, and every shard sums its own columns by
   centroid and replaces its own slice.

No vector is put together again, and no centroid is whole anywhere but in the result: a task holds a tile or a slice.
All arithmetic is in 64-bit integers. Values beyond LARGEST are refused, since their squared distances would not fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import scratch, stored, stored_buckets

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Columns of a shard, vectors of a tile.
SHARD, TILE = 16, 4096
#: 64 squares of twice this fit in 64 bits.
LARGEST = 2**27


def whole_numbers(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as an array of int; null unless all components are there and finite."""
    x = vector.cast("array<double>")
    fine = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    refused = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("int")
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(x, lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale).cast("int")).otherwise(refused)))


def tiles(vectors: DataFrame, dimensions: int, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """vectors (vec_id, x) as rows (tile, shard, n, ids, matrix), one for each tile and shard; ids are with shard 0 only.

    A tile is named by its task and its number there, so the names are fixed once the table is stored.
    """
    starts = range(0, dimensions, shard)
    kinds = {"tile": pa.string(), "shard": pa.int32(), "n": pa.int32(), "ids": pa.list_(pa.int64()), "matrix": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, dimensions)
            for at in range(0, len(x), tile):
                part, name = x[at : at + tile], f"{task}-{made}"
                own = [None] * len(starts)
                own[0] = ids[at : at + tile].to_pylist()
                columns = [[name] * len(starts), [*range(len(starts))], [len(part)] * len(starts), own, [np.ascontiguousarray(part[:, s : s + shard]).tobytes() for s in starts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
                made += 1

    return vectors.select("vec_id", "x").mapInArrow(run, "tile string, shard int, n int, ids array<long>, matrix binary")


def first_slices(vectors: DataFrame, clusters: int, shard: int = SHARD) -> DataFrame:
    """(shard, cluster, col, value) of the vectors with the least sha256 of `1:<vec_id>`, in that order.

    Vectors with one hash come by their components; null ids come last. There are `clusters` of them at most.
    """
    hashed = vectors.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    chosen = hashed.orderBy(F.asc_nulls_last("h"), "x").limit(clusters)
    numbered = chosen.withColumn("cluster", F.row_number().over(Window.orderBy(F.asc_nulls_last("h"), "x")) - 1)
    cells = numbered.select("cluster", F.posexplode("x").alias("at", "value"))
    return cells.select(F.floor(F.col("at") / shard).cast("int").alias("shard"), "cluster", (F.col("at") % shard).alias("col"), F.col("value").cast("long").alias("value"))


@F.pandas_udf(T.BinaryType())
def _partial(matrix: pd.Series, n: pd.Series, own: pd.Series) -> pd.Series:
    """Squared distances within a shard, vectors by centroids, in 32 bits where all fit and else in 64."""
    out = []
    for m, rows, c in zip(matrix, n, own, strict=True):
        a = np.frombuffer(m, "<i4").reshape(rows, -1).astype(np.int64)
        d = np.stack([((a - x) ** 2).sum(axis=1) for x in np.asarray(c, np.int64).reshape(-1, a.shape[1])], axis=1)
        out.append(d.astype("<u4" if d.max(initial=0) < 2**32 else "<i8").tobytes())
    return pd.Series(out)


def _added(table: pa.Table) -> pa.Table:
    """A tile's partials added over its shards, and the nearest centroid of each vector; the smaller of equally near ones."""
    total = 0
    for part, n, k in zip(table["partial"], table["n"], table["k"], strict=True):
        data, cells = part.as_py(), n.as_py() * k.as_py()
        total = total + np.frombuffer(data, "<u4" if len(data) == 4 * cells else "<i8").astype(np.int64).reshape(-1, k.as_py())
    who = total.argmin(axis=1)
    near = total[np.arange(len(who)), who]
    ids = next((x.as_py() for x in table["ids"] if x.is_valid), [])
    return pa.table({"tile": [table["tile"][0].as_py()], "ids": pa.array([ids], pa.list_(pa.int64())), "who": pa.array([who.astype(np.int32)], pa.list_(pa.int32())), "distance": pa.array([near], pa.list_(pa.int64()))})


def assigned(matrices: DataFrame, slices: DataFrame) -> DataFrame:
    """(tile, ids, who, distance): arrays with each vector's id, nearest centroid and squared distance to it."""
    cells = slices.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("cluster", "col", "value"))).alias("cells"), F.count_distinct("cluster").cast("int").alias("k"))
    own = F.broadcast(cells.select("shard", "k", F.transform("cells", lambda c: c["value"]).alias("slice")))  # clusters by dimensions
    partial = matrices.join(own, "shard").select("tile", "n", "k", "ids", _partial("matrix", "n", "slice").alias("partial"))
    return partial.groupBy("tile").applyInArrow(_added, "tile string, ids array<long>, who array<int>, distance array<long>")


def updated(matrices: DataFrame, slices: DataFrame, near: DataFrame, shards: int, clusters: int) -> DataFrame:
    """slices after a round: the floor of each cell's mean over its centroid's vectors; a centroid without vectors stays."""
    to_shards = near.select("tile", "who", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    both = matrices.select("shard", "tile", "n", "matrix").join(to_shards, ["shard", "tile"]).select("shard", "n", "matrix", "who")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, s in enumerate(batch.column(0).to_pylist()):
                a = np.frombuffer(batch.column(2)[i].as_py(), "<i4").reshape(batch.column(1)[i].as_py(), -1)
                who = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                own = np.zeros((clusters, a.shape[1]), np.int64)
                np.add.at(own, who, a)
                sums[s] = sums.get(s, 0) + own
                counts[s] = counts.get(s, 0) + np.bincount(who, minlength=clusters)
        for s, own in sums.items():
            cluster, col = np.indices(own.shape).reshape(2, -1)
            columns = [pa.array([s] * own.size, pa.int32()), pa.array(cluster, pa.int32()), pa.array(col, pa.int32()), pa.array(own.reshape(-1), pa.int64()), pa.array(counts[s][cluster], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "cluster", "col", "total", "n"])

    summed = both.mapInArrow(run, "shard int, cluster int, col int, total long, n long").groupBy("shard", "cluster", "col").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = summed.where("n > 0").select("shard", "cluster", "col", F.expr("(total - pmod(total, n)) div n").alias("moved"))
    return slices.join(moved, ["shard", "cluster", "col"], "left").select("shard", "cluster", "col", F.coalesce("moved", "value").alias("value"))


def clustered(embeddings: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each kept row of embeddings.

    A row is kept if its vector has `dimensions` components, none null or not finite; an empty vector or a null one goes.
    Repeated rows and null ids are vectors like others; fewer vectors than clusters give as many centroids. Equally near
    centroids: the smaller number. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    shards = -(-dimensions // SHARD)
    with scratch(embeddings.sparkSession) as kept:
        vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col(vector), dimensions).alias("x")).where("x is not null")
        matrices = stored_buckets(tiles(vectors, dimensions), "lloyd-tiles", "shard", "tile")
        slices = kept.stored(first_slices(vectors, clusters), "lloyd-slices")
        for _ in range(rounds):
            slices = kept.stored(updated(matrices, slices, assigned(matrices, slices), shards, clusters), "lloyd-slices")
        near = kept.stored(assigned(matrices, slices), "lloyd-assigned")
    each = near.select(F.explode(F.arrays_zip("ids", "who", "distance")).alias("v")).select(F.col("v.ids").alias("vec_id"), F.col("v.who").alias("cluster"), F.col("v.distance").alias("distance"))
    sums = each.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # a row a cluster
    cells = slices.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("shard", "col", "value"))).alias("cells"))
    written = F.array_join(F.transform("cells", lambda c: c["value"].cast("string")), ",")
    about = sums.join(cells.select("cluster", F.sha2(written.cast("binary"), 256).alias("centroid_sha256")), "cluster")
    return each.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def _sql() -> str:
    """DuckDB SQL for clustered() with its constants."""
    rounds = ""
    for i in range(ROUNDS + 1):
        rounds += f"""
d{i} as (select v.row, v.vec_id, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as distance from v, c{i} as c),
a{i} as (select row, vec_id, arg_min(cluster, (distance, cluster)) as cluster, cast(min(distance) as bigint) as distance from d{i} group by row, vec_id),"""
        if i < ROUNDS:
            rounds += f"""
m{i} as (select cluster, dim, cast(floor_div as bigint) as value from (select cluster, dim, (sum(value) - ((sum(value) % count(*)) + count(*)) % count(*)) // count(*) as floor_div
     from (select a{i}.cluster, unnest(range(1, {DIMENSIONS + 1})) as dim, unnest(v.x) as value from a{i} join v using (row)) group by cluster, dim)),
c{i + 1} as (select c{i}.cluster, coalesce(l.x, c{i}.x) as x from c{i} left join (select cluster, list(value order by dim) as x from m{i} group by cluster) l using (cluster)),"""
    return f"""
with k as (select vec_id, [cast(x as double) for x in embedding] as e from embeddings where len(embedding) = {DIMENSIONS}),
v as (select row_number() over () as row, vec_id, [cast(floor(x * {SCALE}) as bigint) for x in e] as x from k where len([1 for x in e if x is not null and isfinite(x)]) = {DIMENSIONS}),
c0 as (select row_number() over (order by sha256('1:' || vec_id) nulls last, x) - 1 as cluster, x from v order by sha256('1:' || vec_id) nulls last, x limit {CLUSTERS}),{rounds}
s as (select cluster, cast(sum(distance) as bigint) as cluster_inertia from a{ROUNDS} group by cluster)
select vec_id, cast(a.cluster as int) as cluster, a.distance, s.cluster_inertia, cast((select sum(cluster_inertia) from s) as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{ROUNDS} a join s on a.cluster = s.cluster join c{ROUNDS} c on a.cluster = c.cluster
"""


SQL = _sql()
