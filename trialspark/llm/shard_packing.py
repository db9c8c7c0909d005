"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts are one group. Groups are summed first, so copies cost nothing below. Packing has two levels,
each best-fit-decreasing over a sorted list of the bins' free space: groups are dealt by hash to buckets and packed,
bucket by bucket on the executors, into bundles of a fixed capacity (a small part of a shard); then the bundles, whose
number is bounded by BUNDLES a shard and MAX_BUCKETS, are packed into the shards, with the least capacity for which
they fit. A group above a bundle's capacity is a bundle of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import joined_copies, stored

SHARDS, OVERHEAD = 24, 8
#: Bundles that fill a shard, groups a bucket, rows of a shard that one task numbers.
BUNDLES, BUCKET, ROWS = 200, 20_000, 50_000
#: Buckets at most, so that the bundles that the driver packs stay bounded; beyond, buckets grow.
MAX_BUCKETS = 10_000


def best_fit(sizes: list[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each of sizes, which must be in falling order; None if more than `bins` bins are needed.

    Free spaces are kept sorted, so the tightest bin that still takes a size is found by bisection. A size above the
    capacity opens a bin that takes nothing else.
    """
    free: list[tuple[int, int]] = []
    out, n = [], 0
    for size in sizes:
        at = bisect_left(free, (size, -1))
        if at < len(free):
            space, b = free.pop(at)
        else:
            space, b, n = max(capacity, size), n, n + 1
            if bins is not None and n > bins:
                return None
        out.append(b)
        insort(free, (space - size, b))
    return out


def fitted(sizes: list[int], bins: int) -> list[int]:
    """best_fit() into `bins` bins with the least capacity that works, found by bisection.

    sizes fall. One that is above the mean of what is left has a bin of its own, and the others share the rest.
    """
    alone, left = 0, sum(sizes)
    while alone < min(len(sizes), bins - 1) and sizes[alone] * (bins - alone) > left:
        left -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], bins - alone
    low = max([-(-left // bins), *rest[:1]], default=1)
    high, best = 2 * low, None
    while best is None:
        best = best_fit(rest, high, bins)
        high *= 2
    high //= 2
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(rest, middle, bins)
        low, high, best = (low, middle, tried) if tried is not None else (middle + 1, high, best)
    return [*range(alone), *(alone + b for b in best)]


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, size, crc, grp): bytes of each row's text plus OVERHEAD, its CRC-32 and its group's name."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).cast("long").alias("crc"), F.coalesce(F.md5(F.col(text)), F.lit("null")).alias("grp"))


def assigned(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(grp, copies, bundle, shard): where each group of rows (grp, size) goes, and how many rows it has."""
    groups = stored(rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("copies")), "shard-groups")
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = max(1, total // (shards * BUNDLES))
    buckets = min(max(1, -(-n // BUCKET)), MAX_BUCKETS)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["size", "grp"], ascending=[False, True])
        bins = best_fit(ordered["size"].tolist(), capacity)
        return ordered[["grp", "size", "copies", "bucket"]].assign(bin=bins)

    bucket = F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("long")
    binned = stored(groups.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(pack, "grp string, size long, copies long, bucket long, bin long"), "shard-bins")
    bundles = binned.groupBy("bucket", "bin").agg(F.sum("size").alias("size"))
    # at most shards * BUNDLES full bundles and one that is not for each bucket
    small = bundles.toPandas().sort_values(["size", "bucket", "bin"], ascending=[False, True, True])
    small["shard"] = fitted(small["size"].tolist(), shards)
    small["bundle"] = range(len(small))
    placed = rows.sparkSession.createDataFrame(small[["bucket", "bin", "shard", "bundle"]].astype("int64"), "bucket long, bin long, shard long, bundle long")
    return binned.join(placed, ["bucket", "bin"]).select("grp", "copies", "bundle", F.col("shard").cast("int").alias("shard"))


def packed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row for each row of docs (doc_id, text).

    The law is `bytes`: shards are as near to equal in bytes as whole groups allow. slot numbers a shard's rows from 0
    without gaps, by sums of counts over parts of about ROWS rows. Null texts are a group with no bytes; empty texts
    another. Repeated rows and null ids are rows like others; ties of groups are broken by name, of rows by id. Texts
    are measured whole; one above a shard's mean has a shard of its own. Other columns are ignored. An empty table gives
    an empty table.
    """
    rows = stored(sized(docs), "shard-rows")
    where = assigned(rows, shards)
    parts = max(1, -(-rows.count() // (shards * ROWS)))
    part = F.pmod(F.xxhash64("doc_id", "grp"), F.lit(parts)).cast("long")
    found = joined_copies(rows.withColumn("part", part), where, "grp", "copies", F.xxhash64("doc_id"), "at")
    placed = stored(found.select(*rows.columns, "part", "at.bundle", "at.shard"), "shard-placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("bundle", "grp", "doc_id")) - 1)
    out = numbered.join(before, ["shard", "part"])
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
