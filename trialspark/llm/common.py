"""What the training-data operators share: words, numbering and joins of hot keys, small expression helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.sources.shared import Kept, scratch, shared_folder, stored, stored_buckets

__all__ = ["Kept", "scratch", "shared_folder", "stored", "stored_buckets"]

#: A word is a longest run of characters that are neither a blank nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that joined_copies() broadcasts, at most.
HOT_KEYS = 1_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_copies(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: Column, name: str) -> DataFrame:
    """rows with the other columns of table's row of the same key as a struct `name`, null where there is none.

    weight is how many of rows have the key. Keys with more than 1 / HOT_KEYS of all rows, of which there are fewer than
    HOT_KEYS, are joined by broadcast; their rows go on under names of their own made of spread, so that no key, however
    hot, gathers its rows in one task. table has each key once; a null key finds nothing. It is stored, as it is read
    three times.
    """
    table = stored(table, "copies")
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    k, hot, cold, by = (fresh(rows, x) for x in ("join_key", "join_hot", "join_cold", "join_by"))
    packed = lambda as_: [F.col(key).alias(k), F.struct(*[c for c in table.columns if c != key]).alias(as_)]
    few = F.broadcast(table.where(F.col(weight) > total // HOT_KEYS).select(*packed(hot)))
    others = table.where(F.col(weight) <= total // HOT_KEYS).select(*packed(cold))
    first = rows.join(few, F.col(key) == F.col(k), "left").drop(k)
    named = first.withColumn(by, F.when(F.col(hot).isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.concat(F.lit("#"), spread.cast("string"))))
    return named.join(others, F.col(by) == F.col(k), "left").withColumn(name, F.coalesce(hot, cold)).drop(k, by, hot, cold)


def ranked(df: DataFrame, keys: list[str], order: list[Column], label: str, name: str = "rank") -> DataFrame:
    """df, stored, with `name`: the place from 0 of each row among the rows of its keys, in that order.

    Rows are sorted in ranges of keys and order together, so a key that many rows have goes over many tasks; a row's
    place is its place in its range and what earlier ranges hold of the key. The table of keys and ranges is broadcast:
    keys must have a bounded number of values. Rows that are equal in keys and order have places in any order.
    """
    at, part, first, before = (fresh(df, x) for x in ("ranked_at", "ranked_part", "ranked_first", "ranked_before"))
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stored(ordered.withColumn(at, F.monotonically_increasing_id()), label).withColumn(part, F.shiftright(at, 33))
    ranges = rows.groupBy(*keys, part).agg(F.min(at).alias(first), F.count("*").alias(before))
    until = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn(before, F.coalesce(F.sum(before).over(until), F.lit(0)))
    placed = rows.join(F.broadcast(ranges), [*keys, part])
    return placed.withColumn(name, F.col(at) - F.col(first) + F.col(before)).select(*[f"`{c}`" for c in df.columns], name)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: the optimizer never copies what a lambda binds."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_but(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but for those of these names, in any case of letters."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]
