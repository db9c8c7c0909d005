"""Order within groups of any size: running sums, medians and neighbours without a task that holds a large group.

Rows of a group are cut into ranges at values of the ordering column itself: those whose hash says so, about one in
ROWS. Cuts follow the distribution, outliers or not. A range is sorted in a task; ranges are combined by sums over them.
Nothing is written and no job runs before the query does: cuts are a pure function of the values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about. Cuts are broadcast: one value for each ROWS rows, of groups with more rows than that only.
ROWS = 50_000
RANGE = "_range"


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns by keys, in which null matches null."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_of_{k}" for k in keys])


def _halves(cuts: Column) -> Column:
    """The powers of two from that of at most the number of cuts down to 1: made once for a group, not for each row."""
    return F.transform(F.sequence(F.floor(F.log2(F.size(cuts))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))


def _range_of(value: Column, cuts: Column, halves: Column) -> Column:
    """How many of the sorted cuts are at most value, by bisection: a number that grows by each power of two that it can."""
    return F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get(cuts, at + half - 1) <= value, half).otherwise(0))


def with_ranges(df: DataFrame, keys: list[str], order: str, large_only: bool = True) -> DataFrame:
    """df with RANGE: rows of a group in a lower range come before those of a higher one; equal values share a range.

    Values of order that many rows of a group share are one range: sum them up first. With large_only false, groups are
    not counted first, which spares a pass over df, and a group of any size can have a cut.
    """
    chosen = df.select(*keys, order).where(F.pmod(F.xxhash64(order), F.lit(ROWS)) == 0)
    if large_only:
        large = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > ROWS)
        chosen = joined(chosen, F.broadcast(large), keys, "left_semi")
    cuts = chosen.groupBy(*keys).agg(F.array_sort(F.collect_set(order)).alias("_cuts"))
    cuts = cuts.where(F.size("_cuts") > 0).withColumn("_halves", _halves(F.col("_cuts")))
    found = joined(df, F.broadcast(cuts), keys, "left")
    return found.withColumn(RANGE, F.when(F.col("_cuts").isNull(), 0).otherwise(_range_of(F.col(order), F.col("_cuts"), F.col("_halves")))).drop("_cuts", "_halves")


def running_sums(ranged: DataFrame, keys: list[str], order: str, values: dict[str, str]) -> DataFrame:
    """with_ranges() rows with a column for each of values (new name -> column): its sum over the group's rows up to
    this one, in order; ties in any order."""
    sums = ranged.groupBy(*keys, RANGE).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, RANGE, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values])
    until = Window.partitionBy(*keys, RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = joined(ranged.withColumns({f"_within_{n}": F.sum(v).over(until) for n, v in values.items()}), sums, [*keys, RANGE])
    return within.select(*ranged.columns, *[(F.col(f"_before_{n}") + F.col(f"_within_{n}")).alias(n) for n in values])


def with_next(ranged: DataFrame, keys: list[str], order: str, names: list[str]) -> DataFrame:
    """with_ranges() rows with `_next`: a struct of names of the group's next row in order, null for the last.

    The last row of a range finds its next one among the first rows of later ranges.
    """
    own = F.struct(*names)
    heads = ranged.groupBy(*keys, RANGE).agg(F.min_by(own, F.col(order)).alias("_head"))
    heads = heads.withColumn("_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy(RANGE)))
    inside = ranged.withColumn("_next", F.lead(own).over(Window.partitionBy(*keys, RANGE).orderBy(order)))
    return joined(inside, heads, [*keys, RANGE]).withColumn("_next", F.coalesce("_next", "_head")).drop("_head")


def numbered(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """df with `name`: the place of a row in its group from 0, in order; ties in any order."""
    one = with_ranges(df, keys, order).withColumn("_one", F.lit(1).cast("long"))
    return running_sums(one, keys, order, {name: "_one"}).withColumn(name, F.col(name) - 1).drop("_one", RANGE)


def medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, one column a value): exact medians, the mean of the middle two of an even number; null without a value.

    Values are counted by value first, all kinds in one pass, then running counts find the middle ones.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), v.cast("double").alias("value")) for n, v in values.items()])
    long = df.select(*keys, F.explode(kinds).alias("x")).select(*keys, "x.*").where("value is not null")
    by = [*keys, "kind"]
    counted = long.groupBy(*by, "value").agg(F.count("*").alias("n"))
    total = counted.groupBy(*by).agg(F.sum("n").alias("total"))
    run = joined(running_sums(with_ranges(counted, by, "value"), by, "value", {"until": "n"}), total, by)
    first = lambda above: F.min(F.when(F.col("until") > above, F.col("value")))
    lower, upper = first(F.floor((F.col("total") - 1) / 2)), first(F.floor(F.col("total") / 2))
    middle = run.groupBy(*by).agg(((lower + upper) / 2).alias("median"))
    wide = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == n, F.col("median"))).alias(n) for n in values])
    return joined(df.select(*keys).distinct(), wide, keys, "left")
