"""Percentile intervals of a mean by resampling.

`exact_intervals` repeats a seeded generator's draws, in parallel over intervals and over parts of large ones. `hashed_intervals`
draws blocks of rows by a hash that any engine shares and stays in DataFrame operations, however many rows a group has.
For 0/1 values over many tasks, `binomial_intervals` draws the resampled sum directly: it is a binomial variable.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.operators import ranges

LOW, HIGH = 0.025, 0.975
#: Random words made at a time (few enough for a processor's cache), and blocks of a group that hashed_intervals() resamples.
WORDS, BLOCKS = 2**17, 256
#: Draws of a part and values of a group that a task holds; parts of a group at most, of whole resamples or of words.
DRAWS, VALUES, PARTS, WORD_PARTS = 2**27, 2**27, 32, 128
#: The generator's words, bits of its state, and the constant of its recurrence.
SIZE, DEGREE, TWIST = 624, 19937, 0x9908B0DF
#: Kinds of groups: one whole value alone, which nothing is drawn for; parts of whole resamples; parts of words.
CONSTANT, SMALL, LARGE = 0, 1, 2


class Words:
    """The standard generator's words of 32 bits from a state on, in runs; its randrange(n) takes the leading bits of the
    next word and drops results of n or more."""

    def __init__(self, state: np.ndarray):
        """state holds the generator's 624 words and its position."""
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": state[:-1].astype(np.uint32), "pos": int(state[-1])}}
        self.made = np.random.Generator(self.bits)

    @staticmethod
    def seeded(seed: int) -> Words:
        return Words(np.array(random.Random(seed).getstate()[1], np.uint32))

    def run(self, words: int) -> np.ndarray:
        """The next `words` words."""
        return self.made.integers(0, 2**32, words, dtype=np.uint32)

    @staticmethod
    def packed(state: dict) -> np.ndarray:
        return np.append(state["state"]["key"], state["state"]["pos"]).astype(np.uint32)

    def state(self) -> np.ndarray:
        return self.packed(self.bits.state)

    def below(self, n: int, words: int) -> np.ndarray:
        """The numbers below n that the next `words` words give."""
        shift = 32 - n.bit_length()
        made = self.run(words)
        return np.compress(made < n << shift, made) >> np.uint32(shift)

    def counted(self, n: int, words: int) -> int:
        """How many numbers below() would give."""
        return int(np.count_nonzero(self.run(words) < n << (32 - n.bit_length())))

    def draws(self, n: int, count: int, skip: int = 0) -> Iterator[np.ndarray]:
        """Runs of `count` numbers below n, after `skip` of them."""
        while count > 0:
            drawn = self.below(n, min(WORDS, 2 * (count + skip) + 64))
            own = drawn[skip : skip + count]
            skip, count = max(0, skip - len(drawn)), count - len(own)
            if len(own):
                yield own


@lru_cache
def characteristic() -> tuple[int, ...]:
    """The powers below DEGREE of the characteristic polynomial of the generator's step over bits (Matsumoto and Nishimura)."""
    times = lambda a, of: a << of ^ a << of - 227  # noqa: E731  # by x^of + x^(of - 227)
    powers = [1]
    for _ in range(31):
        powers.append(times(powers[-1], SIZE - 1))
    total = times(powers[31], SIZE) ^ TWIST >> 31
    for i in range(31):
        if TWIST >> i & 1:
            total ^= times(powers[30 - i], SIZE)
    return tuple(i for i in range(DEGREE) if total >> i & 1)


@lru_cache
def ahead(power: int) -> int:
    """x^(2^power) modulo characteristic(), as the bits of a number."""
    if power == 0:
        return 2
    squared = int(format(ahead(power - 1), "b"), 4)
    while high := squared >> DEGREE:
        squared &= (1 << DEGREE) - 1
        for term in characteristic():
            squared ^= high << term
    return squared


def jumped(state: np.ndarray, power: int) -> np.ndarray:
    """The state 2^power words after one that stands at the end of its words, without the words between.

    A step is linear over bits, so the state ahead is the sum of the next DEGREE states that ahead() names.
    """
    words, seen = Words(state), [state[:-1]]
    for _ in range(-(-DEGREE // SIZE)):
        words.bits.random_raw(SIZE, output=False)
        seen.append(words.state()[:-1])
    named = np.unpackbits(np.frombuffer(ahead(power).to_bytes(DEGREE // 8 + 1, "little"), np.uint8), bitorder="little")
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate(seen), SIZE)
    return np.append(np.bitwise_xor.reduce(windows[np.flatnonzero(named)], axis=0), SIZE).astype(np.uint32)


def stretch_of(n: int) -> int:
    """Words that are measured together: about a sixteenth of a resample of n values."""
    return max(2**16, 2 ** (n.bit_length() - 4))


def spread_of(n: int, resamples: int, seed: int, draws: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(place, state, words) of at most WORD_PARTS parts of `draws` words or more, which hold the draws of all resamples.

    Nothing is drawn before: a part's state is jumped to. How many numbers a part gives is known once it is drawn. The
    words are those that suffice on average and 12 standard deviations more.
    """
    chance = n / 2 ** n.bit_length()
    total = math.ceil((n * resamples + 12 * math.sqrt(n * resamples * (1 - chance))) / chance) + SIZE
    power = (max(draws, -(-total // WORD_PARTS)) - 1).bit_length()
    state = Words.seeded(seed).state()
    for place, start in enumerate(range(0, total, 2**power)):
        yield place, state, min(2**power, total - start)
        state = jumped(state, power)


def parts_of(n: int, resamples: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first resample, resamples, state, skip) of each part of about DRAWS draws of a group of n values.

    A part starts at the state before the run of words that holds its first draw, and skips what the run gave earlier
    parts. Words are made one after the other and only counted here; drawing from the values is the parts' work.
    """
    each = max(1, DRAWS // n, -(-resamples // PARTS))
    words, done = Words.seeded(seed), 0
    yield 0, min(each, resamples), words.state(), 0
    starts = iter(range(each, resamples, each))
    start = next(starts, None)
    while start is not None:
        state = words.bits.state
        made = words.counted(n, WORDS)
        while start is not None and start * n < done + made:
            yield start, min(each, resamples - start), Words.packed(state), start * n - done
            start = next(starts, None)
        done += made


def narrow(values: np.ndarray) -> np.ndarray:
    """values in the least integer type that holds them all, or as they are: drawing is bound by the memory it reaches."""
    for kind in (np.int8, np.int16, np.int32):
        if len(values) and np.isfinite(values).all() and values.min() >= np.iinfo(kind).min and values.max() <= np.iinfo(kind).max and (values.astype(kind) == values).all():
            return values.astype(kind)
    return values


class Measured:
    """The values that a task holds of a group of n, those from place `low` on: count and sum of the draws of given words.

    Two whole values of a whole group take a bit each, so that a table of millions stays near the processor: the leading
    three bits of a word say which bit of the byte at its other bits.
    """

    def __init__(self, values: np.ndarray, low: int, n: int):
        self.values, self.low, self.shift, self.bound, self.table = values, low, 32 - n.bit_length(), n << 32 - n.bit_length(), None
        self.least, self.most = (int(values.min()), int(values.max())) if len(values) and values.dtype.kind == "i" else (0, 0)
        places = 2 ** n.bit_length()
        if len(values) == n >= 8 and self.least < self.most and ((values == self.least) | (values == self.most)).all():
            high = np.zeros(places, bool)
            high[:n] = values == self.most
            self.table = np.packbits(high.reshape(8, places // 8), axis=0, bitorder="little").ravel()

    def of(self, words: np.ndarray) -> tuple[int, float]:
        """How many numbers below n the words give, and the sum of the values drawn."""
        if self.table is not None:
            count = int(np.count_nonzero(words < self.bound))
            at = words << np.uint32(3)
            at >>= np.uint32(self.shift + 3)
            drawn = self.table.take(at.astype(np.int64), mode="wrap")
            drawn >>= (words >> np.uint32(29)).astype(np.uint8)
            drawn &= np.uint8(1)
            return count, self.least * count + (self.most - self.least) * int(np.count_nonzero(drawn.view(bool)))
        at = np.compress(words < self.bound, words) >> np.uint32(self.shift)
        drawn = values_at(self.values, self.low, at)
        return len(at), float(drawn.sum(dtype=np.int64 if drawn.dtype.kind == "i" else None))

    def stretches(self, words: Words, count: int, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, sums, states at the start) of stretches of `each` of the next `count` words."""
        numbers, sums, states = [], [], []
        for start in range(0, count, each):
            states.append(words.state())
            left = min(each, count - start)
            found = [self.of(words.run(min(WORDS, left - done))) for done in range(0, left, WORDS)]
            numbers.append(sum(c for c, _ in found))
            sums.append(sum(s for _, s in found))
        return np.array(numbers, np.int64), np.array(sums, float), np.array(states, np.uint32)

    def divided(self, state: np.ndarray, words: int, sums: np.ndarray, done: int, n: int, count: int, total: float) -> None:
        """Add a stretch of words, of which `count` numbers and their `total` are known, to the sums of the resamples that
        its numbers belong to, after `done` earlier ones. Words are made again up to the last end of a resample."""
        made, last, start = Words(state), min((done + count - 1) // n, len(sums)) * n, 0
        while done < last:
            run = made.run(min(WORDS, words - start))
            start += len(run)
            numbers, added = self.of(run)
            if done % n + numbers <= n:
                pieces = [(numbers, added)]
            else:
                ends, pieces, first = np.flatnonzero(run < self.bound) + 1, [], 0
                while first < numbers:
                    take = min(numbers - first, n - (done + first) % n)
                    pieces.append((take, self.of(run[ends[first - 1] if first else 0 : ends[first + take - 1]])[1]))
                    first += take
            for numbers, added in pieces:
                if done < last:
                    sums[done // n] += added
                    done, count, total = done + numbers, count - numbers, total - added
        if done // n < len(sums):
            sums[done // n] += total


def values_at(values: np.ndarray, low: int, at: np.ndarray) -> np.ndarray:
    """The values at places of a group, 0 at those that other tasks hold."""
    place = at.astype(np.int64) - low
    inside = (place >= 0) & (place < len(values))
    if inside.all():
        return values.take(place)
    return np.where(inside, values.take(place, mode="clip"), values.dtype.type(0)) if len(values) else np.zeros(len(at), values.dtype)


def packed(values: np.ndarray) -> bytes:
    """values after the name of their type, in a bit each if they are 0 and 1."""
    own = narrow(values)
    if own.dtype == np.int8 and len(own) and own.min() >= 0 and own.max() <= 1:
        return b"bit" + np.packbits(own.astype(bool)).tobytes()
    return own.dtype.str.encode() + own.tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    kind, own = data[:3], memoryview(data)[3:]
    return np.unpackbits(np.frombuffer(own, np.uint8), count=size).view(np.int8) if kind == b"bit" else np.frombuffer(own, kind.decode())


def resampled_sums(values: np.ndarray, low: int, n: int, count: int, words: Words, skip: int) -> np.ndarray:
    """Sums of `count` resamples of n draws over the values that a task holds, which are those from place `low` on.

    Whole numbers are added as such, and what is open of a resample is kept as a sum once it is longer than a run of draws.
    """
    exact = values.dtype.kind == "i"
    sums, done, filled, total, left = np.zeros(count), 0, 0, 0, np.zeros(0, values.dtype)
    add = lambda x, **axis: x.sum(dtype=np.int64 if exact else None, **axis)
    whole = len(values) == n
    for at in words.draws(n, n * count, skip):
        if whole:
            drawn = values.take(at, mode="wrap")
        else:
            drawn = values_at(values, low, at)
        if n <= WORDS:
            drawn = np.concatenate([left, drawn]) if len(left) else drawn
            full = len(drawn) // n
            sums[done : done + full] = add(drawn[: full * n].reshape(full, n), axis=1)
            done, left = done + full, drawn[full * n :]
            continue
        while len(drawn) >= n - filled:  # at most one resample ends in a run
            sums[done] = total + add(drawn[: n - filled])
            drawn, done, filled, total = drawn[n - filled :], done + 1, 0, 0
        filled, total = filled + len(drawn), total + add(drawn)
    return sums


def _interval(sums: np.ndarray, n: int) -> tuple[float, float]:
    means = np.sort(sums / n)
    return float(means[int(LOW * (len(means) - 1))]), float(means[int(HIGH * (len(means) - 1))])


def percentile_interval(values: list[float], resamples: int, seed: int) -> tuple[float, float]:
    """Elements int(0.025 (R - 1)) and int(0.975 (R - 1)) of the sorted means of R resamples, in the order of values."""
    if not values:
        return 0.0, 0.0
    return _interval(resampled_sums(narrow(np.array(values, float)), 0, len(values), resamples, Words.seeded(seed), 0), len(values))


def exact_intervals(values: DataFrame, keys: list[str], value: str, position: str, seed: Column, resamples: int = 10_000) -> DataFrame:
    """(keys, ci_low, ci_high): an interval for each group, over its values in order of position; null values are none, null
    keys a group. seed is a group's least."""
    drawn = measured_intervals(values.withColumn("_seed", seed), keys, {value: F.col(value)}, position, F.col("_seed"), resamples)
    return drawn.drop("_measure")


def measured_intervals(values: DataFrame, keys: list[str], measures: dict[str, Column], position: str, seed: Column, resamples: int = 10_000) -> DataFrame:
    """(keys, _measure, ci_low, ci_high): an interval for each group and measure, over its values in order of position.

    seed is an expression over the groups, a row each, with their keys, `_measure`, `_more`, the place of the measure from 0,
    and `_seed`, the least of the rows' if they have one.

    Groups may have any size. A task holds up to VALUES of a group, in the least type, a bit each for grades; more are
    several spans, each of which makes the words again. A group of up to WORDS values, or DRAWS draws, is cut into parts of
    whole resamples. The words of a larger one are cut into parts wherever they are, each begins at a state that is
    jumped to, and numbers and sums of its stretches are kept. What a stretch adds to which resample is known once the
    numbers of all parts are: a last task of a group reads them in order, and makes the stretches again in which a resample
    ends. No job runs before the query does.
    """
    spark = values.sparkSession
    spread = 4 * spark.sparkContext.defaultParallelism
    by, names = [*keys, "_more"], list(measures)
    own = F.col("_seed") if "_seed" in values.columns else F.lit(None)
    rows = values.select(*keys, F.col(position).alias("_p"), own.cast("long").alias("_seed"), *[m.cast("double").alias(f"_v{i}") for i, m in enumerate(measures.values())])
    ranged = ranges.with_ranges(rows, keys, "_p", large_only=False)
    lists = ranged.groupBy(*keys, ranges.RANGE).agg(F.min("_seed").alias("_seed"), F.array_sort(F.collect_list(F.struct("_p", *[f"_v{i}" for i in range(len(names))]))).alias("_rows"))
    each = [F.struct(F.lit(i).alias("_more"), F.array_compact(F.col(f"_rows._v{i}")).alias("_list")) for i in range(len(names))]
    blocks = lists.select(*keys, ranges.RANGE, "_seed", F.explode(F.array(*each)).alias("_e")).select(*keys, ranges.RANGE, "_seed", "_e.*")

    @F.pandas_udf("binary")
    def pack(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: packed(np.asarray(x, float)))

    group = Window.partitionBy(*by)
    earlier = group.orderBy(ranges.RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sized = blocks.select(*by, ranges.RANGE, "_seed", F.size("_list").cast("long").alias("_size"), F.array_min("_list").alias("_least"), F.array_max("_list").alias("_most"), pack("_list").alias("_values"))
    placed = sized.select(
        *by,
        ranges.RANGE,
        "_size",
        "_values",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_low"),
        F.sum("_size").over(group).alias("_n"),
        F.min("_seed").over(group).alias("_seed"),
        F.min("_least").over(group).alias("_least"),
        F.max("_most").over(group).alias("_most"),
    )
    one = (F.col("_least") == F.col("_most")) & (F.col("_least") % 1 == 0) & (F.abs("_least") * F.col("_n") < 2**53)
    kind = F.when(one, CONSTANT).when((F.col("_n") > WORDS) & (F.col("_n") * F.lit(resamples) > DRAWS), LARGE).otherwise(SMALL)
    placed = placed.withColumns({"_span": F.floor(F.col("_low") / VALUES).cast("long"), "_kind": kind}).drop("_least", "_most")
    groups = placed.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("_n", "_seed", "_kind")])
    groups = groups.withColumn("_measure", F.array(*[F.lit(n) for n in names])[F.col("_more")]).withColumn("_seed", seed.cast("long")).where("_n > 0")
    kinds = groups.select(*by).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (s, n, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_seed", "_n", "_kind")), strict=True)):
                own = batch.select(by).slice(i, 1)
                if kind == CONSTANT:
                    parts = [(0, resamples, 0, 0, None)]
                elif kind == SMALL:
                    parts = [(first, count, skip, 0, state) for first, count, state, skip in parts_of(n, resamples, s)]
                else:
                    parts = ((place, 0, 0, words, state) for place, state, words in spread_of(n, resamples, s, DRAWS))
                for first, count, skip, words, state in parts:
                    more = {"_first": first, "_count": count, "_skip": skip, "_words": words, "_state": None if state is None else state.astype("<u4").tobytes()}
                    yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([v], pa.binary() if c == "_state" else pa.int64()) for c, v in more.items())], names=[*by, *more])

    shape = T.StructType([*kinds.fields, *T._parse_datatype_string("_first long, _count long, _skip long, _words long, _state binary").fields])
    parts = groups.repartition(spread, *by).mapInArrow(cut, shape)
    part = [*by, "_first", "_span"]
    held = placed.where("_size > 0").drop("_seed")
    work = ranges.joined(parts, held, by).repartition(8 * spread, *part).sortWithinPartitions(*part, ranges.RANGE)

    def whole_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, int]]:
        """(batch, row, values, place of the first) at the last block of each span of a part, whose rows come one after the
        other, and at each row without values (batch, row, None, 0)."""
        blocks = []
        for batch in batches:
            for r, (size, low, n, data) in enumerate(zip(*(batch.column(c) for c in ("_size", "_low", "_n", "_values")), strict=True)):
                if not size.is_valid:
                    yield batch, r, None, 0
                    continue
                size, low, n = size.as_py(), low.as_py(), n.as_py()
                blocks.append((low, unpacked(data.as_py(), size)))
                if low + size < n and (low + size) // VALUES == low // VALUES:
                    continue
                own = np.concatenate([v for _, v in blocks]) if len(blocks) > 1 else blocks[0][1]
                yield batch, r, own, blocks[0][0]
                blocks = []

    results = {"_ends": pa.list_(pa.float64()), "_sums": pa.list_(pa.float64()), "_numbers": pa.list_(pa.int64()), "_states": pa.binary(), "_words": pa.int64()}

    def result(batch: pa.RecordBatch, r: int, kept: list[str], **made) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.select(kept).slice(r, 1).columns, *(pa.array([made.get(c)], kind) for c, kind in results.items())], names=[*kept, *results])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [*part, "_n"]
        for batch, r, own, low in whole_spans(batches):
            n, count, skip, words, state = (batch.column(c)[r].as_py() for c in ("_n", "_count", "_skip", "_words", "_state"))
            if words:
                numbers, sums, states = Measured(own, low, n).stretches(Words(np.frombuffer(state, "<u4")), words, stretch_of(n))
                yield result(batch, r, kept, _sums=sums, _numbers=numbers, _states=states.astype("<u4").tobytes(), _words=words)
                continue
            sums = np.full(count, float(own[0]) * len(own)) if state is None else resampled_sums(own, low, n, count, Words(np.frombuffer(state, "<u4")), skip)
            if count == resamples and len(own) == n:
                yield result(batch, r, kept, _ends=_interval(sums, n))
            else:
                yield result(batch, r, kept, _sums=sums)

    made = "_ends array<double>, _sums array<double>, _numbers array<long>, _states binary, _words long"
    part_kinds = work.select(*part, "_n").schema
    drawn = work.mapInArrow(draw, T.StructType([*part_kinds.fields, *T._parse_datatype_string(made).fields]))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(made).fields]
    large = held.where(F.col("_kind") == LARGE).select(*by, F.lit(-1).cast("long").alias("_first"), "_span", "_n", *none, ranges.RANGE, "_size", "_low", "_values")
    found = drawn.withColumn("_none", F.lit(None)).select("*", *[F.col("_none").cast(large.schema[c].dataType).alias(c) for c in (ranges.RANGE, "_size", "_low", "_values")]).drop("_none")
    ordered = large.unionByName(found).repartition(2 * spread, *by, "_span").sortWithinPartitions(*by, "_span", "_first", ranges.RANGE)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of whole resamples as they are; those of a large group's parts, which follow its values, as its sums."""
        kept = [*part, "_n"]
        sums = None
        for batch, r, own, low in whole_spans(batches):
            n = batch.column("_n")[r].as_py()
            if own is not None:
                if sums is not None:
                    raise RuntimeError("the parts of a group hold too few draws")
                table, whole, sums, done = Measured(own, low, n), len(own) == n, np.zeros(resamples), 0
                continue
            if not batch.column("_words")[r].is_valid:
                yield pa.RecordBatch.from_arrays(batch.select([*kept, *results]).slice(r, 1).columns, names=[*kept, *results])
                continue
            words, each = batch.column("_words")[r].as_py(), stretch_of(n)
            numbers, added = (batch.column(c)[r].values.to_numpy() for c in ("_numbers", "_sums"))
            states = np.frombuffer(batch.column("_states")[r].as_buffer(), "<u4").reshape(len(numbers), SIZE + 1)
            before = done
            for i, (count, total) in enumerate(zip(numbers.tolist(), added.tolist(), strict=True)):
                if done >= n * resamples:
                    break
                if count and (done + count - 1) // n == done // n:
                    sums[done // n] += total
                elif count:
                    table.divided(states[i], min(each, words - i * each), sums, done, n, count, total)
                done += count
            if before < n * resamples <= done:  # later parts hold none
                yield result(batch, r, kept, **({"_ends": _interval(sums, n)} if whole else {"_sums": sums, "_words": words}))
                sums = None
        if sums is not None:
            raise RuntimeError("the parts of a group hold too few draws")

    total = ordered.mapInArrow(add, drawn.schema)
    first = F.when(F.col("_words").isNull(), F.col("_first")).otherwise(0).alias("first")
    ends = total.groupBy(*by).agg(F.max("_n").alias("_n"), F.max("_ends").alias("_ends"), F.array_sort(F.collect_list(F.when(F.col("_sums").isNotNull(), F.struct(first, "_span", F.col("_sums").alias("sums"))))).alias("_parts"))

    @F.pandas_udf("array<double>")
    def joined(n: pd.Series, parts: pd.Series) -> pd.Series:
        rows = []
        for size, own in zip(n, parts, strict=True):
            sums = np.zeros(resamples)
            for p in own:  # in order of first and span
                sums[p["first"] : p["first"] + len(p["sums"])] += p["sums"]
            rows.append(list(_interval(sums, size)) if len(own) else None)
        return pd.Series(rows)

    merged = ends.withColumn("_ends", F.coalesce("_ends", joined("_n", "_parts")))
    named = F.array(*[F.lit(n) for n in names])[F.col("_more")]
    return merged.select(*keys, named.alias("_measure"), F.col("_ends")[0].alias("ci_low"), F.col("_ends")[1].alias("ci_high"))


def binomial_intervals(values: DataFrame, keys: list[str], value: str, seed: int = 0, resamples: int = 10_000) -> DataFrame:
    """(keys, ci_low, ci_high) for 0/1 values: each group is first summed to its count and successes."""
    sums = values.groupBy(*keys).agg(F.count(value).alias("_n"), F.sum(F.col(value).cast("long")).alias("_k")).withColumn("_seed", F.xxhash64(F.lit(seed), *keys))

    @F.pandas_udf("struct<ci_low:double,ci_high:double>")
    def run(n: pd.Series, k: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c in zip(n, k, s, strict=True):
            if not a:
                rows.append((0.0, 0.0))
                continue
            means = np.sort(np.random.default_rng(int(c) & (2**63 - 1)).binomial(a, b / a, resamples)) / a
            rows.append((float(means[int(LOW * (resamples - 1))]), float(means[int(HIGH * (resamples - 1))])))
        return pd.DataFrame(rows, columns=["ci_low", "ci_high"])

    return sums.withColumn("_ci", run("_n", "_k", "_seed")).select(*keys, "_ci.*")


def hashed_intervals(values: DataFrame, keys: list[str], value: str, row: str, resamples: int, seed: int = 0) -> DataFrame:
    """(keys, ci_low, ci_high) of the mean of an integer column, by resampling blocks of rows.

    The first 8 hex digits of md5(row) modulo BLOCKS say a row's block; a group is summed to its blocks, at most
    BLOCKS, before anything is drawn. Draw i of resample r is the block, in order, at the first 8 hex digits of
    md5("seed:r:i") modulo their number; a resample draws as many blocks as there are.
    """
    head = lambda x: F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    summed = values.where(F.col(value).isNotNull()).groupBy(*keys, (head(F.col(row)) % BLOCKS).alias("_block"))
    blocks = summed.agg(F.sum(F.col(value).cast("long")).alias("s"), F.count("*").alias("c"))
    groups = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "s", "c"))).alias("_blocks"))
    reps = groups.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    n = F.size("_blocks")

    def drawn(a: Column, i: Column) -> Column:
        at = head(F.concat_ws(":", F.lit(str(seed)), F.col("_rep").cast("string"), i.cast("string"))) % n
        block = F.get("_blocks", at.cast("int"))
        return F.struct((a["s"] + block["s"]).alias("s"), (a["c"] + block["c"]).alias("c"))

    none = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("c"))
    mean = F.aggregate(F.sequence(F.lit(0), n - 1), none, drawn, lambda a: a["s"] / a["c"])
    means = reps.select(*keys, mean.alias("mean"))
    ranked = means.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("mean")) - 1)
    pick = lambda q: F.max(F.when(F.col("at") == int(q * (resamples - 1)), F.col("mean")))
    return ranked.groupBy(*keys).agg(pick(LOW).alias("ci_low"), pick(HIGH).alias("ci_high"))
