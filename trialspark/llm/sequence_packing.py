"""Best-fit packing of tokenized documents into sequences of bounded length, by bulk-synchronous rounds.

A document is its ids and an end id. One longer than a sequence is cut so that all its pieces but the first are whole
sequences. Pieces are sorted by length over ranges and numbered within a length, so that the r-th piece of a length is
known wherever it lies. Whole sequences and pieces above half of one open sequences of their own. Then come rounds:

- gaps are sorted over ranges in the same way; only the counts by length of pieces and gaps leave the tasks, and there
  are at most `capacity` lengths, whatever the corpus;
- a sweep over the lengths, from the largest down, hands each length of pieces the tightest gaps that no larger piece
  took, a gap taking as many pieces of that length as it holds;
- pieces that want the same gaps settle it by rank: the r-th piece takes the r-th place of its run of gaps, by one join
  of pieces with gaps on (gap, rank); pieces beyond the run wait for the next round;
- gaps shrink by what they took.

When no piece fits a gap, the largest pieces left open as many sequences as all that is left fills. Each round writes
its placements and gaps to the shared folder. Rounds end when every piece has a place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.bpe import loaded
from trialspark.llm.common import ranked, scratch, stored

CAPACITY, END = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one, or whole sequences after a first piece that may be shorter."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of docs (doc_id, text): each document's ids and END, cut; null text is END alone."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = loaded(shared.value), END.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(bpe.unsplit_ids(text.as_py() or "") + end)
                rows += [(doc_id, i, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for i, (at, n) in enumerate(cuts(len(ids) // 4, capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def sweep(wanted: dict[int, tuple[int, int]], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from rank, to rank, gap, from rank of the gap, pieces a gap) of one round.

    wanted is length -> (first rank without a place, end of ranks), gaps is gap -> count. Lengths come from the largest
    down; free gaps lie on a stack with the tightest on top, so a length takes the tightest that still hold it.
    """
    free: list[tuple[int, int, int]] = []  # (gap, first free rank, end)
    runs, above = [], sorted(gaps)
    for length in sorted(wanted, reverse=True):
        while above and above[-1] >= length:
            gap = above.pop()
            free.append((gap, 0, gaps[gap]))
        at, end = wanted[length]
        while at < end and free:
            gap, lo, hi = free.pop()
            each = gap // length
            used = min(hi - lo, -(-(end - at) // each))
            to = min(end, at + used * each)
            runs.append((length, at, to, gap, lo, each))
            at = to
            if lo + used < hi:
                free.append((gap, lo + used, hi))
    return runs


def _placed(rows: DataFrame, sequence_id: Column, offset: Column) -> DataFrame:
    own = ("doc_id", "piece", "start", "length", "ids_crc32")
    return rows.select(*own, sequence_id.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def opened(left: DataFrame, runs: list[tuple[int, int, int, int]]) -> DataFrame:
    """Placements of pieces (length, from rank, to rank, first sequence), each at the start of a sequence of its own."""
    table = F.broadcast(left.sparkSession.createDataFrame(runs, "run_length long, lo long, hi long, first long"))
    own = left.join(table, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return _placed(own, F.col("first") + F.col("rank") - F.col("lo"), F.lit(0))


def matched(left: DataFrame, gaps: DataFrame, runs: list[tuple], capacity: int) -> tuple[DataFrame, DataFrame]:
    """(placements, gaps after them) of a sweep's runs, of which there are at most two for each length."""
    table = F.broadcast(left.sparkSession.createDataFrame(runs, "run_length long, lo long, hi long, of_gap long, gap_lo long, each long"))
    each, nth, place = F.col("each"), F.col("rank") - F.col("lo"), F.col("rank") - F.col("gap_lo")
    own = left.join(table, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    wants = own.withColumn("gap", F.col("of_gap")).withColumn("gap_rank", F.floor(nth / each).cast("long") + F.col("gap_lo"))
    places = gaps.select("gap", F.col("rank").alias("gap_rank"), "sequence_id")
    placed = _placed(wants.join(places, ["gap", "gap_rank"]), F.col("sequence_id"), capacity - F.col("gap") + nth % each * F.col("length"))
    of = (F.col("gap") == F.col("of_gap")) & (place >= 0) & (place * each < F.col("hi") - F.col("lo"))
    took = F.least(each, F.col("hi") - F.col("lo") - place * each) * F.col("run_length")
    shrunk = gaps.join(table, of, "left").select("sequence_id", (F.col("gap") - F.coalesce(took, F.lit(0))).alias("gap"))
    return placed, shrunk


def _counts(df: DataFrame, by: str) -> dict[int, int]:
    """How many rows each length has; there are at most as many lengths as a sequence has places."""
    return {r[0]: r[1] for r in df.groupBy(by).count().collect()}


def opening(wanted: dict[int, tuple[int, int]], capacity: int, sequences: int) -> list[tuple[int, int, int, int]]:
    """(length, from rank, to rank, first sequence) of the pieces that open sequences when none fits a gap.

    These are all pieces above half a sequence, or else as many of the largest as all that is left fills sequences.
    """
    total = sum(length * (end - at) for length, (at, end) in wanted.items())
    runs, more = [], -(-total // capacity)
    large = any(2 * length > capacity for length in wanted)
    for length in sorted(wanted, reverse=True):
        at, end = wanted[length]
        n = (end - at if 2 * length > capacity else 0) if large else min(more, end - at)
        if n:
            runs.append((length, at, at + n, sequences))
            sequences, more = sequences + n, more - n
    return runs


def packed(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row a piece of docs (doc_id, text).

    Null and empty texts are a document of END alone. Null ids and repeated rows stay, each with a place of its own;
    ties of length are broken by doc_id and piece, and rows equal in all of these are alike. A long text is encoded
    whole and costs its task memory in proportion. Other columns are ignored, whatever their names. An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept:
        cut = stored(pieces(docs, vocabulary_path, capacity), "pack-cut")  # sorting reads its input twice
        left = ranked(cut, ["length"], [F.col("doc_id"), F.col("piece")], "pack-pieces")
        ends = _counts(left, "length")
        taken, rows, sequences = dict.fromkeys(ends, 0), sum(ends.values()), 0
        gaps = spark.createDataFrame([], "sequence_id long, gap long")
        placements = [spark.createDataFrame([], f"{PIECES}, sequence_id long, offset long")]
        while wanted := {x: (taken[x], end) for x, end in ends.items() if taken[x] < end}:
            at = ranked(gaps, ["gap"], [F.col("sequence_id")], "pack-gaps")
            if runs := sweep(wanted, _counts(at, "gap")):
                placed, gaps = matched(left, at, runs, capacity)
                placements.append(kept.stored(placed, "pack-placed"))
            else:
                runs = opening(wanted, capacity, sequences)
                sequences = runs[-1][3] + runs[-1][2] - runs[-1][1]
                placements.append(kept.stored(opened(left, runs), "pack-placed"))
                gaps = gaps.union(placements[-1].select("sequence_id", (capacity - F.col("length")).alias("gap")))
            taken |= {run[0]: run[2] for run in runs}
            smallest = min((x for x, end in ends.items() if taken[x] < end), default=capacity + 1)
            gaps = stored(gaps.where(F.col("gap") >= smallest), "pack-open")
            waiting = sum(end - taken[x] for x, end in ends.items())
            if 0 < 2 * waiting < rows:  # what has a place is not read again
                done = F.broadcast(spark.createDataFrame(list(taken.items()), "length long, placed long"))
                left, rows = stored(left.join(done, "length").where("rank >= placed").drop("placed"), "pack-left"), waiting
        return reduce(DataFrame.union, placements)
