"""Ranked lexical search by the Best Position Algorithm, for a stated set of queries against all documents.

Queries go in blocks of about BLOCK distinct terms, a block at a time. For a block, one pass over the texts counts its
terms in every document. Each term has an impact list: its documents by falling impact, numbered over ranges so that no
list, however long, meets in a task. Documents are kept in shards of 2**SHARD_BITS rows, each with the impacts and list
positions of all its hits; a shard is the place of direct access to its documents.

A round reads every list of the queries that are not yet done down to a depth. The documents read are looked up in
their shards: all their impacts, which give exact scores, and all their positions in the query's other lists. The best
position of a list is the end of the run of positions seen from its top, by reading or by look-up, so it lies at the
last position read or beyond it (runs end with a word of 64 positions, and are followed to DEEPER times the depth). The
sum of the impacts there bounds the score of every document not seen, more tightly than the last positions read do. A query is done when that sum is strictly below its k-th score, so that no unseen
document can even tie. Other queries go deeper: to the least depth at which the plain sums would end them, but at most
DEEPER times the depth they have read. Shards put out the k best documents of each query and 64-bit words of positions
seen; the driver holds a number for each query and list of a block, nothing for a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import ranked, scratch, stored

TOP = 10
#: Queries of a block and its distinct terms, about; rows of a shard as a power of two; hits with queries at a time.
QUERIES, BLOCK, SHARD_BITS, PAIRS = 1_000, 50_000, 9, 2**20
#: The first depth of a query's lists and the growth of a round, powers of two.
DEPTH, DEEPER = 512, 8
#: Bytes of a term as they are, A-Z in lower case, and blanks for all others: the terms of [^\\x00-\\x2F...]+ in UTF-8.
_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters, digits and all characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode().translate(_BYTES).split()


@dataclass
class Block:
    """Queries of a block: their ids, and the terms of each as numbers of the block's own."""

    items: list[int | None]
    terms: dict[bytes, int]
    of_item: list[np.ndarray]


def block_of(rows: list[tuple[int | None, str | None]]) -> Block:
    numbers: dict[bytes, int] = {}
    each = [np.array([numbers.setdefault(t, len(numbers)) for t in dict.fromkeys(terms_of(text))], np.int64) for _, text in rows]
    return Block([r[0] for r in rows], numbers, each)


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's terms with repeats, and its counts of the block's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "terms": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            n, ends, names, times = [], [0], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                known, tfs = np.unique(np.array([t for t in map(number, found) if t is not None], np.int32), return_counts=True)
                n.append(len(found))
                names.append(known)
                times.append(tfs.astype(np.int32))
                ends.append(ends[-1] + len(known))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int32)]))) for x in (names, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=list(kinds))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(total: int, frequencies: np.ndarray) -> np.ndarray:
    """The weight of each term by how many of `total` documents hold it."""
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)


def shards(docs: DataFrame, block: Block) -> tuple[DataFrame, np.ndarray]:
    """The block's index, a row a shard, and the lengths of its lists; terms that weigh nothing have none.

    A row is (doc_ids, doc, term, impact, position): arrays of the shard's documents, and of its hits, in which doc is
    a place in doc_ids and position counts from 0.
    """
    counts = stored(counted(docs, block.terms).withColumn("row", F.monotonically_increasing_id()), "search-counts")
    n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies, lengths = np.zeros(len(block.terms), np.int64), np.zeros(len(block.terms), np.int64)
    for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        frequencies[term] = df
    own = weights(n_docs, frequencies)
    lengths[own > 0] = frequencies[own > 0]
    table = docs.sparkSession.createDataFrame([(int(t), int(own[t])) for t in np.flatnonzero(lengths)], "term int, weight long")
    hits = counts.select("doc_id", "row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("h"))
    long = F.lit(10) + F.expr(f"(90 * n * {n_docs}L) div {max(n_terms, 1)}L")
    valued = hits.select("doc_id", "row", F.col("h.terms").alias("term"), F.col("h.tfs").cast("long").alias("tf"), long.alias("m")).join(F.broadcast(table), "term")  # the terms of a block
    impacts = valued.select("term", F.expr("weight * ((1000000000 * tf) div (1000 * tf + 8 * m))").alias("impact"), "doc_id", "row").where("impact > 0")
    placed = ranked(impacts, ["term"], [F.desc("impact"), F.col("doc_id"), F.col("row")], "search-lists", "position")

    def together(table: pa.Table) -> pa.Table:
        rows, doc = np.unique(table["row"].to_numpy(), return_inverse=True)
        at = np.argsort(doc, kind="stable")
        ids = table["doc_id"].combine_chunks().take(pa.array(np.unique(doc, return_index=True)[1]))
        columns = {"doc": doc[at].astype(np.int32), "term": table["term"].to_numpy()[at], "impact": table["impact"].to_numpy()[at], "position": table["position"].to_numpy()[at]}
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        return pa.table({"doc_ids": whole(ids), **{k: whole(v) for k, v in columns.items()}})

    by = placed.withColumn("shard", F.shiftright("row", SHARD_BITS)).groupBy("shard")
    return by.applyInArrow(together, "doc_ids array<long>, doc array<int>, term array<int>, impact array<long>, position array<long>"), lengths


#: What a round puts out: the best documents of a query in a task (kind 0: query, document, score) and the words of
#: positions seen (kind 1: query, term, word, bits, an impact in it).
_FOUND = "kind int, query int, term int, word long, bits long, doc_id long, value long"
_KINDS = {"kind": pa.int32(), "query": pa.int32(), "term": pa.int32(), "word": pa.int64(), "bits": pa.int64(), "doc_id": pa.int64(), "value": pa.int64()}


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    own = {"kind": np.full(n, kind, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(own[c], t) if c in own else pa.nulls(n, t) for c, t in _KINDS.items()], names=list(_KINDS))


def _order(x: tuple[int, int | None]) -> tuple:
    """Higher scores first, then smaller ids, null before all."""
    return -x[0], x[1] is not None, x[1] or 0


class Round:
    """What tasks need of a round: which live queries want which term, each to what depth, and how far runs are followed."""

    def __init__(self, block: Block, live: list[int], depth: np.ndarray, top: int):
        pairs = sorted((int(t), q) for q in live for t in block.of_item[q])
        self.query = np.array([q for _, q in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(block.terms) + 1))
        self.queries, self.depth, self.top = len(block.items), depth, top

    def wanted(self, term: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hit, query) of each of the hits `at` with each live query that has its term, PAIRS or so at a time."""
        n = self.first[term[at] + 1] - self.first[term[at]]
        ends = np.cumsum(n)
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS)), len(at)])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own, many = at[lo:hi], n[lo:hi]
            hit = np.repeat(own, many)
            yield hit, self.query[self.first[term[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)]

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int | None]]] = {}
        deepest = self.depth.max(initial=0)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, *hits = (batch.column(c)[i].values for c in range(5))
                doc, term, impact, position = (x.to_numpy() for x in hits)
                seen, score = np.zeros((self.queries, len(ids)), bool), np.zeros((self.queries, len(ids)), np.int64)
                for hit, query in self.wanted(term, np.flatnonzero(position < deepest)):
                    read = position[hit] < self.depth[query]
                    seen[query[read], doc[hit[read]]] = True
                for hit, query in self.wanted(term, np.flatnonzero(seen.any(axis=0)[doc])):
                    direct = seen[query, doc[hit]]  # direct accesses: all hits of the documents read
                    hit, query = hit[direct], query[direct]
                    np.add.at(score, (query, doc[hit]), impact[hit])
                    run = (position[hit] >= self.depth[query] - 64) & (position[hit] < self.depth[query] * DEEPER)
                    hit, query = hit[run], query[run]
                    yield _rows(1, len(hit), query=query, term=term[hit], word=position[hit] >> 6, bits=np.int64(1) << (position[hit] & 63), value=impact[hit])
                for q in np.flatnonzero(seen.any(axis=1)):
                    old = best.get(q, [])
                    found = np.flatnonzero(score[q] >= (old[-1][0] if len(old) == self.top else 1))
                    if len(found) > self.top:
                        found = found[score[q, found] >= np.partition(score[q, found], -self.top)[-self.top]]
                    best[q] = sorted([*old, *((int(score[q, d]), ids[int(d)].as_py()) for d in found)], key=_order)[: self.top]
        flat = [(q, *x) for q, own in best.items() for x in own]
        yield _rows(0, len(flat), query=[x[0] for x in flat], value=[x[1] for x in flat], doc_id=[x[2] for x in flat])


def _bounds(found: DataFrame, lists: DataFrame) -> DataFrame:
    """(query, bound): the sum of the impacts at the best positions of its lists (query, term, length, depth).

    A list that is seen to its end adds nothing. A word is full if all its positions are seen; the run of full words
    goes from the last word read. At most DEEPER * depth / 64 words of a list meet.
    """
    words = found.where("kind = 1").groupBy("query", "term", "word").agg(F.bit_or("bits").alias("bits"), F.min("value").alias("value"))
    known = words.join(lists, ["query", "term"]).where("length > depth")
    full = known.where(F.bit_count("bits") == F.least(F.lit(64).cast("long"), F.col("length") - 64 * F.col("word")))
    nth = F.row_number().over(Window.partitionBy("query", "term").orderBy("word"))
    run = full.withColumn("nth", nth).where(F.col("word") - F.col("nth") == F.floor(F.col("depth") / 64) - 2)
    ends = run.groupBy("query", "term").agg(F.min(F.when(64 * (F.col("word") + 1) >= F.col("length"), 0).otherwise(F.col("value"))).alias("bound"))
    return ends.groupBy("query").agg(F.sum("bound").alias("bound"))


def _searched(docs: DataFrame, block: Block, top: int) -> DataFrame:
    """RESULT of a block's queries."""
    spark = docs.sparkSession
    lists, lengths = shards(docs, block)
    index, heads = stored(lists, "search-index"), {}
    # the impacts of a list at the powers of two, from which the depth of a round is taken
    grid = index.select(F.explode(F.arrays_zip("term", "position", "impact")).alias("h")).select("h.*").where((F.col("position") + 1).isin([2**i for i in range(9, 40)]))
    for term, position, impact in grid.toLocalIterator():
        heads.setdefault(position + 1, np.zeros(len(lengths), np.int64))[term] = impact
    mine = [own[lengths[own] > 0] for own in block.of_item]
    block = Block(block.items, block.terms, mine)
    live, depth, parts = [q for q, own in enumerate(mine) if len(own)], np.full(len(mine), DEPTH), []

    def plain(q: int, at: int) -> int:
        """The sum of the impacts at a depth; lists that end there add nothing."""
        return int(sum(heads[at][t] for t in mine[q] if lengths[t] > at)) if at in heads else 0

    while live:
        found = stored(index.mapInArrow(Round(block, live, depth, top).search, _FOUND), "search-found")
        of = spark.createDataFrame([(q, int(t), int(lengths[t]), int(depth[q])) for q in live for t in mine[q]], "query int, term int, length long, depth long")
        bounds = dict(_bounds(found, F.broadcast(of)).collect())  # a number a query of the block
        order = Window.partitionBy("query").orderBy(F.desc("value"), "doc_id")
        tops = stored(found.where("kind = 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "search-tops")
        kth = dict(tops.where(F.col("rank") == top).select("query", "value").collect())
        done = [q for q in live if bounds.get(q, 0) == 0 or bounds[q] < kth.get(q, 0)]
        named = F.broadcast(spark.createDataFrame([(q, block.items[q]) for q in done], "query int, item_id long"))
        parts.append(tops.join(named, "query").select("item_id", "rank", "doc_id", F.col("value").alias("score")))
        live = [q for q in live if q not in set(done)]
        for q in live:
            at = 2 * depth[q]
            while at < depth[q] * DEEPER and plain(q, int(at)) >= kth.get(q, 0):
                at *= 2
            depth[q] = at
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], RESULT)


def blocks(queries: DataFrame) -> Iterator[Block]:
    """Queries (item_id, text) as blocks of at most QUERIES rows and about BLOCK distinct terms."""
    rows: list[tuple[int | None, str | None]] = []
    size = 0
    for item, text in queries.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        rows.append((item, text))
        size += len(text or "") // 6
        if len(rows) == QUERIES or size > BLOCK:
            yield block_of(rows)
            rows, size = [], 0
    if rows:
        yield block_of(rows)


def searched(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best rows of docs (doc_id, text) for each row of queries (item_id, text).

    Scores are above 0; equal ones by ascending doc_id, null first. Null and empty texts have no terms, and queries
    without terms no rows. Repeated rows of docs are ranked each, repeated queries answered each. Texts are read whole.
    Other columns are ignored, whatever their names. Empty tables give an empty table.
    """
    results = [docs.sparkSession.createDataFrame([], RESULT)]
    with scratch(docs.sparkSession) as kept:
        for block in blocks(queries):
            with scratch(docs.sparkSession) as own:
                results.append(own.stored(_searched(docs, block, top), "search-results"))
            kept.paths |= own.paths
    return reduce(DataFrame.union, results)


#: DuckDB SQL for searched() of benchmark over documents.
SQL = r"""
with raw as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
d as (select * from raw where len(t) > 0),
g as (select count(*) as nd, sum(len(t)) as l from d),
tf as (select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from (select r, doc_id, len(t) as n, unnest(t) as term from d) group by r, term),
df as (select term, count(*) as df from tf group by term),
q as (select distinct i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
      from (select row_number() over () as i, item_id, text from benchmark)),
w as (select term, cast(floor(1000 * ln(cast(2 * nd + 2 as double) / (2 * df + 1))) as bigint) as w from df, g),
s as (select i, item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) as bigint) as score
      from q join tf using (term) join w using (term), g group by i, item_id, r, doc_id),
ranked as (select item_id, cast(row_number() over (partition by i order by score desc, doc_id nulls first) as int) as rank, doc_id, score from s where score > 0)
select * from ranked where rank <= 10
"""
