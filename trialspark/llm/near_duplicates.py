"""Near-duplicate documents by order MinHash, candidates verified by banded alignment.

Texts are first grouped by content, so copies cost nothing below. Each distinct text is cut into shingles of five
words, every shingle labelled with its occurrence number. For each of ROWS * BANDS hash functions we take the TUPLE
smallest labelled shingles and keep them in text order; ROWS such tuples make a band key. Texts that share a key are
candidates. A candidate pair is a link if the best alignment of the two shingle sequences, searched only in the band of
offsets that a similarity of 0.8 allows, has aligned / (n + m - aligned) >= 0.8. Classes are connected components.

A bucket of up to SMALL texts is compared pair by pair. A larger one is first compared with two leaders, one by a hash
of the text and one by a hash of text and key; that only saves work. Then, in every bucket that still holds two
components, each member outside its largest component is compared with all members. Both sides are dealt to cells of
bounded size. A cell counts exactly how many shingles its pairs share, drops those that share too few to be links, and
aligns the others, the nearest first, unless they have become one component. So the classes are the components of the
links among all candidates, whatever the sizes of buckets and whatever the leaders are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import WORD, fresh, joined_copies, scratch, stored, words

SHINGLE, SIMILARITY = 5, 0.8
TUPLE, ROWS, BANDS = 2, 2, 12
SMALL = 6
#: Words and texts of one side of a cell, about; a longer text is a side of its own. Pairs of texts split at a time.
CELL_WORDS, CELL_TEXTS, AT_ONCE = 100_000, 2_000, 200
#: Columns of a cell's table of shingles that are multiplied at a time.
COLUMNS = 4096

_U = np.uint64
_SEEDS = np.random.default_rng(20240611).integers(1, 2**63, size=(3, ROWS * BANDS), dtype=np.uint64) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def labelled_shingles(word_hashes: np.ndarray) -> np.ndarray:
    """The hashes of a text's shingles in order, each with its occurrence number; there is a word at least."""
    n = len(word_hashes)
    k = min(SHINGLE, n)
    grams = np.zeros(n - k + 1, _U)
    for j in range(k):
        grams = grams * _U(0x9E3779B97F4A7C15) + word_hashes[j : n - k + 1 + j]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    if not first.all():
        at = np.arange(len(ranked))
        nth = np.empty(len(ranked), _U)
        nth[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(_U)
        grams = grams + nth * _U(0xD6E8FEB86659FD93)
    return _mix(grams)


def band_keys(labelled: np.ndarray) -> np.ndarray:
    """The band keys of one text from its labelled shingles."""
    tuples = np.empty(ROWS * BANDS, _U)
    step = max(1, 1_000_000 // len(labelled))
    for lo in range(0, ROWS * BANDS, step):
        seeds = _SEEDS[:, lo : lo + step, None]
        h = (labelled[None, :] ^ seeds[0]) * seeds[1]
        h ^= h >> _U(32)
        h *= seeds[2]
        rows = np.arange(len(h))
        places = []
        for _ in range(min(TUPLE, len(labelled))):
            p = h.argmin(1)
            places.append(p)
            h[rows, p] = _U(0xFFFFFFFFFFFFFFFF)
        key = np.zeros(len(h), _U)
        for p in np.sort(np.stack(places), axis=0):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + labelled[p])
        tuples[lo : lo + step] = key
    out = np.arange(BANDS, dtype=_U)
    for r in range(ROWS):
        out = _mix(out * _U(0xC2B2AE3D27D4EB4F) + tuples[r::ROWS])
    return out.view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("words")
        flat, at = lists.flatten().to_numpy(zero_copy_only=False).view(_U), lists.offsets.to_numpy()
        at = at - at[0] if len(at) else at
        keys = [band_keys(labelled_shingles(flat[lo:hi])) if hi > lo else None for lo, hi in zip(at[:-1], at[1:], strict=True)]
        made = [pa.array(np.diff(at), pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), *made], names=["node", "doc_id", "n_words", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """(node, rep, n_rows, n_words, bands): one row a distinct text; docs has doc_id and text. Null texts are left out."""
    hashed = docs.where(F.col("text").isNotNull()).select(
        F.md5("text").alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words")
    )
    rows = hashed.mapInArrow(_sketch_batches, "node string, doc_id long, n_words long, bands array<long>")
    return rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))


def aligned(a: list, b: list, below: int, above: int) -> int:
    """The length of the longest common subsequence among alignments whose column - row stays in [-below, above].

    One big integer holds the band of a row of the dynamic program, a zero bit for each column where the length grows.
    """
    n, m, head = len(a), len(b), 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head : n - tail], b[head : m - tail]
    if not a or not b:
        return head + tail
    places = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    width = below + above + 1
    every, top = (1 << width) - 1, 1 << (width - 1)
    band, done = every, 0
    for i, x in enumerate(a):
        lo = i - below
        if i:
            done += not band & 1
            band = band >> 1 | top
        at = places.get(x)
        if at:
            match = 0
            for j in at[bisect_left(at, lo) : bisect_right(at, lo + width - 1)]:
                match |= 1 << (j - lo)
            if match:
                both = band & match
                band = ((band + both) | (band - both)) & every
    return head + tail + done + width - band.bit_count()


_words_of = re.compile(WORD).findall


def shingle_numbers(texts: list[str]) -> list[np.ndarray]:
    """The shingles of each text in order, as numbers that are equal where and only where shingles are.

    A text of fewer than SHINGLE words is one shingle; one without words has none.
    """
    names: dict[str, int] = {}
    numbered = []
    for t in texts:
        w = _words_of(t)
        numbered.append([names.setdefault(x, len(names) + 1) for x in w] + [0] * (SHINGLE - len(w) if w else 0))
    flat = np.fromiter((x for n in numbered for x in n), np.int64)
    lengths = np.array([len(n) for n in numbered], np.int64)
    grams, kinds = flat, len(names) + 1
    for k in range(1, SHINGLE):  # each round appends a word; windows that cross texts are cut away below
        following = np.zeros(len(flat), np.int64)
        following[: max(len(flat) - k, 0)] = flat[k:]
        distinct, grams = np.unique(grams * (len(names) + 1) + following, return_inverse=True)
        kinds = len(distinct)
    ends = np.cumsum(lengths)
    return [grams[end - n : max(end - SHINGLE + 1, end - n)] for n, end in zip(lengths, ends, strict=True)]


def least_aligned(n, m):
    """The shingles that must be aligned for SIMILARITY; a sum that divides evenly is not rounded up."""
    return np.ceil(SIMILARITY * (n + m) / (1 + SIMILARITY) - 1e-9)


def is_link(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sequences of shingles have an ordered overlap of SIMILARITY or more."""
    n, m = len(x), len(y)
    if not n or not m:
        return n == m
    need = int(least_aligned(n, m))
    return need <= min(n, m) and aligned(x.tolist(), y.tolist(), n - need, m - need) >= need


def similarity(a: list[str], b: list[str]) -> float:
    """The ordered overlap of the shingles of two lists of words."""
    x, y = shingle_numbers([" ".join(a), " ".join(b)])
    n, m = len(x), len(y)
    if not n or not m:
        return float(n == m)
    found = aligned(x.tolist(), y.tolist(), n, m)
    return found / (n + m - found)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), AT_ONCE):
            part = batch.slice(lo, AT_ONCE)
            shingles = shingle_numbers(part.column("text_a").to_pylist() + part.column("text_b").to_pylist())
            yes = pa.array([is_link(shingles[i], shingles[i + len(part)]) for i in range(len(part))], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(yes)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n_words, size, one, two): the rows of all buckets of two texts or more, with the bucket's two leaders."""
    members = nodes.select("node", "n_words", F.explode("bands").alias("key"))
    leader = lambda *by: F.min(F.struct(F.xxhash64(*by).alias("p"), F.col("node").alias("node"), F.col("n_words").alias("n")))
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), leader("node").alias("one"), leader("node", "key").alias("two")).where("size > 1")
    return members.join(buckets, "key")


def texts_of(docs: DataFrame, shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of every text in a shared bucket, read once, by the id of its first copy."""
    asked = shared.select("node").distinct().join(nodes.select("node", "rep"), "node")
    own = docs.select(F.md5("text").alias("of"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(asked, (own.of == asked.node) & own.doc_id.eqNullSafe(asked.rep)).select("node", "text").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are links."""
    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify_batches, "a string, b string")


def _pairs(a, b, na, nb):
    """struct(a, b) in order, null where the texts are one or their lengths rule out the similarity."""
    short, long = F.greatest(F.least(na, nb) - SHINGLE + 1, F.lit(1)), F.greatest(na, nb) - SHINGLE + 1
    return F.when((a != b) & (short + 1e-9 >= SIMILARITY * long), F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def candidate_pairs(shared: DataFrame) -> DataFrame:
    """Distinct (a, b): all pairs of a small bucket, and of a larger one each member with both leaders."""
    star = shared.where(F.col("size") > SMALL).select(F.explode(F.array(*[_pairs(F.col(x)["node"], F.col("node"), F.col(x)["n"], F.col("n_words")) for x in ("one", "two")])).alias("p"))
    few = shared.where(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("node", F.col("n_words").alias("n"))).alias("m"))
    all_of = F.flatten(F.transform("m", lambda x: F.transform("m", lambda y: _pairs(x["node"], y["node"], x["n"], y["n"]))))
    small = few.select(F.explode(F.array_distinct(all_of)).alias("p"))
    return star.union(small).where("p is not null").select("p.a", "p.b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): a label for each node of links (a, b), the same within a connected component and only there.

    By randomised contraction: a round maps each node to the one within two steps of it that comes first by a hash of
    node and round; both ends of the links are replaced, links within a node and repeated ones go. A star or a clique
    is one node after a round, and any graph shrinks by a constant factor. The maps are composed from the last, and
    smallest, to the first.
    """
    edges, maps = links.select(F.col("a").alias("u"), F.col("b").alias("v")), []
    while True:
        first = lambda x, r=len(maps): F.struct(F.xxhash64(x, F.lit(r)).alias("h"), F.col(x).alias("to"))
        both = edges.union(edges.select("v", "u"))
        near = both.groupBy("u").agg(F.min(first("v")).alias("f")).select(F.col("u").alias("v"), F.least("f", first("u")).alias("f"))
        further = both.join(near, "v").groupBy("u").agg(F.min("f").alias("f"))
        maps.append(stored(further.select(F.col("u").alias("node"), F.col("f.to").alias("label")), "contraction"))
        end = lambda x: maps[-1].select(F.col("node").alias(x), F.col("label").alias(f"{x}_to"))
        ends = edges.join(end("u"), "u").join(end("v"), "v").where("u_to <> v_to")
        edges = stored(ends.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct(), "contracted")
        if edges.isEmpty():
            break
    labels = maps.pop()
    while maps:
        labels = stored(relabelled(maps.pop(), labels), "labels")
    return labels


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (label, others) with the label of their label in labels (node, label), if it has one."""
    after = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
    return rows.join(after, "label", "left").withColumn("label", F.coalesce("last", "label")).select(*rows.columns)


def between(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The links found (a, b) as links between labels; a node without a label is its own."""
    ends = relabelled(found.select("b", F.col("a").alias("label")), labels).withColumnRenamed("label", "a")
    other = relabelled(ends.select("a", F.col("b").alias("label")), labels).withColumnRenamed("label", "b")
    return other.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of left shares with each of right, repeated ones counted; no alignment is longer."""
    out = np.zeros((len(left), len(right)), np.float32)
    lengths = [len(x) for x in (*left, *right)]
    row, flat = np.repeat(np.arange(len(lengths)), lengths), np.concatenate([*left, *right]).astype(np.int64)
    order = np.lexsort((flat, row))
    row, flat = row[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(flat))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    _, column = np.unique(flat * (nth.max(initial=0) + 1) + nth, return_inverse=True)
    on_left = row < len(left)
    both = np.intersect1d(column[on_left], column[~on_left])
    kept = np.isin(column, both)
    row, column = row[kept], np.searchsorted(both, column[kept])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, len(both), COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        table = np.zeros((len(lengths), min(COLUMNS, len(both) - lo)), np.float32)
        table[row[part], column[part] - lo] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


def cell_links(cell: pd.DataFrame) -> pd.DataFrame:
    """(a, b): links that join the components of a cell, whose rows are (node, label, text, other, left).

    Every pair of a left and a right row of two labels is either ruled out by what it shares, aligned, or in one
    component by links already found.
    """
    sides = [cell[cell["left"]], cell[~cell["left"]]]
    if not all(len(s) for s in sides):
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    shingles = shingle_numbers([*sides[0]["text"], *sides[1]["text"]])
    left, right = shingles[: len(sides[0])], shingles[len(sides[0]) :]
    n, m = (np.array([len(x) for x in s], float) for s in (left, right))
    need = least_aligned(n[:, None], m[None, :])
    near = need <= np.minimum(n[:, None], m[None, :])
    labels, codes = np.unique(np.concatenate([s["label"] for s in sides]).astype(str), return_inverse=True)
    of = codes[: len(left)], codes[len(left) :]
    near &= of[0][:, None] != of[1][None, :]
    nodes = [s["node"].to_numpy(str) for s in sides]
    # two members outside the largest component meet twice, and are compared once
    near &= ~sides[1]["other"].to_numpy(bool)[None, :] | (nodes[0][:, None] < nodes[1][None, :])
    out = []
    if near.any():
        shared = shared_counts(left, right)
        near &= shared >= need
        i, j = np.nonzero(near)
        parent = list(range(len(labels)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for k in np.argsort(need[i, j] - shared[i, j], kind="stable"):
            u, v = root(of[0][i[k]]), root(of[1][j[k]])
            if u != v and is_link(left[i[k]], right[j[k]]):
                parent[u] = v
                out.append(sorted((nodes[0][i[k]], nodes[1][j[k]])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=object)


def links_across(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join the components of each bucket of members (key, node, n_words).

    In a bucket with two components or more, the members outside the largest one meet all members. Both sides are dealt
    by a hash to cells of about CELL_WORDS words or CELL_TEXTS texts a side, so no task holds a bucket, nor a table of
    more pairs than CELL_TEXTS squared, about.
    """
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    weight = F.greatest(F.col("n_words"), F.lit(CELL_WORDS // CELL_TEXTS))
    per = named.groupBy("key", "label").agg(F.count("*").alias("size"), F.sum(weight).alias("words"))
    top = F.max_by(F.struct("label", "words"), F.struct("size", "label")).alias("top")
    tops = per.groupBy("key").agg(F.sum("words").alias("all"), top, F.count("*").alias("parts")).where("parts > 1")
    sides = lambda w: F.greatest(F.ceil(w / CELL_WORDS), F.lit(1)).cast("int")
    cells = tops.select("key", F.col("top.label").alias("most"), sides(F.col("all")).alias("wide"), sides(F.col("all") - F.col("top.words")).alias("high"))
    rows = named.join(cells, "key").withColumn("other", F.col("label") != F.col("most")).join(texts, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    right = F.transform(each("high"), lambda i: place(i, own("wide"), False))
    left = F.transform(each("wide"), lambda j: place(own("high"), j, True))
    places = F.when(F.col("other"), F.concat(right, left)).otherwise(right)
    dealt = rows.select("key", "node", "label", "text", "other", F.explode(places).alias("at")).select("key", "at.*", "node", "label", "text", "other")
    return dealt.groupBy("key", "i", "j").applyInPandas(cell_links, "a string, b string").distinct()


def text_classes(docs: DataFrame) -> DataFrame:
    """(node, rep, n_rows, class_id): one row a distinct text, class_id being the least rep of its class."""
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as made:
        nodes = stored(sketches(docs), "sketches")
        shared = stored(shared_buckets(nodes), "shared")
        texts = stored(texts_of(docs, shared, nodes), "near-texts")
        labels = components(stored(verified(candidate_pairs(shared), texts), "links"))
        large = shared.where(F.col("size") > SMALL).select("key", "node", "n_words")
        more = components(stored(between(links_across(large, labels, texts), labels), "links"))
        known = nodes.select("node", "rep", "n_rows", F.col("node").alias("label"))
        named = stored(relabelled(relabelled(known, labels), more), "named")
        least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
        out = named.join(least, "label").select("node", "rep", "n_rows", "class_id")
        return made.stored(out, "classes")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_copies, kept): one row for each row of docs (doc_id, text; other columns are ignored).

    class_id is the least doc_id of the class. n_copies counts the rows with this very text. kept marks the rows whose
    doc_id is class_id. A null text is in no class: class_id is its doc_id, one copy, kept. Empty texts are copies of
    each other. Texts without words and with different blanks are not compared. Repeated rows stay repeated. A null
    doc_id counts as larger than all others. Texts are taken whole: a very long one costs its task memory in proportion
    to its words. An empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("node"))
    classes = text_classes(docs)
    out = joined_copies(rows, classes, "node", "n_rows", F.xxhash64("doc_id"), "class")
    some = F.col("node").isNotNull()
    return out.select(
        "doc_id",
        F.when(some, F.col("class.class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(some, F.col("class.n_rows")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
        F.when(some, F.col("doc_id").eqNullSafe(F.col("class.class_id"))).otherwise(True).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs with the least doc_id of their class, one a class; all columns stay. Rows with null text stay.

    The class's row is found by text and id, a key that no group of copies makes hot; repeated rows are dropped.
    """
    classes = text_classes(docs)
    node, key, of = fresh(docs, "node_md5"), fresh(docs, "keep_id"), fresh(docs, "keep_node")
    firsts = classes.where(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("node").alias(of)).select(F.col("class_id").alias(key), of)
    rows = docs.withColumn(node, F.md5("text"))
    kept = rows.join(firsts, (F.col(node) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(key))).dropDuplicates([node, "doc_id"])
    return kept.select(*docs.columns).union(docs.where(F.col("text").isNull()))
