"""Packing, sharded clustering and ranked search against plain versions, on small tables with odd rows."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import common, lexical_search, queries, sequence_packing, sharded_lloyd

DOCS = "doc_id long, text string, TEXT_ string, sequence_id long, rank string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(120)] + ["É", "ß", "x9", "B"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocab, weights=[1 / (i + 1) for i in range(len(vocab))], k=n))
    out = [(i, text(rng.choice([1, 3, 10, 40, 200])), "x", 1, None) for i in range(150)]
    out += [(200, None, None, None, None), (201, "", "", 1, "r"), (202, " ,.", "", 1, "r"), (203, text(12_000), "", 1, "r"), (None, text(30), "", 1, "r"), out[3], out[3]]
    return out + [(300 + i, out[5][1], "", 1, "r") for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_ranked_numbers_keys_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id", F.lit(1).alias("ranked_at"))
    got = common.ranked(df, ["k"], [F.desc("v"), F.col("id")], "test-ranked").collect()
    for k in range(3):
        own = sorted((r for r in got if r.k == k), key=lambda r: (-r.v, r.id))
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.ranked_at for r in own} == {1}


def test_sweep_takes_the_tightest_gaps_by_rank():
    assert sequence_packing.sweep({400: (0, 1), 300: (2, 5), 90: (0, 9)}, {500: 1, 350: 2, 100: 3}) == [(400, 0, 1, 500, 0, 1), (300, 2, 4, 350, 0, 1), (90, 0, 3, 100, 0, 1)]
    assert sequence_packing.sweep({10: (0, 5)}, {25: 4}) == [(10, 0, 5, 25, 0, 2)]
    assert sequence_packing.opening({300: (1, 4), 200: (0, 9)}, 1024, 7) == [(300, 1, 4, 7)]
    assert sequence_packing.opening({600: (0, 2), 300: (1, 4)}, 1024, 7) == [(600, 0, 2, 7)]
    assert sequence_packing.cuts(2048) == [(0, 1024), (1024, 1024)] and sequence_packing.cuts(1030) == [(0, 6), (6, 1024)] and sequence_packing.cuts(7) == [(0, 7)]


def test_packing(docs, rows):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    got = sequence_packing.packed(docs, path).collect()
    theirs, want = tokenizers.Tokenizer.from_file(path), Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for i, (at, n) in enumerate(sequence_packing.cuts(len(ids))):
            want[doc_id, i, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    free, plain = [], 0
    for length in sorted((r.length for r in got), reverse=True):
        i = bisect.bisect_left(free, length)
        space = free.pop(i) if i < len(free) else 1024
        plain += i == len(free) and space == 1024
        bisect.insort(free, space - length)
    assert len(sequences) <= plain + 2
    assert sequence_packing.packed(docs.limit(0), path).collect() == []


def test_many_equal_short_documents_fill_whole_sequences(spark):
    public = pytest.importorskip("public_tokenizers")
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    got = sequence_packing.packed(many, public.path("byte_bpe_50k.json"))
    length = got.first().length
    assert got.select("sequence_id").distinct().count() == -(-3000 // (1024 // length))


def plain_lloyd(vectors, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(r[1]) for r in order[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[near(x)[1]].append(x)
        for k, xs in own.items():
            centroids[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    last = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, k, d in last:
        inertia[k] += d
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    return Counter((i, k, d, inertia[k], sum(inertia.values()), digest(k)) for i, k, d in last)


@pytest.mark.parametrize("n", [0, 5, 120])
def test_sharded_lloyd(spark, n):
    rng = random.Random(n)
    vector = lambda scale: [rng.gauss(0, scale) for _ in range(64)]
    rows = [(i, vector(0.2 + i % 4)) for i in range(n)]
    if n:
        rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 63 + [None]), (904, [math.nan] + [0.5] * 63), (905, [math.inf] + [0.1] * 63), (None, vector(1)), (906, vector(30_000)), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).repartition(3)
    got = Counter(tuple(r) for r in sharded_lloyd.clustered(df).collect())
    assert got == plain_lloyd(rows)


def test_values_that_64_bits_cannot_square_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="is beyond"):
        sharded_lloyd.clustered(df).collect()


def plain_search(rows, items, top=10):
    docs = [(i, Counter(t), len(t)) for i, t in ((r[0], lexical_search.terms_of(r[1])) for r in rows) if t]
    n_docs, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item, text in items:
        wanted = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(lexical_search.terms_of(text)) if df[t]}
        scores = [(sum(w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total))) for t, w in wanted.items() if c[t]), i) for i, c, n in docs]
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:top]
        out.update((item, r + 1, i, s) for r, (s, i) in enumerate(best))
    return out


@pytest.mark.parametrize(("depth", "bits", "few"), [(512, 9, 1000), (64, 3, 2)])
def test_best_positions(spark, docs, rows, monkeypatch, depth, bits, few):
    monkeypatch.setattr(lexical_search, "DEPTH", depth)
    monkeypatch.setattr(lexical_search, "SHARD_BITS", bits)
    monkeypatch.setattr(lexical_search, "QUERIES", few)
    monkeypatch.setattr(lexical_search, "PAIRS", 50)
    items = [(1, rows[0][1]), (2, rows[5][1]), (3, None), (4, ",."), (5, "nowhere"), (6, rows[203 - 200 + 150][1]), (None, "É x9"), (2, rows[5][1])]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    assert Counter(tuple(r) for r in lexical_search.searched(docs, asked).collect()) == plain_search(rows, items)
    assert lexical_search.searched(docs.limit(0), asked).collect() == [] and lexical_search.searched(docs, asked.limit(0)).collect() == []


def test_deep_lists_end_early_and_right(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randint(1, 60)))) for i in range(6000)]
    rows += [(7000 + i, "a b " * 20) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "a b"), (2, "a b c d e f g h i j"), (3, "j")]
    depths = []
    monkeypatch.setattr(lexical_search, "DEPTH", 64)
    first = lexical_search.Round.__init__
    monkeypatch.setattr(lexical_search.Round, "__init__", lambda self, block, live, depth, top: (depths.append({q: int(depth[q]) for q in live}), first(self, block, live, depth, top))[1])
    assert Counter(tuple(r) for r in lexical_search.searched(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == plain_search(rows, items)
    assert len(depths) > 1 and 0 not in depths[1]  # the query of rare terms ends at the first depth


def test_cells_are_bounded_in_texts(spark, monkeypatch):
    """Short texts of one bucket in two components: cells hold few texts a side, and the links are those of all pairs."""
    from trialspark.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "CELL_TEXTS", 20)
    monkeypatch.setattr(near_duplicates, "CELL_WORDS", 10_000)
    texts = [(f"n{i:03d}", " ".join(f"w{i}x{j}" for j in range(8)), 8) for i in range(150)] + [("a", "one two three four five six", 6), ("b", "one two three four five six", 6)]
    frame = spark.createDataFrame(texts, "node string, text string, n_words int")
    members = frame.select(F.lit("k").alias("key"), "node", "n_words")
    found = near_duplicates.links_across(members, spark.createDataFrame([], "node string, label string"), frame.select("node", "text"))
    assert [tuple(r) for r in found.collect()] == [("a", "b")]
    cells = frame.select(F.pmod(F.xxhash64("node"), F.lit(152 * 500 // 10_000 + 1)).alias("c")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert cells < 60


def test_new_queries_are_registered():
    assert {"op11_best_fit_sequences", "op12_sharded_lloyd", "op13_best_positions"} <= set(queries.QUERIES)
