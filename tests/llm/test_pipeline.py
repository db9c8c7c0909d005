"""The pipeline against its operators, and the guard that lets the rest live without it."""

import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from trialspark.llm import near_duplicates, secret_scan

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def passes_base(text):
    w = WORDS(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    return len(w) >= 50 and 100 * len(inside) <= 50 * len(w)


def cleaned(rows):
    """doc_id -> text after the quality rules, for those that pass."""
    key = lambda line: " ".join(WORDS(line.lower()))
    held = defaultdict(set)
    for r in rows:
        if r[1] is not None:
            for line in r[1].split("\n"):
                held[r[3], key(line)].add(r[1])
    boiler = {k for k, texts in held.items() if k[1] and len(texts) > 20}
    out = {}
    for r in rows:
        if r[1] is not None and passes_base(r[1]):
            left = "\n".join(x for x in r[1].split("\n") if (r[3], key(x)) not in boiler)
            if len(WORDS(left)) >= 0.5 * len(WORDS(r[1])):
                out[r[0]] = left
    return out


def first_of_classes(texts):
    """The least id of each connected component under a five-word Jaccard similarity of 0.8."""
    shingles = {i: set(zip(*(WORDS(t)[k:] for k in range(5)), strict=False)) for i, t in texts.items()}
    parent = {i: i for i in texts}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in texts:
        for j in texts:
            if i < j and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {find(i) for i in texts}


def without_secrets(text):
    spans = sorted((m.start(), i, m.end()) for i, r in enumerate(secret_scan.RULES) for m in re.finditer(r.regex, text) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for a, i, b in spans:
        if a >= at:
            out += text[at:a] + f"[{secret_scan.RULES[i].kind}]"
        at = max(at, b)
    return out + text[at:]


def test_run_equals_brute_force(spark, tmp_path):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choices(vocab, k=40)) for _ in range(3)]
        lines.insert(1, "Share   THIS page")
        if i % 7 == 0:
            lines.append(f"password = {'x9' * 8} AKIA{'B' * 16}")
        rows.append((i, "\n".join(lines), "en", f"s{i % 2}", 1))
    for i in range(12):
        w = rows[i][1].split(" ")
        w[5] = "edited"
        rows.append((100 + i, " ".join(w), "en", "s0", 1))
    rows += [(200 + i, rows[i][1], None, None, None) for i in range(4)] + [(300, None, "en", "s0", 0), (301, "", "en", "s0", 0), (302, "short text", "en", "s1", 1), (303, "a b " * 60, "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = cleaned(rows)
    kept = first_of_classes(want)
    texts = {i: without_secrets(want[i]) for i in kept}
    assert any("[assign]" in t for t in texts.values()) and len(kept) < len(want) < len(rows) and not any("THIS page" in t for i, t in texts.items() if i < 100)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, str(tmp_path)).cache()
        got = {r.doc_id: r.text for r in docs.collect()}
        assert got == [want, {i: want[i] for i in kept}, texts][n]
    theirs = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    taken = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        text = theirs.decode(r.ids, skip_special_tokens=False)
        assert theirs.encode(text, add_special_tokens=False).ids == list(r.ids) and r.n_tokens == len(r.ids)
        own, words = WORDS(texts[r.doc_id]), WORDS(text)
        left = iter(own)
        assert all(w in left for w in words)  # the words of a lap, in the document's order
        taken[r.doc_id] += len(words)
    assert all(n <= 3 * len(WORDS(texts[i])) for i, n in taken.items())
    total = sum(len(WORDS(t)) for t in texts.values())
    assert abs(sum(taken.values()) - total) <= 0.05 * total


def test_run_on_an_empty_table_and_on_a_long_text(spark, tmp_path):
    rng = random.Random(1)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(vocab, k=60_000))
    rows = [(1, long, "en", "s", len(long)), (2, long + " end", None, "s", 0), (3, " ".join(rng.choices(vocab, k=80)), None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "long" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "long")).collect()
    assert {r.doc_id for r in got} == {1, 3} and sum(r.n_tokens for r in got) > 60_000 and all(len(r.ids) == r.n_tokens for r in got)


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    quality, deduplicate, redact, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    one = quality(spark, docs, sf).cache()
    assert one.columns == docs.columns and 0 < one.count() <= docs.count()
    two = deduplicate(spark, one, sf).cache()
    classes = near_duplicates.near_duplicate_classes(one).select("class_id").distinct().count()
    assert two.count() == classes
    three = redact(spark, two, sf).cache()
    assert three.count() == two.count()
    assert secret_scan.span_digests(three).where("n_assign + n_access + n_hex > 0").count() == 0
    four = mix(spark, three, sf).cache()
    assert four.columns == docs.columns
    five = encode(spark, four, sf)
    assert five.count() == four.count() and five.where("size(ids) <> n_tokens").count() == 0


def test_the_rest_imports_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    (tmp_path / "trialspark").mkdir()
    for p in (root / "trialspark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "trialspark" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = f"import sys; sys.path[:] = [p for p in sys.path if p not in ('', {str(root)!r})]; sys.path.insert(0, {str(tmp_path)!r})\nimport __spark_entry__ as e; assert len(e.queries()) > 50 and not [q for q in e.queries() if q[:2] == 'op' and q[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
