"""Order of files, published bundles, guards inside the plan, canonical JSON and grades by content."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.functions.canonical import canonical_json
from trialspark.operators import graded, integrity, ranges, trajectory
from trialspark.plans import studies
from trialspark.sources import bundles, lines, records


def test_lines_of_a_file_in_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 40)
    rows = [{"task_id": i // 3, "candidate_index": i % 3, "pad": "x" * (i % 50)} for i in range(1000)]
    rows[500], rows[501] = rows[501], rows[500]
    (tmp_path / "one.jsonl").write_text("\n".join(json.dumps(r) + ("\n" if i == 7 else "") for i, r in enumerate(rows)) + "\n")
    (tmp_path / "two.jsonl").write_text(json.dumps(rows[0]) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = lines.ordered_json(spark, str(tmp_path), "task_id long, candidate_index long, pad string")
        assert got.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path / "one.jsonl")).rdd.getNumPartitions() > 9
        own = {(r.line, r.task_id, r.candidate_index) for r in got.where(F.col("file").endswith("one.jsonl")).collect()}
        assert own == {(i + (i > 7), r["task_id"], r["candidate_index"]) for i, r in enumerate(rows)}
        assert [r.line for r in lines.out_of_order(got, ["task_id", "candidate_index"]).collect()] == [501]
        assert [r.line for r in lines.preview(got, 20).collect()] == [*range(8), *range(9, 21)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    (tmp_path / "three.jsonl").write_text('{"task_id": 1, "cand')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        lines.ordered_json(spark, str(tmp_path), "task_id long").collect()


def test_a_bundle_is_seen_whole_or_not_at_all(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/bundle", "id long, v string"
    first, more = spark.range(100).withColumn("v", F.lit("ü")), spark.range(100, 130).withColumn("v", F.lit("x"))
    with pytest.raises(FileNotFoundError):
        bundles.read(spark, folder, "rows", schema)
    bundles.publish(spark, folder, {"rows": (first, ["id"]), "others": (more, ["id"])}, {"made": "a"}, files=4)
    assert len(list((tmp_path / "bundle/data/00000/rows").glob("part-*"))) > 1
    with pytest.raises(FileExistsError):
        bundles.publish(spark, folder, {"rows": (more, ["id"])}, {})
    assert bundles.publish(spark, folder, {"rows": (more, ["id"])}, {"made": "b"}, append=True) == "00001"
    assert bundles.read_about(spark, folder) == [{"made": "a"}, {"made": "b"}]
    got = bundles.read_ordered(spark, folder, "rows", schema).collect()
    assert sorted((r.line, r.id) for r in got) == [(i, i) for i in range(130)] and bundles.read(spark, folder, "rows", schema).count() == 130
    torn = tmp_path / "bundle/data/00002/rows"
    torn.mkdir(parents=True)
    (torn / "part-00000.json").write_text('{"id": 7')  # no manifest: not there
    assert bundles.read(spark, folder, "rows", schema).count() == 130
    assert bundles.publish(spark, folder, {"rows": (more.where("id < 102"), ["id"])}, {}, append=True) == "00002"
    assert bundles.read(spark, folder, "rows", schema).count() == 132
    part = next(p for p in sorted((tmp_path / "bundle/data/00000/rows").glob("part-*")) if p.stat().st_size)
    part.write_text(part.read_text().replace("ü", "u"))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    damaged = bundles.read(spark, folder, "rows", schema)
    with pytest.raises(Exception, match="differs from its manifest"):
        damaged.collect()


def test_guards_raise_when_read_and_not_before(spark):
    data, bad = spark.range(3), spark.createDataFrame([(5, "why")], "id long, rule string")
    assert integrity.guarded(data, bad.where("id < 0"), "x").count() == 3
    for rows in (data, data.where("id < 0"), spark.createDataFrame([], "id long")):
        held = integrity.guarded(rows, bad, "pool")
        with pytest.raises(Exception, match="pool: 1 violations, such as"):
            held.collect()


def _pool(tmp_path, change=lambda rows: rows):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [{"pool_id": "p", "task_id": t, "candidate_index": i, "sanitized_code": f"{t}{i}", "sanitized_code_sha256": digest(f"{t}{i}")} for t in ("b", "a") for i in range(2)]
    (tmp_path / "manifest.json").write_text(json.dumps({"pool_id": "p", "task_ids": ["b", "a"], "pool_size": 2}, indent=1))
    (tmp_path / "candidates.jsonl").write_text("".join(json.dumps(r) + "\n" for r in change(rows)))
    return f"file://{tmp_path}"


def test_a_damaged_pool_is_refused(spark, tmp_path):
    manifest, candidates = records.read_checked_pool(spark, _pool(tmp_path))
    assert candidates.count() == 4 and manifest.first().pool_size == 2
    changes = {"missing": lambda r: r[:3], "duplicate": lambda r: [*r, r[-1]], "digest": lambda r: [{**r[0], "sanitized_code": "z"}, *r[1:]], "order": lambda r: r[::-1], "unexpected": lambda r: [*r, {**r[-1], "task_id": "c"}]}
    for problem, change in changes.items():
        with pytest.raises(Exception, match=f"violations.*{problem}|violations"):
            records.read_checked_pool(spark, _pool(tmp_path, change))[1].collect()


def test_damaged_trajectories_are_refused(spark, tmp_path):
    step = lambda i, **more: {"pool_id": "p", "task_id": "t", "candidate_index": i, "operator": "sample", "root_index": i, "depth": 0, "round_index": i, "selected": False, "base_passed": False} | more
    tasks = spark.createDataFrame([("t",)], "task_id string")
    for name, rows, fine in (("good", [step(0), step(1, selected=True, base_passed=True)], True), ("gap", [step(0), step(2)], False), ("unpassed", [step(0), step(1, selected=True)], False)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        steps = records.read_checked_steps(spark, f"file://{tmp_path}/{name}.jsonl", tasks, 2)
        if fine:
            assert steps.count() == 2
        else:
            with pytest.raises(Exception, match="violations"):
                steps.collect()


def test_canonical_json_equals_the_library(spark):
    rng = random.Random(3)
    kind = T.StructType.fromDDL("z string, B double, a array<struct<y:boolean,x:bigint>>, m map<string,double>, n struct<q:string>")
    words = ["", "plain", 'quo"te\\', "ü\n\t\r\b\f\x00\x1f\x7f", "日本😀", "a/b", None]
    doubles = [0.0, -0.0, 1.0, 0.1, -2.5, 1e7, 123456789.125, 1e15, 1e16, 1.5e16, 1e-3, 1e-4, 1.25e-4, 1e-5, 9.99e-7, 1e22, 1e23, -1.7976931348623157e308, 100.0, 12345678.9, None]
    rows = []
    for i in range(120):
        item = [{"y": rng.choice([True, False, None]), "x": rng.choice([None, 0, -(2**63), 7])} for _ in range(rng.randrange(3))]
        rows.append({"z": words[i % 7], "B": doubles[i % len(doubles)] if i < 66 else rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20), "a": item if i % 5 else None, "m": {w: rng.choice(doubles) for w in rng.sample([x for x in words if x is not None], 3)}, "n": {"q": words[(i + 3) % 7]} if i % 4 else None})
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType([T.StructField("i", T.LongType()), T.StructField("r", kind)]))
    got = {r.i: r.j for r in df.select("i", canonical_json(F.col("r"), kind).alias("j")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == json.dumps(r, sort_keys=True, separators=(",", ":")), r
    with pytest.raises(TypeError):
        canonical_json(F.lit(None), T.DateType())


def test_root_digest_is_that_of_the_library_and_differences_have_names(spark):
    fields = ("operator", "input_tokens", "sampling")
    rows = [(p, t, i, 0, "sample", 5 + i, ("é", 0.5)) for p, w in (("3x1", 3), ("2x1", 2)) for t in ("a", "b") for i in range(w)]
    steps = spark.createDataFrame(rows, "pool_id string, task_id string, root_index long, depth long, operator string, input_tokens long, sampling struct<name:string,temperature:double>").repartition(3)
    got = trajectory.root_digest(steps, {"3x1": 3, "2x1": 2}, fields).first()
    plain = [{"task_id": t, "root_index": i, "operator": "sample", "input_tokens": 5 + i, "sampling": {"name": "é", "temperature": 0.5}} for t in ("a", "b") for i in range(2)]
    for r in plain:  # the digest covers the fields named and the task; the order comes from task and root
        del r["root_index"]
    import hashlib

    want = hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert (got.pool_ids, got.compared_root_count, got.unique_root_count, got.canonical_sha256) == (["3x1", "2x1"], 4, 4, want)
    other = steps.withColumn("input_tokens", F.col("input_tokens") + F.when((F.col("pool_id") == "2x1") & (F.col("task_id") == "b"), 1).otherwise(0)).where("not (pool_id = '2x1' and task_id = 'a' and root_index = 1)")
    found = {(r.challenger, r.task_id, r.root_index, r.field) for r in trajectory.root_differences(other, {"3x1": 3, "2x1": 2}, fields).collect()}
    assert found == {("2x1", "b", 0, "input_tokens"), ("2x1", "b", 1, "input_tokens"), ("2x1", "a", 1, "missing")}
    with pytest.raises(Exception, match="shared roots: 3 violations"):
        trajectory.root_digest(other, {"3x1": 3, "2x1": 2}, fields).collect()


def test_grades_by_content(spark):
    candidates = graded.with_digest(spark.createDataFrame([("t", 0, "a"), ("t", 1, "b"), ("t", 2, "a"), ("u", 0, "a")], "task_id string, candidate_index long, code string"))
    store = candidates.where("task_id = 't' and code = 'a'").limit(1).select("task_id", "code_sha256", F.lit("plus").alias("scope"), F.lit(True).alias("passed"))
    todo = graded.to_grade(candidates, store, ("plus",))
    assert sorted((r.task_id, r.scope) for r in todo.collect()) == [("t", "plus"), ("u", "plus")]
    whole = graded.merged(store, todo.withColumn("passed", F.lit(False)))
    got = {(r.task_id, r.candidate_index): r.p for r in graded.attached(candidates, whole, "plus", "p").collect()}
    assert got == {("t", 0): True, ("t", 1): False, ("t", 2): True, ("u", 0): False}
    with pytest.raises(Exception, match="no plus grade for task"):
        graded.attached(candidates, store, "plus", "p").collect()
    with pytest.raises(Exception, match="grades disagree"):
        graded.merged(store, store.withColumn("passed", F.lit(False))).collect()
    searched = candidates.withColumn("base_passed", F.lit(True))
    assert graded.replayed(candidates, searched).where("base_passed").count() == 4
    with pytest.raises(Exception, match="other code"):
        graded.replayed(candidates.withColumn("code_sha256", F.lit("x")), searched).collect()
    with pytest.raises(Exception, match="no candidate"):
        graded.replayed(candidates.withColumn("candidate_index", F.lit(9).cast("long")), searched).collect()


def test_a_portfolio_of_run_folders_in_one_scan(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"run{n:02d}").mkdir()
        rows = [{"task_id": "t", "policy_name": "p", "last_error": "e", "extra": n if n % 2 else str(n)}, {"task_id": "t", "policy_name": "p", "last_error": "e", "extra": "later"}, {"task_id": "u", "policy_name": "p"}]
        (tmp_path / f"run{n:02d}" / "failures.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    failures = studies.portfolio_failures(spark, f"file://{tmp_path}/run*", "failures.jsonl")
    got = sorted((r.run, r.line, r.task_id, r.last_error, r.record) for r in failures.select("run", "line", "task_id", "last_error", F.try_variant_get("record", "$.extra", "string").alias("record")).collect() if r.task_id == "t")
    assert got == [(f"run{n:02d}", 0, "t", "e", str(n)) for n in range(12)] and failures.count() == 24


def test_arms_without_exploration_compete_by_score(spark):
    from trialspark.operators import replay

    scored = spark.createDataFrame([("r", "new", 0, 0.2, 0.1), ("r", "old", 9, 0.0, 0.7)], "run string, operator string, n long, bonus double, score double")
    assert [replay.chosen_arms(scored, ["run"], "operator", w).first().operator for w in (1.0, 0.0)] == ["new", "old"]


def test_a_picture_takes_a_bounded_number_of_points(spark):
    curve = spark.range(5000).select(F.lit("p").alias("policy_name"), F.col("id").alias("budget"), (F.col("id") / 5000).alias("success_rate"))
    got = sorted((r.budget, r.success_rate) for r in studies.plotted_points(curve, 10).collect())
    assert [b for b, _ in got] == [0, 499, 999, 1499, 1999, 2499, 2999, 3499, 3999, 4499, 4999] and all(r == b / 5000 for b, r in got)
