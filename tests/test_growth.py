"""Steps that must not grow faster than their input: what is shuffled, joined, held by a task or computed again."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from trialspark import queries
from trialspark.functions import canonical, pycode, sha256
from trialspark.operators import bootstrap, clustering, integrity, metrics, selection, trajectory
from trialspark.sources import bundles, views


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grades_by_content_shuffle_lines_only(spark, sf):
    """Digests are made after lines are dealt by task, so that no digest is ever shuffled, and nothing is joined."""
    for name in ("graded_by_content", "contents_to_grade"):
        plan = plan_of(queries.QUERIES[name](spark, sf))
        assert "Join" not in plan, name
        assert set(re.findall(r"Exchange (\w+)\((\w+)", plan)) == {("hashpartitioning", "l_orderkey")}, name


def test_parts_of_a_bundle_are_bounded(spark, tmp_path, monkeypatch):
    """A task's rows are cut into parts, which stay in order beyond a thousand of them."""
    monkeypatch.setattr(bundles, "PART_RECORDS", 2)
    folder = f"file://{tmp_path}/bundle"
    bundles.publish(spark, folder, {"rows": (spark.range(2_103), ["id"])}, {}, files=1)
    sizes = [r.records for r in spark.read.schema(bundles.MANIFEST).json(f"{folder}/manifests/00000").collect()]
    assert max(sizes) == 2 and len(sizes) == 1_052
    assert all(r.id == r.line for r in bundles.read_ordered(spark, folder, "rows", "id long").collect())


def test_parts_of_a_group_are_bounded(monkeypatch):
    """Each part meets all values of its group, so their number must not grow with the group."""
    monkeypatch.setattr(bootstrap, "DRAWS", 1_000)
    parts = list(bootstrap.parts_of(1_000, 100, 7))
    assert len(parts) <= bootstrap.PARTS and sum(count for _, count, _, _ in parts) == 100


def test_words_of_a_large_group_are_jumped_to():
    """A part's state is made from the seed, not by making the words of all parts before it."""
    parts = list(bootstrap.spread_of(5_000, 400, 7, 100_000))
    assert 1 < len(parts) <= bootstrap.WORD_PARTS
    plain, numbers = bootstrap.Words.seeded(7), 0
    for place, state, words in parts:
        made = plain.run(words)
        assert (bootstrap.Words(state).run(100) == made[:100]).all(), place
        numbers += int((made < 5_000 << 19).sum())
    assert numbers >= 5_000 * 400


def test_intervals_read_their_rows_once(spark):
    """Groups, their places and all measures come from one list of values, shuffled once."""
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    rows = [(i, s, k, i % 3 == 0, float(i % 2)) for i in range(200) for s in ("a", "b") for k in (1, 2)]
    frame = spark.createDataFrame(rows, "task_id long, selector_name string, k long, selected_plus_passed boolean, selection_regret double")
    observed = frame.withColumn("selection_regret", F.udf(seen, "double")("selection_regret"))
    assert selection.summary_intervals(observed, 3, 50).count() == 4
    assert read.value == len(rows)


def test_cuts_of_ranges_are_looked_for_in_the_files(spark, sf):
    """What is asked of a task is asked of its lines, before they are dealt and numbered."""
    few = views.pool(spark, sf).where(F.pmod(F.xxhash64("task_id"), F.lit(50_000)) == 0).select("task_id")
    dealt = plan_of(few).split("Exchange")[1]
    assert "xxhash64" in dealt


def test_a_study_draws_its_differences_once(spark, sf):
    assert plan_of(queries.QUERIES["trajectory_study_comparisons"](spark, sf)).count("MapInArrow") == 3


def test_equal_texts_of_a_batch_are_parsed_once():
    seen = []
    assert pycode.once_each(lambda t, e: seen.append(t) or f"{t}{e}", [("a", None), ("b", "f"), ("a", None), ("a", "f")]) == ["aNone", "bf", "aNone", "af"]
    assert seen == ["a", "b", "a"]


def test_labels_meet_steps_where_their_tasks_are(spark, sf):
    """Steps and labels are dealt by task alone, to partitions that grow with the files, and are not dealt again by more keys."""
    for name in ("trajectory_observations", "trajectory_summary", "trajectory_comparison", "trajectory_ranking", "trajectory_summary_full"):
        plan = plan_of(queries.QUERIES[name](spark, sf))
        assert set(re.findall(r"Exchange hashpartitioning\((\w+?)(?:#\w+)?, ", plan)) <= {"l_orderkey", "pool_id"}, name
        assert "task_id" not in "".join(re.findall(r"Exchange hashpartitioning\(.*", plan)), name


def test_roots_are_compared_as_they_are(spark, sf):
    """No JSON is made to compare roots, and values are equal just where their JSON is."""
    plan = plan_of(queries.QUERIES["shared_root_differences"](spark, sf))
    assert "format_string" not in plan and "regexp" not in plan
    kind = "x double, f float, s string, m map<string,double>, a array<double>, t struct<d:double,e:int>"
    rows = [
        (0.0, 0.5, "null", {"a": 1.0, "b": -0.0}, [0.0, None], (0.0, 1)), (-0.0, 0.5, None, {"b": -0.0, "a": 1.0}, [0.0, None], (None, None)), (None, 0.1, "", {"a": 1.0, "b": 0.0}, [-0.0, None], None),
        (float("nan"), float("nan"), '"', {}, [], (-0.0, 1)), (1e16, -0.0, '\\"', None, None, (0.0, None)), (0.1 + 0.2, 0.0, "é", {"a": None}, [None], (0.3, 1)), (0.3, None, "é", {"é": 1.0}, [float("nan")], (0.30000000000000004, 1)),
    ]
    values = spark.createDataFrame(rows, kind)
    for f in values.schema:
        both = values.select(canonical.canonical_json(F.col(f.name), f.dataType).alias("j"), canonical.comparable(F.col(f.name), f.dataType).alias("v"))
        pairs = both.alias("p").crossJoin(both.alias("q")).select((F.col("p.j") == F.col("q.j")).alias("j"), F.col("p.v").eqNullSafe(F.col("q.v")).alias("v")).collect()
        assert len(pairs) == len(rows) ** 2 and all(r.j == r.v for r in pairs), f.name


def test_runs_of_a_scope_are_not_frames(spark, sf):
    """A scope is a row with an array; no frame is made of each scope and each of its tasks."""
    plan = plan_of(queries.QUERIES["policy_operator_bandit_per_run"](spark, sf))
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_a_pattern_of_equal_traces_is_clustered_once():
    clustering._consensus.cache_clear()
    assert clustering.consensus([("a", "x"), ("b", "x"), ("a", "x")]) == clustering.consensus([("q", 1), ("r", 1), ("q", 1)]) == (0, [[0, 2], [1]])
    assert clustering._consensus.cache_info().misses == 1


def test_orders_and_lines_are_dealt_alike_by_task(spark, sf):
    """Sides are grouped where their tasks are, in partitions that grow with the files; null tasks are equal to none."""
    for name in ("pool_completeness", "unknown_tasks"):
        plan = plan_of(queries.QUERIES[name](spark, sf))
        assert "Join" not in plan and set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"o_orderkey", "l_orderkey"}, name
    asked, known = (spark.createDataFrame([(x,) for x in ids], "task_id long") for ids in ([1, 1, 2, None], [2, 3, 3, None]))
    assert sorted(map(str, map(tuple, integrity.unknown_tasks(asked, known).collect()))) == ["(1, 'unknown')", "(3, 'not_asked')", "(None, 'not_asked')", "(None, 'unknown')"]
    have = spark.createDataFrame([(1, 0), (1, 0), (2, 5), (None, 0)], "task_id long, candidate_index long")
    got = {tuple(r) for r in integrity.incomplete_pool(have, asked, 1).collect()}
    assert got == {(1, 0, "duplicate"), (2, 0, "missing"), (2, 5, "unexpected"), (None, 0, "missing"), (None, 0, "unexpected")}


def test_a_digest_is_a_chain_of_bounded_tasks(spark, monkeypatch):
    """No task reads all roots: each link goes on from the state of the one before it, with the same digest."""
    data = [bytes([i]) * i * 37 for i in range(40)]
    digest = sha256.Sha256()
    for d in data:
        digest = sha256.Sha256(digest.state())
        digest.update(d)
        digest.hexdigest()
    assert digest.hexdigest() == hashlib.sha256(b"".join(data)).hexdigest()
    kept, whole = [], trajectory._links
    monkeypatch.setattr(trajectory, "_links", lambda *args: kept.append(whole(*args)) or kept[-1])
    monkeypatch.setattr(trajectory, "CHUNK", 300)
    monkeypatch.setattr(trajectory, "LINK", 2_000)
    own = spark.range(1_000).select(F.col("id").alias("task_id"), F.lit(0).cast("long").alias("root_index"), F.lit(0).alias("depth"), F.explode(F.array(F.lit("4x1"), F.lit("2x2"))).alias("pool_id"), (F.col("id") / 7).alias("x")).orderBy(F.rand(1))
    want = hashlib.sha256(json.dumps([{"task_id": i, "x": i / 7} for i in range(1_000)], sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = trajectory.root_digest(own, {"4x1": 4, "2x2": 2}, ("x",), parts=3).first()
    assert (got.compared_root_count, got.unique_root_count, got.canonical_sha256) == (1_000, 1_000, want)
    assert len(kept[0]) > 10 and all(sum(p.length for p in link) <= 2_400 for link in kept[0])
    none = trajectory.root_digest(own, {"8x1": 8, "4x2": 4}, ("x",)).first()
    assert (none.compared_root_count, none.unique_root_count, none.canonical_sha256) == (0, 0, hashlib.sha256(b"[]").hexdigest())
    monkeypatch.setattr(sha256, "library", lambda: None)  # without OpenSSL the whole list is one link
    assert trajectory.root_digest(own, {"4x1": 4, "2x2": 2}, ("x",), parts=3).first() == got and len(kept[-1]) == 1


def test_diagnostics_deal_rows_to_parts_that_grow(spark, sf):
    """Labels meet candidates by task alone, codes are grouped in as many parts as asked for, and figures are as plain ones."""
    plan = plan_of(queries.QUERIES["pool_diagnostics"](spark, sf))
    assert set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", plan))) == {"l_orderkey", "_code, _slice", "_code"} and "Expand" not in plan
    kind = "task_id long, candidate_index long, code string, output_tokens long, total_tokens long, base_passed boolean"
    rows = [(1, 0, "a", 5, 1, True), (1, 1, " ", 9, 2, None), (2, 0, "a", 9, 3, False), (2, 1, None, None, 4, True), (3, 0, "z", 1, 5, True), (None, 0, "y", 1, 6, True), (2, None, "x", 1, 7, True)]
    labels = [(1, 0, True), (1, 1, None), (2, 0, False), (2, 0, True), (2, 1, False), (4, 0, True), (None, 0, True)]
    pool, hidden = spark.createDataFrame(rows, kind), spark.createDataFrame(labels, "task_id long, candidate_index long, plus_passed boolean")
    got = metrics.pool_diagnostics(pool, hidden, 9, (2, 2), parts=7)
    assert "_code#" in plan_of(got) and ", 7)" in plan_of(got)
    assert tuple(got.first()) == (5, 2, 1, 0.25, 3, 0.75, 2, 0.5, 0.5, 13, None)
    assert tuple(metrics.pool_diagnostics(pool.where("task_id = 3"), hidden, 9).first()) == (0, 0, 0, 0.0, 0, 0.0, 0, 0.0, 0.0, None, None)
