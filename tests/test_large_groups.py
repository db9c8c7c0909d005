"""Ranges, medians, curves and seeded intervals of groups that no task may hold, against plain versions."""

import bisect
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark import queries
from trialspark.operators import bootstrap, curves, ranges, selection


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 50)


@pytest.fixture(scope="module")
def points(spark):
    """Two groups of which one is large, with one outlier far above all others."""
    rng = random.Random(4)
    rows = [("big", int(rng.expovariate(1) * 1000), rng.randint(0, 3)) for _ in range(3000)] + [("big", 10**12, 1)] + [("small", i, 1) for i in range(7)] + [(None, 5, 1), (None, 8, 2)]
    return rows, spark.createDataFrame(rows, "g string, v long, w long").repartition(5)


def test_ranges_follow_the_distribution(points, small):
    rows, df = points
    distinct = df.groupBy("g", "v").agg(F.sum("w").alias("w"))
    ranged = ranges.with_ranges(distinct, ["g"], "v")
    sizes = {(r.g, r[ranges.RANGE]): r.n for r in ranged.groupBy("g", ranges.RANGE).agg(F.count("*").alias("n")).collect()}
    assert sizes["small", 0] == 7 and len([k for k in sizes if k[0] == "big"]) > 20 and max(sizes.values()) < 600
    got = {(r.g, r.v): r.until for r in ranges.running_sums(ranged, ["g"], "v", {"until": "w"}).collect()}
    want, total = {}, Counter()
    for g, v in sorted({r[:2] for r in rows}, key=lambda r: (r[0] or "", r[1])):
        total[g] += sum(w for a, b, w in rows if (a, b) == (g, v))
        want[g, v] = total[g]
    assert got == want
    after = {(r.g, r.v): r["_next"] for r in ranges.with_next(ranged, ["g"], "v", ["v"]).collect()}
    for g in ("big", "small", None):
        own = sorted({b for a, b, _ in rows if a == g})
        assert all(after[g, v].v == n for v, n in zip(own, own[1:], strict=False)) and (after[g, own[-1]] is None or after[g, own[-1]].v is None)


def test_places_and_medians(spark, points, small):
    rows, df = points
    got = defaultdict(list)
    for r in ranges.numbered(df, ["g"], "v", "at").collect():
        got[r.g].append((r.at, r.v))
    for g, own in got.items():
        assert [v for _, v in sorted(own)] == sorted(v for a, v, _ in rows if a == g) and [p for p, _ in sorted(own)] == list(range(len(own)))
    found = {r.g: (r.v, r.odd) for r in ranges.medians(df, ["g"], {"v": F.col("v"), "odd": F.when(F.col("w") > 3, F.col("v"))}).collect()}
    assert found == {g: (statistics.median(v for a, v, _ in rows if a == g), None) for g in ("big", "small", None)}


def test_a_curve_with_an_outlier(spark, small):
    rng = random.Random(2)
    costs = [rng.randint(1, 4000) for _ in range(1500)] + [10**12]
    results = spark.createDataFrame([("p", c, c % 3 != 0) for c in costs], "policy_name string, cost long, ok boolean")
    grid = results.select(F.lit("p").alias("policy_name"), F.col("cost").alias("budget")).distinct()
    curve = curves.ranged_curve(results, grid, ["policy_name"], ["policy_name"], F.col("ok"), F.col("cost"))
    paid = sorted(c for c in costs if c % 3)
    want = [(b, bisect.bisect_right(paid, b) / len(costs)) for b in sorted(set(costs))]
    assert sorted((r.budget, r.success_rate) for r in curve.collect()) == want
    auc = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(want, want[1:], strict=False))
    assert curves.area(curve, ["policy_name"]).first().auc == pytest.approx(auc)
    assert curves.area(curve.drop(ranges.RANGE), ["policy_name"]).first().auc == pytest.approx(auc)


def test_scores_of_grouping_sets(spark):
    attempts = spark.createDataFrame([(b, p, c, None) for b in ("x", "y") for p in ("d", "e") for c in (1, 4, 9)], "budget_name string, policy_name string, cumulative_tokens long, hidden_passed boolean")
    rows = [("x", "d", True, 4), ("x", "d", False, None), ("x", "e", True, 9), ("y", "d", True, 1), ("y", "e", False, None)]
    results = spark.createDataFrame([(b, p, s, False, False, c) for b, p, s, c in rows], "budget_name string, policy_name string, success boolean, hidden_success boolean, oracle_hidden_success boolean, decision_tokens long")
    got = {(r.grouping, r.budget_name, r.policy_name): r for r in curves.scores(results, attempts, [["budget_name"], []], ("token",)).collect()}
    assert set(got) == {(0, "x", "d"), (0, "x", "e"), (0, "y", "d"), (0, "y", "e"), (1, None, "d"), (1, None, "e")}
    one = got[0, "x", "d"]
    assert (one.metric_scope, one.number_of_results, one.solve_rate, one.median_tokens_to_solution) == ("public", 2, 0.5, 4.0) and one.token_auc == pytest.approx(3 * 0.25 + 5 * 0.5)
    both = got[1, None, "d"]
    assert (both.number_of_results, both.solved_count, both.median_tokens_to_public_solution, both.median_tokens_to_hidden_solution) == (3, 2, 2.5, None)
    assert both.token_auc == pytest.approx(1 / 6 + 3 * 0.5 + 5 * 2 / 3)


def plain(values, resamples, seed):
    draws = random.Random(seed)
    means = sorted(sum(values[draws.randrange(len(values))] for _ in values) / len(values) for _ in range(resamples))
    return means[int(0.025 * (resamples - 1))], means[int(0.975 * (resamples - 1))]


@pytest.mark.parametrize(("draws", "values"), [(2**27, 2**20), (4_000, 2**20), (4_000, 300)])
def test_intervals_in_parts_and_blocks_are_the_plain_loop(spark, monkeypatch, draws, values):
    monkeypatch.setattr(bootstrap, "DRAWS", draws)
    monkeypatch.setattr(bootstrap, "VALUES", values)
    monkeypatch.setattr(bootstrap, "WORDS", 1_500)
    rng = random.Random(1)
    groups = {("a", 1): [float(rng.random() < 0.4) for _ in range(2000)], ("b", None): [rng.randint(-4, 4) / 4 for _ in range(77)], ("c", 2): [0.5]}
    rows = [(*g, i, v) for g, own in groups.items() for i, v in enumerate(own)] + [("c", 2, 9, None)]
    df = spark.createDataFrame(rows, "g string, h long, p long, v double").orderBy(F.rand(3))
    got = {(r.g, r.h): (r.ci_low, r.ci_high) for r in bootstrap.exact_intervals(df, ["g", "h"], "v", "p", F.length("g") + 6, 60).collect()}
    assert got == {g: pytest.approx(plain(own, 60, 7)) for g, own in groups.items()}


@pytest.mark.parametrize("values", [2**20, 400])
def test_large_groups_are_cut_at_words(spark, monkeypatch, values):
    """Parts end anywhere in a resample, whatever the values; a group of one whole value draws nothing."""
    monkeypatch.setattr(bootstrap, "DRAWS", 10_000)
    monkeypatch.setattr(bootstrap, "VALUES", values)
    monkeypatch.setattr(bootstrap, "WORDS", 1_500)
    monkeypatch.setattr(ranges, "ROWS", 100)
    rng = random.Random(4)
    groups = {"quarters": [rng.randint(-4, 4) / 4 for _ in range(1_700)], "three": [float(rng.randint(-1, 1)) for _ in range(2_048)], "two": [rng.choice((-2.0, 5.0)) for _ in range(1_600)]}
    groups |= {"whole": [3.0] * 1_900, "half": [0.5] * 1_600, "none": [None] * 1_600}
    rows = [(g, i, v) for g, own in groups.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "g string, p long, v double").orderBy(F.rand(3))
    got = {r.g: (r.ci_low, r.ci_high) for r in bootstrap.exact_intervals(df, ["g"], "v", "p", F.length("g"), 60).collect()}
    assert got == {g: pytest.approx(plain(own, 60, len(g))) for g, own in groups.items() if g != "none"}


def test_candidates_as_bits_or_as_a_map(spark):
    rng = random.Random(2)
    pool = spark.createDataFrame([(t, i, rng.choice((True, False, None))) for t in range(40) for i in range(4)], "task_id long, candidate_index long, base_passed boolean")
    labels = spark.createDataFrame([(t, i, rng.choice((True, False, None))) for t in range(40) for i in range(4)], "task_id long, candidate_index long, plus_passed boolean")
    bits = selection.observations(pool, labels, [1, 4]).collect()
    maps = selection.observations(pool, labels, [1, 4, 70], pool_size=70).where("k < 70").collect()
    assert len(bits) == 160 and sorted(map(str, bits)) == sorted(map(str, maps))
    with pytest.raises(Exception, match="two candidates of one index"):
        selection.observations(pool.union(pool.limit(1)), labels, [1, 4]).collect()


def test_a_million_values(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "DRAWS", 2**21)
    monkeypatch.setattr(bootstrap, "VALUES", 2**18)
    n, resamples = 1_000_000, 6
    df = spark.range(n).select(F.lit(0).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(7)) == 0).cast("double").alias("v"))
    values = np.array([r.v for r in df.orderBy("id").collect()])
    words, sums = bootstrap.Words.seeded(3), []
    drawn = np.concatenate(list(words.draws(n, n * resamples)))
    sums = np.sort(values[drawn].reshape(resamples, n).sum(axis=1)) / n
    got = bootstrap.exact_intervals(df, ["g"], "v", "id", F.lit(3), resamples).first()
    assert (got.ci_low, got.ci_high) == (sums[0], sums[4])


def test_words_are_the_standard_generator():
    for n in (1, 2, 3, 64, 1000, 2**31 + 5):
        draws = random.Random(5)
        want = [draws.randrange(n) for _ in range(50)]
        assert np.concatenate(list(bootstrap.Words.seeded(5).draws(n, 50))).tolist() == want
        assert np.concatenate(list(bootstrap.Words.seeded(5).draws(n, 30, 20))).tolist() == want[20:]


def test_building_a_query_starts_no_job(spark, sf):
    """Queries are plans until they are read; only the schemas of the tables are looked at."""
    tracker = spark.sparkContext.statusTracker()
    for name in ("exact_intervals_by_size", "policy_scores", "decision_verdict", "experiment_summary_full", "selection_intervals_exact", "trajectory_study_policies"):
        before = {len(tracker.getJobIdsForGroup(None) or [])}
        spark.sparkContext.setJobGroup(f"building {name}", name)
        queries.QUERIES[name](spark, sf)
        jobs = tracker.getJobIdsForGroup(f"building {name}")
        stages = [s for j in jobs for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
        assert all("parquet" in tracker.getStageInfo(s).name for s in stages if tracker.getStageInfo(s)) and before, name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_wall_follows_attributes(spark):
    from trialspark.plans.hidden import HiddenLabelError, carried_names, public_only

    local = spark.sql("select task_id, plus_passed as base_passed from values (1, true), (2, false) as t(task_id, plus_passed)")
    with pytest.raises(HiddenLabelError, match="plus_passed"):
        public_only(local)
    table = spark.createDataFrame([(1, True, False, 3)], "task_id long, base_passed boolean, plus_passed boolean, surplus long")
    assert public_only(table.select("task_id", "base_passed", "surplus")).columns == ["task_id", "base_passed", "surplus"]
    unused = table.withColumn("plus_rank", F.col("plus_passed").cast("int") + 1).drop("plus_rank", "plus_passed")
    assert "plus_passed" not in carried_names(unused) and public_only(unused).count() == 1
    grouped = table.groupBy("task_id").agg(F.max("plus_passed").alias("best"), F.max("base_passed").alias("base"))
    assert public_only(grouped.select("task_id", "base")).count() == 1
    table.createOrReplaceTempView("wall_table")
    leaks = {
        "renamed": table.select("task_id", F.col("plus_passed").alias("ok")),
        "filtered": table.where("plus_passed").select("task_id"),
        "aggregated": grouped.select("task_id", "best"),
        "joined": table.select("task_id").join(table.where("not plus_passed").select(F.col("task_id").alias("t")), F.col("task_id") == F.col("t")).select("task_id"),
        "sorted": table.orderBy("plus_passed").select("task_id"),
        "united": table.select("task_id", "base_passed").union(table.select("task_id", "plus_passed")),
        "ranked": spark.sql("select task_id, row_number() over (order by plus_passed) as r from wall_table"),
        "subquery": spark.sql("select task_id, (select max(plus_passed) from wall_table) as m from wall_table"),
        "exists": spark.sql("select task_id from wall_table a where exists (select 1 from wall_table b where a.task_id = b.task_id and b.plus_passed)"),
        "cte": spark.sql("with c as (select task_id, plus_passed as x from wall_table) select task_id, x from c"),
        "exploded": table.select("task_id", F.explode(F.array("plus_passed")).alias("x")),
        "cached": table.select("task_id", F.col("plus_passed").alias("y")).cache(),
    }
    for name, df in leaks.items():
        with pytest.raises(HiddenLabelError):
            public_only(df)
            pytest.fail(name)
