"""The registered queries over the given tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.functions import pycode, scalars
from trialspark.operators import bootstrap, clustering, curves, graded, integrity, metrics, policies, replay, selection, summaries, tasks, trajectory
from trialspark.plans import studies
from trialspark.sources import bundles, records, views
from trialspark.sources.shared import new_path
from trialspark.sources.views import ATTEMPTS_SQL, CAND_SQL, KS, POOL_SIZE, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CAND, ATT = f"with {CAND_SQL}", f"with {ATTEMPTS_SQL}"
RESULT_KEYS = ["task_id", "policy_name", "budget_name"]
#: Resamples of seeded intervals over all tasks.
STUDY_RESAMPLES = 2_000


def query(sql: str | None = None):
    """Register the function below by its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Selection ---------------------------------------------------------------------------------------------------------

_MISSED = "list_product(list_transform(range(cast(0 as bigint), cast(k as bigint)), lambda i: cast(n - c - i as double) / cast(n - i as double)))"
PASS_K = f"case when c = 0 then cast(0 as double) when n - c < k then cast(1 as double) else cast(1 as double) - {_MISSED} end"
OBS = f"""{CAND},
ks as (select cast(unnest([1, 2, 4]) as bigint) as k),
pre as (select task_id, k, coalesce(min(case when base_passed then candidate_index end), 0) as first_pass, bool_or(plus_passed) as ok from pool join ks on candidate_index < k group by task_id, k),
tot as (select task_id, count(*) as n, count(*) filter (plus_passed) as c from pool group by task_id),
sel as (select task_id, k, ok, 'first_base_pass' as selector_name, first_pass as s from pre union all select task_id, k, ok, 'first_sample', 0 from pre),
obs as (select sel.task_id, selector_name, k, s as selected_index, base_passed as selected_base_passed, plus_passed as selected_plus_passed, c as correct_in_pool, ok as prefix_has_correct,
    {PASS_K} as pass_at_k, cast(ok as integer) - cast(plus_passed as integer) + cast(0 as double) as selection_regret
  from sel join pool on sel.task_id = pool.task_id and s = candidate_index join tot on sel.task_id = tot.task_id)"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.observations(views.pool(spark, sf_dir), views.pool_hidden(spark, sf_dir), list(KS), pool_size=POOL_SIZE)


@query(f"{OBS} select * from obs")
def selection_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir)


@query(f"""{OBS} select selector_name, k, count(*) as task_count, avg(cast(selected_base_passed as integer)) as base_rate, avg(cast(selected_plus_passed as integer)) as plus_rate,
  avg(case when selected_base_passed then 1 - cast(selected_plus_passed as integer) end) as false_accept_rate, avg(cast(prefix_has_correct as integer)) as prefix_rate, avg(pass_at_k) as mean_pass_at_k, avg(selection_regret) as mean_regret
  from obs group by all""")
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.summaries(_observed(spark, sf_dir))


@query(f"""{OBS}, d as (select k, task_id, max(case when selector_name = 'first_base_pass' then cast(selected_plus_passed as integer) end) - max(case when selector_name = 'first_sample' then cast(selected_plus_passed as integer) end) as d from obs group by all)
select k, 'first_base_pass' as challenger, 'first_sample' as baseline, count(*) as task_count, avg(d) as mean_difference, count(*) filter (d > 0) as wins, count(*) filter (d < 0) as losses, count(*) filter (d = 0) as ties from d group by k""")
def selection_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.comparisons(_observed(spark, sf_dir), "first_base_pass", "first_sample")


@query(f"""{OBS}, one as (select task_id, k, max(pass_at_k) as p from obs group by all)
select a.k, b.k as reference_k, count(*) as task_count, avg(a.p - b.p) as mean_gain from one a join one b on a.task_id = b.task_id and b.k = 1 and a.k > 1 group by all""")
def coverage_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.coverage_gains(_observed(spark, sf_dir))


STOP = f"""{CAND}, f as (select task_id, min(case when base_passed then candidate_index end) as p from pool group by task_id),
stop as (select pool.task_id, coalesce(p + 1, 4) as used, sum(total_tokens) filter (candidate_index < coalesce(p + 1, 4)) as used_tokens, sum(total_tokens) as full_tokens from pool join f on pool.task_id = f.task_id group by pool.task_id, p)"""


@query(f"""{STOP} select cast(4 as bigint) as k, count(*) as task_count, cast(sum(used) as bigint) as used_calls, count(*) * 4 as full_calls, 1 - sum(used) / (count(*) * 4) as call_savings,
  cast(sum(used_tokens) as bigint) as used_tokens, cast(sum(full_tokens) as bigint) as full_tokens, 1 - sum(used_tokens) / sum(full_tokens) as token_savings, avg(used) as mean_calls, median(used) as median_calls from stop""")
def stopping_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stopping_efficiency(selection.stopping(views.pool(spark, sf_dir), POOL_SIZE), POOL_SIZE)


@query(f"{STOP} select cast(used as varchar) as calls, count(*) as tasks from stop group by used")
def stop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stop_counts(selection.stopping(views.pool(spark, sf_dir), POOL_SIZE))


@query(f"""{CAND}, g as (select task_id, count(*) as n, count(*) filter (plus_passed) as c from cand group by task_id), e as (select task_id, n, c, unnest([1, 2, 4]) as k from g)
select task_id, n, c, cast(k as bigint) as k, case when k <= n then {PASS_K} end as pass_at_k from e""")
def pass_at_k_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = views.candidates(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("plus_passed").alias("c"))
    each = by.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in KS])))
    return each.withColumn("pass_at_k", F.when(F.col("k") <= F.col("n"), scalars.pass_at_k(F.col("n"), F.col("c"), F.col("k"))))


@query()
def selection_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each selector and k with intervals drawn as binomial sums."""
    observed = _observed(spark, sf_dir).withColumn("plus", scalars.as_rate(F.col("selected_plus_passed")))
    return selection.summaries(observed).join(bootstrap.binomial_intervals(observed, ["selector_name", "k"], "plus"), ["selector_name", "k"])


@query()
def exact_intervals_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded intervals of the regret, an interval for each shard of 100 tasks and selector, at the largest k."""
    observed = _observed(spark, sf_dir).where(F.col("k") == max(KS))
    sharded = observed.join(clustering.task_shards(observed, 100), "task_id")
    return bootstrap.exact_intervals(sharded, ["selector_name", "shard"], "selection_regret", "task_id", F.col("shard"))


@query()
def selection_intervals_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of each selector and k with the seeded intervals of plus rate and regret, over all tasks."""
    observed = _observed(spark, sf_dir)
    return selection.summaries(observed).join(selection.summary_intervals(observed, seed=7, resamples=STUDY_RESAMPLES), ["selector_name", "k"])


@query()
def selection_comparisons_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of selectors with the seeded intervals of their differences."""
    return selection.all_comparisons(_observed(spark, sf_dir), selection.default_pairs(["first_sample", "first_base_pass"]), seed=7, resamples=STUDY_RESAMPLES)


@query()
def coverage_gains_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage gains with their seeded intervals."""
    observed = _observed(spark, sf_dir)
    return selection.coverage_gains(observed).join(selection.coverage_intervals(observed, seed=7, resamples=STUDY_RESAMPLES), ["k", "reference_k"])


_HEAD = "cast('0x' || substr(md5({0}), 1, 8) as bigint)"


@query(f"""with b as (select event_type, {_HEAD.format("cast(event_id as varchar)")} % 256 as block, cast(sum(cast(floor(value) as bigint)) as bigint) as s, count(*) as c from events where value is not null group by all),
g as (select event_type, list(s order by block) as ss, list(c order by block) as cs from b group by event_type),
e as (select event_type, ss, cs, unnest(range(0, 1000)) as rep from g),
d as (select event_type, list_transform(range(0, len(ss)), lambda i: {_HEAD.format("'0:' || rep || ':' || i")} % len(ss) + 1) as picks, ss, cs from e),
m as (select event_type, cast(list_sum(list_transform(picks, lambda i: ss[i])) as double) / list_sum(list_transform(picks, lambda i: cs[i])) as mean from d),
r as (select *, row_number() over (partition by event_type order by mean) - 1 as place from m)
select event_type, max(mean) filter (place = 24) as ci_low, max(mean) filter (place = 974) as ci_high from r group by event_type""")
def hashed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the mean value of each type's events, the draws by hash."""
    events = table(spark, sf_dir, "events").withColumn("whole", F.floor("value").cast("long"))
    return bootstrap.hashed_intervals(events, ["event_type"], "whole", "event_id", 1000)


# Metrics ------------------------------------------------------------------------------------------------------------

RATES = "avg(cast(success as integer)) as solve_rate, avg(cast(hidden_success as integer)) as hidden_solve_rate, avg(cast(oracle_hidden_success as integer)) as oracle_hidden_solve_rate, avg(cast(success as integer)) - avg(cast(hidden_success as integer)) as public_hidden_gap, avg(cast(success and not hidden_success as integer)) as overfit_rate"
COSTS = """median(decision_tokens) filter (success) as median_tokens_to_solution, median(decision_verifier_calls) filter (success) as median_calls_to_solution, median(decision_tokens) filter (hidden_success) as median_tokens_to_hidden_solution,
  median(decision_verifier_calls) filter (hidden_success) as median_calls_to_hidden_solution, median(oracle_hidden_tokens) as median_tokens_to_oracle_hidden, median(oracle_hidden_calls) as median_calls_to_oracle_hidden,
  median(decision_ms) filter (success) / 1000 as median_seconds_to_solution, median(decision_ms) filter (hidden_success) / 1000 as median_seconds_to_hidden_solution, median(oracle_hidden_ms) / 1000 as median_seconds_to_oracle_hidden"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.attempts(spark, sf_dir)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.results(views.attempts(spark, sf_dir))


@query(f"{ATT} select * from results")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


@query(f"{ATT} select policy_name, budget_name, count(*) as n_results, {RATES} from results group by all")
def solve_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.solve_rates(_results(spark, sf_dir), ["policy_name", "budget_name"])


@query(f"{ATT} select policy_name, budget_name, {COSTS} from results group by all")
def solution_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.solution_costs(_results(spark, sf_dir), ["policy_name", "budget_name"])


@query(f"""{ATT} select policy_name, budget_name, count(*) as n_results, count(distinct task_id) as n_tasks, cast(1 as bigint) as n_seeds, {RATES}, {COSTS},
  cast(sum(total_tokens) as bigint) as sum_tokens, avg(total_tokens) as mean_tokens, cast(sum(total_verifier_calls) as bigint) as sum_verifier_calls, avg(total_verifier_calls) as mean_verifier_calls,
  cast(sum(total_ms) as double) / 1000 as sum_seconds, avg(total_ms) / 1000 as mean_seconds from results group by all""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.experiment_summary(_results(spark, sf_dir), ["policy_name", "budget_name"])


@query(f"""{ATT}, e as (select policy_name, unnest([1, 2, 4]) as k, total_verifier_calls as n, hidden_correct as c from results where budget_name = 'tight')
select policy_name, cast(k as bigint) as k, count(*) filter (n >= k) as eligible, avg({PASS_K}) filter (n >= k) as mean_pass_at_k from e group by all""")
def fixed_sample_pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    tight = _results(spark, sf_dir).where("budget_name = 'tight'").withColumn("fixed_sample", F.lit(True)).withColumn("truncated", F.lit(False)).withColumn("graded", F.col("total_verifier_calls"))
    return metrics.fixed_sample_pass_at_k(tight, list(KS), ["policy_name"])


@query(f"""{CAND} select count(*) as n_candidates, count(distinct task_id) as n_tasks, count(*) filter (trim(code) = '') as empty_code, avg(cast(trim(code) = '' as integer)) as empty_code_rate, count(*) filter (output_tokens >= 250) as at_cap,
  avg(cast(output_tokens >= 250 as integer)) as at_cap_rate, count(distinct sha256(code)) as unique_codes, avg(cast(base_passed as integer)) as base_rate, avg(cast(plus_passed as integer)) as plus_rate, cast(sum(total_tokens) as bigint) as sum_tokens, cast(null as boolean) as pilot_gate from pool""")
def pool_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.parts_of(table(spark, sf_dir, "lineitem"))
    return metrics.pool_diagnostics(views.pool(spark, sf_dir), views.pool_hidden(spark, sf_dir), 250, parts=parts)


STATS = f"""{ATT}, s as (select policy_name as operator, verification_passed as success, total_tokens, case when verification_passed then null when event_id % 2 = 0 then 'wrong_answer' else 'timeout' end as error_type, event_id from attempts where budget_name = 'full'),
st as (select operator, count(*) as n, count(*) filter (success) as successes, cast(sum(total_tokens) as bigint) as total_cost, avg(cast(success as integer)) as mean_success, avg(total_tokens) as mean_cost, arg_max_null(error_type, event_id) as last_error_type from s group by operator)"""


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _attempts(spark, sf_dir).where("budget_name = 'full'")
    error = F.when(~F.col("verification_passed"), F.when(F.col("event_id") % 2 == 0, "wrong_answer").otherwise("timeout"))
    ready = full.select(F.col("policy_name").alias("operator"), F.col("verification_passed").alias("success"), "total_tokens", error.alias("error_type"), F.col("event_id").alias("position"))
    return metrics.operator_statistics(ready, "operator", "total_tokens")


@query(f"{STATS} select * from st")
def operator_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir)


UCB = f"""{STATS}, m as (select *, case operator when 'view' then 'direct_sample' when 'click' then 'repair_from_error' when 'signup' then 'plan_then_code' else operator end as arm, 'wrong_answer' as last_error from st),
u as (select arm as operator, n, mean_success, mean_cost, last_error, cast(sum(n) over () + 1 as bigint) as step, case arm when 'repair_from_error' then cast(0.15 as double) when 'plan_then_code' then cast(0.10 as double) else cast(0 as double) end as bonus from m),
scored as (select *, mean_success / greatest(1 + cast(0.1 as double) * ln(1 + greatest(mean_cost, 0)), cast(0.000001 as double)) + sqrt(ln(step + 1) / (1 + n)) + bonus as score from u)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = F.col("operator")
    for event, name in (("view", "direct_sample"), ("click", "repair_from_error"), ("signup", "plan_then_code")):
        arm = F.when(F.col("operator") == event, name).otherwise(arm)
    stats = _statistics(spark, sf_dir).withColumn("operator", arm).select("operator", "n", "mean_success", "mean_cost", F.lit("wrong_answer").alias("last_error"), F.lit(1).alias("run"))
    return replay.ucb_scores(stats, ["run"], 1.0, 0.1, 1e-6)


@query(f"{UCB} select operator, n, mean_success, mean_cost, last_error, step, round(bonus, 9) as bonus, round(score, 9) as score from scored")
def ucb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).drop("run").withColumns({c: F.round(c, 9) for c in ("bonus", "score")})


@query(f"{UCB} select operator, round(score, 9) as score from scored order by score desc, operator limit 1")
def ucb_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.chosen_arms(_scored(spark, sf_dir), ["run"], "operator").select("operator", F.round("score", 9).alias("score"))


@query(f"{ATT} select task_id, policy_name, budget_name, coalesce(arg_min('model-' || (event_id % 3), attempt_index) filter (event_id % 4 <> 0), 'default') as model from attempts group by all")
def result_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _attempts(spark, sf_dir).withColumn("model_id", F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("model-"), (F.col("event_id") % 3).cast("string"))))
    return metrics.result_model(named, "default")


@query(f"""{ATT}, f as (select task_id, policy_name, budget_name from results where not success order by all limit 3)
select f.task_id, f.policy_name, f.budget_name, arg_max('event ' || event_id, attempt_index) as last_error, max(attempt_index) as last_index from f join attempts a on f.task_id = a.task_id and f.policy_name = a.policy_name and f.budget_name = a.budget_name group by all""")
def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _attempts(spark, sf_dir).withColumn("error_type", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    return metrics.failure_examples(views.results(named), named, RESULT_KEYS)


@query("select l_quantity as quantity, round(1 - power(1 - cast(0.1 as double), l_quantity), 12) as p, count(*) as n from lineitem group by all")
def best_of_n_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("quantity")).agg(F.count("*").alias("n"))
    return by.withColumn("p", F.round(scalars.best_of_n_probability(F.lit(0.1), F.col("quantity")), 12))


@query(f"""{ATT}, m as (select task_id, policy_name, budget_name, coalesce(arg_min('model-' || (event_id % 3), attempt_index) filter (event_id % 4 <> 0), 'default') as model from attempts group by all)
select policy_name, model, count(*) as number_of_tasks, count(*) filter (success) as solved_count, avg(cast(success as integer)) as solve_rate, median(decision_tokens) filter (success) as median_tokens_to_solution,
  median(decision_verifier_calls) filter (success) as median_calls_to_solution, cast(sum(total_verifier_calls) as bigint) as total_attempts, cast(sum(total_tokens) as bigint) as sum_tokens
from results join m using (task_id, policy_name, budget_name) group by all""")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.model_summary(_results(spark, sf_dir), result_models(spark, sf_dir))


@query(f"""{CAND}, bn as (select *, coalesce(max(cast(base_passed as integer)) over (partition by task_id order by candidate_index rows between unbounded preceding and 1 preceding), 0) as before from pool)
select task_id, candidate_index, base_passed as selected, base_passed and plus_passed as hidden_passed from bn where before = 0""")
def graded_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of a replayed search, with hidden grades attached after every choice."""
    made = replay.best_of_n(views.pool(spark, sf_dir), POOL_SIZE)
    return metrics.graded_attempts(made, views.pool_hidden(spark, sf_dir)).select("task_id", "candidate_index", "selected", "hidden_passed")


_CONTENT = f"""{CAND}, c as (select task_id, candidate_index, sha256(code) as code_sha256, base_passed, plus_passed from cand),
g as (select task_id, code_sha256, unnest(['base', 'plus']) as scope, bool_and(base_passed) as b, bool_and(plus_passed) as p from c group by task_id, code_sha256)"""


def _contents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, grades of all their contents, the grades of an earlier run, which saw each task's first two candidates)."""
    own = graded.with_digest(views.candidates(spark, sf_dir))
    scopes = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(c).alias("passed")) for s, c in (("base", "base_passed"), ("plus", "plus_passed"))]))
    contents = own.groupBy("task_id", "code_sha256").agg(F.bool_and("base_passed").alias("base_passed"), F.bool_and("plus_passed").alias("plus_passed"), F.bool_or(F.col("candidate_index") < 2).alias("seen"))
    each = lambda df: df.select("task_id", "code_sha256", scopes.alias("g")).select("task_id", "code_sha256", "g.*")
    return own, each(contents), each(contents.where("seen"))


@query(f"""{_CONTENT} select task_id, code_sha256, scope from g where (task_id, code_sha256) not in (select (task_id, code_sha256) from c where candidate_index < 2)""")
def contents_to_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run must grade: contents that no earlier candidate had."""
    own, _, store = _contents(spark, sf_dir)
    return graded.to_grade(own, store, ("base", "plus"))


@query(f"""{_CONTENT} select c.task_id, candidate_index, b as base_passed, p as plus_passed from c join g on c.task_id = g.task_id and c.code_sha256 = g.code_sha256 and scope = 'base'""")
def graded_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its content's grades, from the earlier store merged with the grades of what it lacked."""
    own, grades, store = _contents(spark, sf_dir)
    todo = graded.to_grade(own, store, ("base", "plus"))
    whole = graded.merged(store, graded.of_contents(grades, todo))
    plain = own.select("task_id", "candidate_index", "code_sha256")
    return graded.all_attached(plain, whole, {"base": "base_passed", "plus": "plus_passed"}).drop("code_sha256")


# Curves and decisions -----------------------------------------------------------------------------------------------


def _curve_sql(cost: str, cumulative: str, solved: str) -> str:
    return f"""{ATT}, grid as (select distinct budget_name, {cumulative} as budget from attempts union select distinct budget_name, 0 from attempts),
tot as (select budget_name, policy_name, count(*) as n from results group by all),
paid as (select budget_name, policy_name, {cost} as budget, count(*) as c from results where {solved} group by all),
pts as (select tot.budget_name, policy_name, grid.budget, 0 as c, 1 as g from tot join grid on tot.budget_name = grid.budget_name union all select budget_name, policy_name, budget, c, 0 from paid),
run as (select budget_name, policy_name, budget, max(g) as g, sum(sum(c)) over (partition by budget_name, policy_name order by budget) as reached from pts group by budget_name, policy_name, budget),
curve as (select run.budget_name, run.policy_name, budget, reached / n as success_rate from run join tot on run.budget_name = tot.budget_name and run.policy_name = tot.policy_name where g = 1)"""


def _curve(spark: SparkSession, sf_dir: str, cost: str, cumulative: str, solved: str) -> DataFrame:
    attempted = _attempts(spark, sf_dir)
    grid = curves.budget_grid(attempted, ["budget_name"], cumulative)
    return curves.success_curve(views.results(attempted), grid, ["budget_name", "policy_name"], ["budget_name"], F.col(solved), F.col(cost))


@query(_curve_sql("decision_tokens", "cumulative_tokens", "success") + " select * from curve")
def success_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir, "decision_tokens", "cumulative_tokens", "success")


@query(_curve_sql("decision_tokens", "cumulative_tokens", "hidden_success") + " select * from curve")
def hidden_success_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir, "decision_tokens", "cumulative_tokens", "hidden_success")


@query(_curve_sql("decision_verifier_calls", "cumulative_verifier_calls", "success") + " select * from curve")
def success_by_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir, "decision_verifier_calls", "cumulative_verifier_calls", "success")


@query(_curve_sql("decision_ms", "cumulative_ms", "success") + " select * from curve")
def success_by_milliseconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir, "decision_ms", "cumulative_ms", "success")


AREA = "a as (select *, lead(budget) over w - budget as dx, (lead(success_rate) over w + success_rate) / 2 as y from curve window w as (partition by budget_name, policy_name order by budget)), auc as (select budget_name, policy_name, coalesce(sum(dx * y), 0) as auc from a group by all)"


@query(_curve_sql("decision_tokens", "cumulative_tokens", "success") + f", {AREA} select budget_name, policy_name, round(auc, 6) as auc from auc")
def token_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.area(success_by_tokens(spark, sf_dir), ["budget_name", "policy_name"]).withColumn("auc", F.round("auc", 6))


SCORES = _curve_sql("decision_tokens", "cumulative_tokens", "hidden_success") + f""", {AREA},
scores as (select tot.budget_name, tot.policy_name, tot.n, r as solve_rate, auc as token_auc from tot join auc on tot.budget_name = auc.budget_name and tot.policy_name = auc.policy_name
  join (select budget_name, policy_name, avg(cast(hidden_success as integer)) as r from results group by all) x on tot.budget_name = x.budget_name and tot.policy_name = x.policy_name),
best as (select * from scores where policy_name <> 'purchase' qualify row_number() over (partition by budget_name order by solve_rate desc, token_auc desc, list_position(['view', 'click', 'signup', 'error'], policy_name)) = 1),
cmp as (select d.budget_name, d.solve_rate as decision_rate, d.token_auc as decision_auc, b.policy_name as baseline, b.solve_rate as baseline_rate, b.token_auc as baseline_auc from scores d left join best b on d.budget_name = b.budget_name where d.policy_name = 'purchase'),
rel as (select *, decision_rate = 0 and baseline_rate = 0 as z, decision_rate > 0 and decision_rate >= baseline_rate and decision_auc >= baseline_auc as ahead, decision_rate > baseline_rate or decision_auc > baseline_auc as strict from cmp)"""
_STATUS = "case when z then 'inconclusive' when ahead and strict then 'promising' when ahead then 'matches_baseline' else 'needs_analysis' end as status, case when z then 'inconclusive' when ahead and strict then 'win' when ahead then 'tie' else 'loss' end as relationship"


def _scores(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("token",)) -> DataFrame:
    attempted = _attempts(spark, sf_dir)
    return curves.policy_scores(views.results(attempted), attempted, ["budget_name"], kinds=kinds)


@query(f"{SCORES} select budget_name, policy_name, n, solve_rate, round(token_auc, 6) as token_auc from scores")
def policy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).drop("metric_scope").withColumn("token_auc", F.round("token_auc", 6))


def _area_sql(cost: str, cumulative: str) -> str:
    return f"{_curve_sql(cost, cumulative, 'hidden_success')}, {AREA} select budget_name, policy_name, auc from auc"


@query(f"""select t.budget_name, t.policy_name, 'hidden' as metric_scope, round(t.auc, 6) as token_auc, round(v.auc, 6) as verifier_auc, round(s.auc / 1000, 6) as time_auc
from ({_area_sql("decision_tokens", "cumulative_tokens")}) t join ({_area_sql("decision_verifier_calls", "cumulative_verifier_calls")}) v using (budget_name, policy_name)
join ({_area_sql("decision_ms", "cumulative_ms")}) s using (budget_name, policy_name)""")
def policy_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of each policy by tokens, calls and seconds, over the successes that the data's own scope names."""
    rounded = [F.round(c, 6).alias(n) for n, c in (("token_auc", "token_auc"), ("verifier_auc", "verifier_call_auc"), ("time_auc", "time_auc"))]
    return _scores(spark, sf_dir, tuple(curves.COSTS)).select("budget_name", "policy_name", "metric_scope", *rounded)


@query(f"{SCORES} select budget_name, policy_name, n, solve_rate, round(token_auc, 6) as token_auc from best")
def best_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.best_baseline(_scores(spark, sf_dir), ["budget_name"], views.BASELINES).drop("metric_scope").withColumn("token_auc", F.round("token_auc", 6))


def _compared(scores: DataFrame) -> DataFrame:
    return curves.budget_comparisons(scores, views.DECISION_POLICY, views.BASELINES)


@query(f"{SCORES} select budget_name, decision_rate, round(decision_auc, 6) as decision_auc, baseline, baseline_rate, round(baseline_auc, 6) as baseline_auc, {_STATUS} from rel")
def budget_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(_scores(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("decision_auc", "baseline_auc")})


@query(f"{SCORES} select budget_name, case when decision_rate > baseline_rate or (decision_rate = baseline_rate and decision_auc > baseline_auc) then 'win' when decision_rate = baseline_rate and decision_auc = baseline_auc then 'tie' else 'loss' end as relationship from cmp")
def portfolio_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _compared(_scores(spark, sf_dir))
    return out.select("budget_name", curves.portfolio_relationship(*map(F.col, ("decision_rate", "decision_auc", "baseline_rate", "baseline_auc"))).alias("relationship"))


_ALL = SCORES.replace("grid as (select distinct budget_name, cumulative_tokens as budget from attempts union select distinct budget_name, 0 from attempts)", "both_a as (select * replace ('all' as budget_name) from attempts), both_r as (select * replace ('all' as budget_name) from results), grid as (select distinct budget_name, cumulative_tokens as budget from both_a union select distinct budget_name, 0 from both_a)")
_ALL = _ALL.replace("count(*) as n from results group by all", "count(*) as n from both_r group by all").replace("count(*) as c from results where", "count(*) as c from both_r where").replace("as r from results group by all", "as r from both_r group by all")


@query(f"""{_ALL} select 'purchase' as decision, baseline, decision_rate, round(decision_auc, 6) as decision_auc, baseline_rate, round(baseline_auc, 6) as baseline_auc from cmp""")
def overall_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All budgets together, on a grid that spans them."""
    return decision_verdict(spark, sf_dir).select("decision", "baseline", "decision_rate", F.round("decision_auc", 6).alias("decision_auc"), "baseline_rate", F.round("baseline_auc", 6).alias("baseline_auc"))


@query(f"""select decision, baseline, decision_rate, decision_auc, baseline_rate, baseline_auc, win, tie, loss, unresolved, case when decision_rate is null or baseline_rate is null then 'insufficient_data'
  when decision_rate = 0 and baseline_rate = 0 then 'inconclusive' when not (decision_rate >= baseline_rate and da >= ba and loss = 0 and unresolved = 0) then 'needs_analysis' when win > 0 then 'promising' else 'matches_baseline' end as verdict
from ({_ALL} select 'purchase' as decision, baseline, decision_rate, round(decision_auc, 6) as decision_auc, baseline_rate, round(baseline_auc, 6) as baseline_auc, decision_auc as da, baseline_auc as ba from cmp),
({SCORES} select count(*) filter (relationship = 'win') as win, count(*) filter (relationship = 'tie') as tie, count(*) filter (relationship = 'loss') as loss, count(*) filter (relationship in ('inconclusive', 'unknown')) as unresolved
  from (select {_STATUS} from rel))""")
def decision_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets one by one and all together, as two grouping sets of one pass."""
    attempted = _attempts(spark, sf_dir)
    both = curves.scores(views.results(attempted), attempted, [["budget_name"], []], ("token",))
    out = curves.decided(both, views.DECISION_POLICY, views.BASELINES)
    return out.withColumns({c: F.round(c, 6) for c in ("decision_auc", "baseline_auc")})


def _area_ctes(name: str, cost: str, cumulative: str, solved: str) -> str:
    """The area of each group and policy of relations ga (attempts) and gr (results) with a column grp."""
    return f"""
{name}_p as (select t.grp, t.policy_name, g.budget, 0 as c, 1 as g from (select distinct grp, policy_name from gr) t
      join (select distinct grp, {cumulative} as budget from ga union select distinct grp, 0 from ga) g on t.grp = g.grp
    union all select grp, policy_name, {cost}, count(*), 0 from gr where {solved} and {cost} is not null group by all),
{name}_r as (select grp, policy_name, budget, max(g) as g, sum(sum(c)) over (partition by grp, policy_name order by budget) as reached from {name}_p group by grp, policy_name, budget),
{name}_c as (select grp, policy_name, budget, reached / n as rate from {name}_r join (select grp, policy_name, count(*) as n from gr group by all) using (grp, policy_name) where g = 1),
{name}_d as (select *, lead(budget) over w - budget as dx, (lead(rate) over w + rate) / 2 as y from {name}_c window w as (partition by grp, policy_name order by budget)),
{name} as (select grp, policy_name, round(coalesce(sum(dx * y), 0), 6) as auc from {name}_d group by all)"""


_AREAS = ",".join(
    _area_ctes(f"{scope}_{kind}", f"decision_{cost}", f"cumulative_{cost}", solved) for scope, solved in (("public", "success"), ("hidden", "hidden_success")) for kind, cost in (("token", "tokens"), ("verifier_call", "verifier_calls"))
)
_AREA_JOINS = " ".join(f"join {scope}_{kind} on r.grp = {scope}_{kind}.grp and r.policy_name = {scope}_{kind}.policy_name" for scope in ("public", "hidden") for kind in ("token", "verifier_call"))
_COUNTED = """count(*) as number_of_results, avg(cast(success as integer)) as public_solve_rate, avg(cast(hidden_success as integer)) as hidden_solve_rate, avg(cast(oracle_hidden_success as integer)) as oracle_hidden_solve_rate,
    avg(cast(success as integer)) - avg(cast(hidden_success as integer)) as public_hidden_gap, avg(cast(success and not hidden_success as integer)) as overfit_rate,
    count(*) filter (success) as solved_count, count(*) filter (hidden_success) as hidden_solved_count, count(*) filter (oracle_hidden_success) as oracle_hidden_solved_count,
    median(decision_tokens) filter (success) as mp, median(decision_tokens) filter (hidden_success) as mh"""


@query(f"""{ATT}, ga as (select *, budget_name as grp from attempts union all select *, 'all' from attempts), gr as (select *, budget_name as grp from results union all select *, 'all' from results),{_AREAS},
r as (select grp, policy_name, {_COUNTED} from gr group by all)
select cast(case when r.grp = 'all' then 1 else 0 end as int) as grouping, nullif(r.grp, 'all') as budget_name, r.policy_name, 'hidden' as metric_scope, number_of_results, hidden_solve_rate as solve_rate, hidden_token.auc as token_auc,
  hidden_verifier_call.auc as verifier_call_auc, mh as median_tokens_to_solution, public_solve_rate, hidden_solve_rate, oracle_hidden_solve_rate, public_hidden_gap, overfit_rate, public_token.auc as public_token_auc,
  hidden_token.auc as hidden_token_auc, public_verifier_call.auc as public_verifier_call_auc, hidden_verifier_call.auc as hidden_verifier_call_auc, mp as median_tokens_to_public_solution, mh as median_tokens_to_hidden_solution,
  solved_count, hidden_solved_count, oracle_hidden_solved_count from r {_AREA_JOINS}""")
def policy_score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the policies' scores, by budget and over all budgets."""
    attempted = _attempts(spark, sf_dir)
    out = curves.scores(views.results(attempted), attempted, [["budget_name"], []])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_auc")})


_MODELS = "'m' || task_id % 2 as model_name, 'id' || task_id % 2 as model_id, case when task_id % 2 = 0 then 'small' else 'unknown' end as model_tier"


@query(f"""{ATT}, ga as (select *, 'm' || task_id % 2 || '/' || budget_name as grp from attempts),
gr as (select *, 'm' || task_id % 2 || '/' || budget_name as grp, {_MODELS}, case when policy_name = 'view' then 'run' when task_id % 3 = 0 then 'task' end as scope from results),{_AREAS},
r as (select grp, model_name, model_id, model_tier, policy_name, budget_name, {_COUNTED}, count(distinct task_id) as number_of_tasks, count(distinct task_id % 4) as number_of_seeds,
    case when count(distinct coalesce(scope, 'unknown')) = 1 then min(coalesce(scope, 'unknown')) else 'mixed' end as policy_state_scope, median(decision_verifier_calls) filter (success) as cp, median(decision_verifier_calls) filter (hidden_success) as ch,
    cast(sum(total_tokens) as bigint) as total_tokens, cast(sum(total_verifier_calls) as bigint) as total_verifier_calls from gr group by all),
e as (select grp, policy_name, unnest([1, 2, 4, 8, 16, 18]) as k, total_verifier_calls as n, hidden_correct as c, budget_name from gr),
pk as (select grp, policy_name, k, avg({PASS_K}) filter (n >= k and budget_name = 'tight') as v from e group by all),
pw as (select grp, policy_name, {", ".join(f"max(v) filter (k = {k}) as fixed_sample_pass_at_{k}" for k in (1, 2, 4, 8, 16, 18))} from pk group by all)
select model_name, model_id, model_tier, r.policy_name, budget_name, number_of_results, number_of_tasks, number_of_seeds, policy_state_scope, solved_count, public_solve_rate as solve_rate, public_solve_rate, hidden_solved_count,
  hidden_solve_rate, oracle_hidden_solved_count, oracle_hidden_solve_rate, pw.* exclude (grp, policy_name), public_hidden_gap, overfit_rate, mp as median_tokens_to_solution, mh as median_tokens_to_hidden_solution,
  cp as median_verifier_calls_to_solution, ch as median_verifier_calls_to_hidden_solution, public_token.auc as token_auc, public_verifier_call.auc as verifier_call_auc, hidden_token.auc as hidden_token_auc,
  hidden_verifier_call.auc as hidden_verifier_call_auc, total_verifier_calls as total_attempts, total_tokens, total_verifier_calls from r {_AREA_JOINS} join pw on r.grp = pw.grp and r.policy_name = pw.policy_name""")
def experiment_summary_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the summary, by model, policy and budget; the tight budget counts as a fixed sample."""
    half = F.col("task_id") % 2
    name = lambda df: df.withColumns({"model_name": F.concat(F.lit("m"), half), "model_id": F.concat(F.lit("id"), half), "model_tier": F.when(half == 0, "small")})
    attempted = _attempts(spark, sf_dir)
    scope = F.when(F.col("policy_name") == "view", "run").when(F.col("task_id") % 3 == 0, "task")
    sampled = {"fixed_sample": F.col("budget_name") == "tight", "truncated": F.lit(False), "graded": F.col("total_verifier_calls"), "seed": F.col("task_id") % 4, "policy_state_scope": scope}
    out = summaries.full_summary(name(views.results(attempted)).withColumns(sampled), name(attempted))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_auc")})


# Replay -------------------------------------------------------------------------------------------------------------

BEST = "bn as (select *, coalesce(max(cast(base_passed as integer)) over (partition by task_id order by candidate_index rows between unbounded preceding and 1 preceding), 0) as before from pool), kept as (select * from bn where before = 0)"


@query(f"{CAND} select task_id, count(*) as calls, cast(sum(total_tokens) as bigint) as tokens, bool_or(base_passed) as success, max(case when base_passed then 0 end) as selected_index, cast(max(case when base_passed then total_tokens end) as bigint) as decision_tokens, max(case when base_passed then 1 end) as decision_calls from pool where candidate_index = 0 group by task_id")
def replay_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_result(replay.greedy(views.pool(spark, sf_dir)))


@query(f"{CAND}, {BEST} select task_id, count(*) as calls, cast(sum(total_tokens) as bigint) as tokens, bool_or(base_passed) as success, max(case when base_passed then candidate_index end) as selected_index, cast(case when bool_or(base_passed) then sum(total_tokens) end as bigint) as decision_tokens, max(case when base_passed then candidate_index + 1 end) as decision_calls from kept group by task_id")
def replay_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_result(replay.best_of_n(views.pool(spark, sf_dir), POOL_SIZE))


@query(f"{CAND} select task_id, count(*) as calls, cast(sum(total_tokens) as bigint) as tokens, bool_or(base_passed and candidate_index = 0) as success, 0 as selected_index, cast(sum(total_tokens) as bigint) as decision_tokens, count(*) as decision_calls from pool group by task_id")
def replay_sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_result(replay.sample_n(views.pool(spark, sf_dir), POOL_SIZE), whole_cost=True)


@query(f"""{ATT}, w as (select *, row_number() over q - 1 as done, coalesce(sum(total_tokens) over (q rows between unbounded preceding and 1 preceding), 0) as spent from attempts where budget_name = 'full' window q as (partition by task_id, policy_name order by attempt_index)),
o as (select *, case when done < 8 and spent + 5 < 250 then 0 else 1 end as no from w), r as (select *, sum(no) over (partition by task_id, policy_name order by attempt_index) as refused from o)
select task_id, policy_name, count(*) as admitted, cast(sum(total_tokens) as bigint) as tokens from r where refused = 0 group by all""")
def ledger_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _attempts(spark, sf_dir).where("budget_name = 'full'").withColumn("input_tokens", F.lit(5))
    kept = replay.admitted(full, ["task_id", "policy_name"], max_attempts=8, max_tokens=250)
    return kept.groupBy("task_id", "policy_name").agg(F.count("*").alias("admitted"), F.sum("total_tokens").alias("tokens"))


@query(f"""{ATT}, w as (select *, coalesce(sum(total_tokens) over (partition by task_id, policy_name order by attempt_index rows between unbounded preceding and 1 preceding), 0) as spent from attempts where budget_name = 'full'),
o as (select *, case when spent + 5 < 250 and spent + total_tokens <= 250 then 0 else 1 end as no from w), r as (select *, sum(no) over (partition by task_id, policy_name order by attempt_index) as refused from o)
select task_id, policy_name, count(*) as admitted, cast(sum(total_tokens) as bigint) as tokens from r where refused = 0 group by all""")
def ledger_without_overshoot(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _attempts(spark, sf_dir).where("budget_name = 'full'").withColumn("input_tokens", F.lit(5))
    kept = replay.admitted(full, ["task_id", "policy_name"], max_tokens=250, discard_overshoot=True)
    return kept.groupBy("task_id", "policy_name").agg(F.count("*").alias("admitted"), F.sum("total_tokens").alias("tokens"))


# Trajectories -------------------------------------------------------------------------------------------------------

STEPS = f"""{CAND}, {BEST}, steps as (
  select '4x1' as pool_id, *, candidate_index as root_index, 0 as depth from kept
  union all select '2x2' as pool_id, *, candidate_index % 2 as root_index, candidate_index // 2 as depth from kept)"""
TOBS = f"""{STEPS}, seen as (select pool_id, task_id, count(*) as calls, cast(sum(total_tokens) as bigint) as generation_tokens, count(*) filter (depth > 0) as repair_calls, bool_or(base_passed) as public_passed,
    coalesce(min(case when base_passed then candidate_index end), 0) as s from steps group by all),
tobs as (select seen.pool_id, seen.task_id, calls, generation_tokens, repair_calls, public_passed, s as selected_candidate_index, case when depth = 0 then 'sample' else 'repair' end as selected_operator, public_passed and plus_passed as hidden_passed, public_passed and not plus_passed as false_accept
  from seen join steps on seen.pool_id = steps.pool_id and seen.task_id = steps.task_id and s = candidate_index)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.shaped_steps(views.pool(spark, sf_dir), [(4, 1), (2, 2)])


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.task_observations(_steps(spark, sf_dir), views.pool_hidden(spark, sf_dir))


@query(f"""{STEPS} select pool_id, task_id, candidate_index, case when depth = 0 then 'sample' else 'repair' end as operator, root_index, depth, case when depth = 0 then candidate_index else 2 + depth - 1 end as round_index,
  case when depth > 0 then candidate_index - 2 end as parent_candidate_index, base_passed as selected from steps""")
def trajectory_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("pool_id", "task_id", "candidate_index", "operator", "root_index", "depth", "round_index", "parent_candidate_index", "selected")


@query(f"{TOBS} select * from tobs")
def trajectory_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trajectories(spark, sf_dir)


TSUM = f"""{TOBS}, tsum as (select pool_id, count(*) as task_count, avg(cast(hidden_passed as integer)) as hidden_rate, avg(cast(public_passed as integer)) as public_rate, avg(case when public_passed then cast(false_accept as integer) end) as false_accept_rate,
  cast(sum(calls) as bigint) as total_calls, avg(calls) as mean_calls, median(calls) as median_calls, cast(sum(generation_tokens) as bigint) as total_tokens, avg(generation_tokens) as mean_tokens, cast(sum(repair_calls) as bigint) as repair_calls,
  count(*) filter (repair_calls > 0) as repaired_tasks, count(*) filter (hidden_passed and selected_operator = 'repair') as repair_wins, count(*) filter (calls >= 4) as full_budget_tasks, least(cast(1 as double), sum(calls) / (16 * count(*))) as fixed_call_fraction from tobs group by pool_id)"""


@query(f"{TSUM} select * from tsum")
def trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.policy_summary(_trajectories(spark, sf_dir))


@query(f"""{TOBS}, st as (select pool_id, sum((task_id * 31 + candidate_index * 17) % 900) / 1000 as generation_latency_seconds, avg(cast(trim(code) = '' as integer)) as empty_candidate_rate, avg(cast(output_tokens >= 250 as integer)) as possible_truncation_rate from steps group by pool_id)
select pool_id, cast(split_part(pool_id, 'x', 1) as bigint) as width, cast(split_part(pool_id, 'x', 2) as bigint) as depth, count(*) as task_count, cast(4 as bigint) as maximum_calls_per_task, avg(cast(public_passed as integer)) as public_pass_rate,
  avg(cast(hidden_passed as integer)) as hidden_pass_rate, avg(case when public_passed then cast(false_accept as integer) end) as false_accept_rate, count(*) filter (public_passed and selected_operator = 'repair') as selected_by_repair_count,
  count(*) filter (hidden_passed and selected_operator = 'repair') as hidden_solved_by_repair_count, cast(sum(calls) as bigint) as total_calls, avg(calls) as mean_calls, median(calls) as median_calls, count(*) filter (calls = 4) as full_budget_task_count,
  least(cast(1 as double), sum(calls) / (16 * count(*))) as fixed_n16_call_fraction, cast(sum(generation_tokens) as bigint) as total_generation_tokens, avg(generation_tokens) as mean_generation_tokens,
  any_value(st.generation_latency_seconds) as generation_latency_seconds, any_value(st.empty_candidate_rate) as empty_candidate_rate, any_value(st.possible_truncation_rate) as possible_truncation_rate from tobs join st using (pool_id) group by pool_id""")
def trajectory_summary_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the policies' summaries; latencies are made from the steps' numbers."""
    latency = (F.col("task_id") * 31 + F.col("candidate_index") * 17) % 900
    return trajectory.full_policy_summary(_steps(spark, sf_dir).withColumn("latency_ms", latency), _trajectories(spark, sf_dir), POOL_SIZE, 250)


@query(f"{STEPS} select pool_id, avg(cast(trim(code) = '' as integer)) as empty_rate, avg(cast(output_tokens >= 250 as integer)) as truncation_rate from steps group by pool_id")
def trajectory_step_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.step_rates(_steps(spark, sf_dir), 250)


@query(f"""{TOBS}, p as (select a.task_id, cast(b.hidden_passed as integer) - cast(a.hidden_passed as integer) as d, b.calls - a.calls as c, b.generation_tokens - a.generation_tokens as t, b.calls as own from tobs a join tobs b on a.task_id = b.task_id and a.pool_id = '4x1' and b.pool_id = '2x2')
select '4x1' as baseline, '2x2' as challenger, count(*) as task_count, avg(d) as hidden_difference, avg(c) as calls_difference, avg(t) as tokens_difference, count(*) filter (d > 0) as wins, count(*) filter (d < 0) as losses, count(*) filter (d = 0) as ties, avg(d) >= 0.03 and avg(own) <= 8 as gate from p""")
def trajectory_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.paired_comparison(_trajectories(spark, sf_dir), "4x1", "2x2")


@query(f"{TSUM} select row_number() over (order by hidden_rate desc, total_tokens, total_calls, split_part(pool_id, 'x', 1) desc, split_part(pool_id, 'x', 2), pool_id) as rank, pool_id, hidden_rate, total_tokens, total_calls, cast(split_part(pool_id, 'x', 1) as bigint) as width, cast(split_part(pool_id, 'x', 2) as bigint) as depth from tsum")
def trajectory_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.ranking(trajectory_summary(spark, sf_dir))


def _study(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return studies.trajectory_study(_trajectories(spark, sf_dir), ["4x1", "2x2"], 4, resamples=STUDY_RESAMPLES)


@query()
def trajectory_study_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each width x depth policy with the seeded interval of its hidden rate."""
    return _study(spark, sf_dir)["policies"]


@query()
def trajectory_study_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies against the first one, with seeded intervals of the differences and the outcome."""
    comparisons = _study(spark, sf_dir)["comparisons"]  # the study's confirmations are this, which would be drawn twice
    return comparisons.withColumn("outcome", trajectory.confirmation(F.col("hidden_difference"), F.col("hidden_ci_low")))


@query("select mode as mode, case when difference >= 0.03 and low > 0 then 'strong_confirmation' when difference >= 0.03 then 'suggestive_confirmation' else 'failed_confirmation' end as outcome, n from (select l_shipmode as mode, avg(l_discount) - 0.02 as difference, min(l_discount) - 0.001 as low, count(*) as n from lineitem group by 1)".replace("l_shipmode as mode", "l_linestatus as mode"))
def confirmation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("mode")).agg((F.avg("l_discount") - 0.02).alias("d"), (F.min("l_discount") - 0.001).alias("low"), F.count("*").alias("n"))
    return by.select("mode", trajectory.confirmation(F.col("d"), F.col("low")).alias("outcome"), "n")


@query(f"{STEPS} select a.task_id, a.root_index, true as same from steps a join steps b on a.task_id = b.task_id and a.root_index = b.root_index and a.depth = 0 and b.depth = 0 and a.pool_id = '4x1' and b.pool_id = '2x2' where a.root_index < 2")
def shared_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.shared_roots(_steps(spark, sf_dir), "4x1", "2x2", 2)


def _root_steps(spark: SparkSession, sf_dir: str, spoiled: bool) -> DataFrame:
    """Steps with all fields of roots; the second policy's are spoiled where it is asked for."""
    second = (F.col("pool_id") == "2x2") if spoiled else F.lit(False)
    task, passed = F.col("task_id"), F.col("base_passed")
    failed = F.struct(F.lit("fail").alias("status"), F.array("code").alias("failed_inputs"), F.lit(1).cast("long").alias("total_failed_inputs"))
    sampling = F.struct(F.lit(0.8).alias("temperature"), F.lit(0.95).alias("top_p"), (F.col("candidate_index") + task).alias("seed"), F.array().cast("array<string>").alias("stop_sequences"))
    return _steps(spark, sf_dir).withColumns({
        "prompt_sha256": F.sha2(F.concat(F.lit("prompt "), task.cast("string")).cast("binary"), 256),
        "raw_completion_sha256": F.sha2(F.col("code").cast("binary"), 256),
        "sanitized_code_sha256": F.sha2(F.trim("code").cast("binary"), 256),
        "output_tokens": F.col("output_tokens") + F.when(second & (task % 5 == 0), 1).otherwise(0),
        "sampling": sampling,
        "status": F.when(passed, "pass").otherwise("fail"),
        "verification_passed": passed,
        "error_type": F.when(~passed, F.when(second & (task % 7 == 0), "other").otherwise("wrong")),
        "public_feedback": F.when(~passed, failed),
    }).where(~(second & (task % 11 == 0) & (F.col("root_index") == 1)))


@query(f"""{STEPS}, r as (select pool_id, task_id, root_index, base_passed from steps where depth = 0), a as (select * from r where pool_id = '4x1' and root_index < 2),
b as (select * from r where pool_id = '2x2' and not (task_id % 11 = 0 and root_index = 1))
select '2x2' as challenger, a.task_id, a.root_index, unnest(list_filter([case when b.task_id is null then 'missing' end, case when b.task_id is not null and a.task_id % 5 = 0 then 'output_tokens' end,
  case when b.task_id is not null and a.task_id % 7 = 0 and not a.base_passed then 'error_type' end], lambda x: x is not null)) as field from a left join b using (task_id, root_index)""")
def shared_root_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which the second policy's roots differ: tokens of every fifth task, errors of every seventh, roots lost in every eleventh."""
    return trajectory.root_differences(_root_steps(spark, sf_dir, True), {"4x1": 4, "2x2": 2})


@query(f"""{STEPS}, r as (select *, base_passed as p from steps where depth = 0 and pool_id = '4x1' and root_index < 2),
j as (select task_id, root_index, '{{"candidate_index":' || candidate_index || ',"depth":0,"error_type":' || case when p then 'null' else '"wrong"' end || ',"input_tokens":' || input_tokens || ',"operator":"sample","output_tokens":' || output_tokens
  || ',"parent_candidate_index":null,"prompt_sha256":"' || sha256('prompt ' || task_id) || '","public_feedback":' || case when p then 'null' else '{{"failed_inputs":["' || code || '"],"status":"fail","total_failed_inputs":1}}' end
  || ',"raw_completion_sha256":"' || sha256(code) || '","root_index":' || root_index || ',"round_index":' || candidate_index || ',"sampling":{{"seed":' || candidate_index + task_id || ',"stop_sequences":[],"temperature":0.8,"top_p":0.95}}'
  || ',"sanitized_code_sha256":"' || sha256(trim(code)) || '","selected":' || case when p then 'true' else 'false' end || ',"status":"' || case when p then 'pass' else 'fail' end || '","task_id":' || task_id
  || ',"total_tokens":' || total_tokens || ',"verification_passed":' || case when p then 'true' else 'false' end || '}}' as t from r)
select ['4x1', '2x2'] as pool_ids, count(*) as compared_root_count, count(*) as unique_root_count, sha256('[' || string_agg(t, ',' order by task_id, root_index) || ']') as canonical_sha256 from j""")
def shared_root_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the roots that both policies share, equal in all fields."""
    parts = views.parts_of(table(spark, sf_dir, "lineitem"))
    return trajectory.root_digest(_root_steps(spark, sf_dir, False), {"4x1": 4, "2x2": 2}, parts=parts)


# Clusters and shards ------------------------------------------------------------------------------------------------

DIST = f"""{CAND}, dist as (select a.task_id, a.candidate_index as l, b.candidate_index as r, (cast(a.trace[1] <> b.trace[1] as integer) + cast(a.trace[2] <> b.trace[2] as integer) + cast(a.trace[3] <> b.trace[3] as integer)) / 3 as distance from pool a join pool b on a.task_id = b.task_id)"""


@query(f"""{DIST} select task_id, l as "left", r as "right", distance from dist""")
def trace_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.distances(views.pool(spark, sf_dir))


@query(f"{DIST}, t as (select task_id, l, round(coalesce(sum(distance) filter (l <> r), 0), 9) as total from dist group by all) select task_id, l as medoid, total from t qualify row_number() over (partition by task_id order by total, l) = 1")
def trace_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.medoids(clustering.distances(views.pool(spark, sf_dir)))


@query()
def consensus_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = clustering.consensus_choices(views.pool(spark, sf_dir))
    return chosen.withColumn("ratio", scalars.largest_cluster_ratio(F.col("cluster_sizes"))).withColumn("margin", scalars.top_two_margin(F.col("cluster_sizes")))


@query(f"{CAND}, t as (select distinct task_id from pool) select task_id, cast((row_number() over (order by task_id) - 1) // 10 as bigint) as shard from t")
def task_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.task_shards(views.pool(spark, sf_dir), 10)


@query(f"{CAND} select row_number() over (order by task_id, candidate_index) - 1 as sample_row, task_id, candidate_index, code as solution from pool")
def evaluator_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.sample_rows(views.pool(spark, sf_dir), "code")


# Stateful policies --------------------------------------------------------------------------------------------------


def _policy(name: str, scope: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = views.pool(spark, sf_dir)
        limits = policies.Limits(attempts=4, tokens=700)
        if scope:
            own = own.join(clustering.task_shards(own, 50), "task_id")
        return policies.run_policy(own, name, limits, "shard" if scope else None)

    return run


for _name in policies.POLICIES:
    QUERIES[f"policy_{_name}"] = _policy(_name)
QUERIES["policy_operator_bandit_per_run"] = _policy("operator_bandit", scope=True)
ORACLES["policy_repair_only"] = f"""{CAND}, w as (select *, sum(total_tokens) over (partition by task_id order by candidate_index) as cum, first(base_passed) over (partition by task_id order by candidate_index) as won, first(total_tokens) over (partition by task_id order by candidate_index) as t0 from pool where candidate_index < 2)
select task_id, case when candidate_index = 0 then 'repair_only/draft' else 'repair_only/repair' end as operator, candidate_index as attempt_index, candidate_index, true as verified, base_passed as passed, case when base_passed then null else 'wrong_answer' end as error_type, cast(cum as bigint) as cumulative_tokens, candidate_index + 1 as cumulative_calls, base_passed as selected
from w where candidate_index = 0 or (not won and t0 + input_tokens < 700)"""


# Text and code ------------------------------------------------------------------------------------------------------


@query(r"""with t as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents)
select doc_id, cast(len(w) as bigint) as tokens, case when len(w) > 20 then array_to_string(w[1:20], ' ') else text end as head, sha256(text) as digest from t""")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    t = F.col("text")
    return docs.select("doc_id", scalars.token_count(t).alias("tokens"), scalars.truncated(t, 20).alias("head"), scalars.sha256_hex(t).alias("digest"))


@query("select o_orderkey, cast(cast('0x' || substr(sha256('split-1' || cast(o_orderkey as varchar)), 1, 16) as ubigint) % 5 as integer) as bucket, cast('0x' || substr(sha256('split-1' || cast(o_orderkey as varchar)), 1, 16) as ubigint) % 5 = 0 as development from orders")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = scalars.hash_bucket(F.col("o_orderkey").cast("string"), "split-1", 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", bucket.alias("bucket"), (bucket == 0).alias("development"))


@query(r"select doc_id, regexp_replace(text, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g') || chr(10) || chr(10) || 'x = ' || doc_id as code from documents")
def fenced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```\nand\n```\nx = "), F.col("doc_id").cast("string"), F.lit("\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.fenced_code(fenced).alias("code"))


_NUMBER = "cast(l_linenumber as varchar)"
#: Answers by line number modulo 5, as {} for the number, and the code that each holds.
_ANSWERS = (
    ("Sure.\ndef f(x):\n    return x + {}\nThat is all.", "def f(x):\n    return x + {}"),
    ("from here on, this is it:\nimport math\ndef f(x):\n    return {}\n", "def f(x):\n    return {}"),
    ("Look:\n```python\na = {}\n```\nand\n```\nb = 2\n```", "a = {}\n\nb = 2"),
    ("First a helper.\ndef g():\n    return {}\nThen the answer.\ndef f(x):\n    return g()\nDone now.", "def f(x):\n    return g()"),
    ("  x = {}\n", "x = {}"),
)


def _answers_sql(which: int) -> str:
    text = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{}", f"' || {_NUMBER} || '") + "'"
    cases = " ".join(f"when {i} then {text(pair[which])}" for i, pair in enumerate(_ANSWERS))
    return f"case l_linenumber % {len(_ANSWERS)} {cases} end"


@query(f"select l_orderkey, l_linenumber, {_answers_sql(1)} as code from lineitem")
def extracted_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction by the Python parser: prose before code, prose like an import, fences, the entrypoint first, a whole text."""
    number = F.col("l_linenumber").cast("string")
    texts = F.array(*[F.replace(F.lit(t), F.lit("{}"), number) for t, _ in _ANSWERS])
    text = F.get(texts, (F.col("l_linenumber") % len(_ANSWERS)).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pycode.extract_code(text, F.lit("f")).alias("code"))


def _probe(number: str, text: str, k: str = "[1, 2]") -> str:
    """A probe's text in SQL."""
    quote = "''"
    return f"'((' || {number} || ', {quote}' || {text} || '{quote}), {{{quote}k{quote}: {k}}})'"


_N, _FLAG = "cast(l_linenumber as varchar)", "l_returnflag"
_PROBES = [_probe(_N, _FLAG), _probe("'-1'", _FLAG), _probe("'0'", _FLAG), f"case when l_linenumber <> 1 then {_probe(repr('1'), _FLAG)} end", _probe("cast(l_linenumber + 1 as varchar)", _FLAG)]
_PROBES += [_probe(_N, "''"), _probe(_N, f"{_FLAG} || {_FLAG}"), _probe(_N, _FLAG, "[]"), _probe(_N, _FLAG, "[2, 1]")]


@query(f"select l_orderkey, l_linenumber, array_to_string(list_filter([{', '.join(_PROBES)}], lambda x: x is not null), '; ') as probes from lineitem")
def probe_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes from one visible test an order line: the call and its mutations, an argument at a time."""
    test = F.concat(F.lit("assert f("), F.col("l_linenumber").cast("string"), F.lit(", '"), F.col("l_returnflag"), F.lit("', k=[1, 2]) == 0"))
    probes = F.array_join(pycode.probe_calls(F.array(test), F.lit("f")), "; ")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", probes.alias("probes"))


@query(r"""select event_id, case when event_id % 4 = 0 then 'syntax_error' when event_id % 4 = 1 then 'test_failure' when event_id % 4 = 2 then 'runtime_error' end as failure,
  case when event_id % 5 = 0 then 'unknown' else event_type || '_' || user_id end as component, case when event_id % 2 = 0 then event_type else 'p ' || event_type end as stripped, printf('%.1f%%', user_id / 10.0) as share from events""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    stderr = F.when(kind == 0, "  File x\nSyntaxError: bad").when(kind == 1, "AssertionError").when(kind == 2, "KeyError: 'a'")
    name = F.when(F.col("event_id") % 5 == 0, "--..").otherwise(F.concat(F.lit("."), F.col("event_type"), F.lit(" /"), F.col("user_id").cast("string"), F.lit("-")))
    prompted = F.concat(F.when(F.col("event_id") % 2 == 0, "prompt  \n").otherwise("p "), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.failure_class(stderr).alias("failure"), scalars.path_component(name).alias("component"), scalars.without_prefix(prompted, F.lit("prompt")).alias("stripped"), scalars.percent(F.col("user_id") / 1000).alias("share")
    )


@query("select conv_id, turn, text || chr(10) || chr(10) || 'First list the steps you would take, without code.' as plan, text || chr(10) || chr(10) || 'Change as little as possible in this answer so that it becomes right:' || chr(10) || role as revision, text || chr(10) || chr(10) || 'Your previous answer was:' || chr(10) || role || chr(10) || chr(10) || 'It failed with: no details' || chr(10) || 'Write a corrected answer.' as repair from conversations")
def prompt_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, r = F.col("text"), F.col("role")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.plan_prompt(t).alias("plan"), scalars.revision_prompt(t, r).alias("revision"), scalars.repair_prompt(t, r, none).alias("repair"))


# Evaluator output ---------------------------------------------------------------------------------------------------


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("base_passed"), "pass").when(F.col("total_tokens") % 3 == 0, "timeout").when(F.col("total_tokens") % 3 == 1, "fail").otherwise("crashed")
    plus = F.when(F.col("candidate_index") < 3, F.when(F.col("total_tokens") % 2 == 0, "pass").otherwise("fail"))
    failed = F.transform(F.sequence(F.lit(1), (F.col("total_tokens") % 5 + 1).cast("int")), lambda i: i.cast("string"))
    entry = F.struct("candidate_index", F.struct(F.col("code").alias("solution"), status.alias("base_status"), plus.alias("plus_status"), failed.alias("base_fail_tests")).alias("e"))
    tasks = views.pool(spark, sf_dir).groupBy(F.col("task_id").cast("string").alias("task")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    return tasks.select(F.to_json(F.struct(F.map_from_arrays(F.array("task"), F.array("entries")).alias("eval"))).alias("json"))


@query(f"""{CAND}, s as (select *, case when base_passed then 'pass' when total_tokens % 3 = 0 then 'timeout' when total_tokens % 3 = 1 then 'fail' else 'error' end as b, case when candidate_index < 3 then case when total_tokens % 2 = 0 then 'pass' else 'fail' end end as p from pool),
c as (select *, case when b = 'pass' then p else b end as q from s)
select cast(task_id as varchar) as task_id, candidate_index, sha256(code) as solution_sha256, b as base_status, case when b <> 'pass' then 'evalplus_' || b end as base_error, q as plus_status, case when q <> 'pass' then 'evalplus_' || q end as plus_error,
  case when b <> 'pass' then array_to_string(list_transform(range(1, least(total_tokens % 5 + 1, 3) + 1), lambda i: cast(i as varchar)), ',') end as failed_inputs, case when b <> 'pass' then total_tokens % 5 + 1 end as total_failed_inputs, case when b <> 'pass' then total_tokens % 5 + 1 > 3 end as feedback_truncated,
  case when b = 'pass' and p is null then 'missing_plus_status' end as problem from c""")
def evaluator_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.evaluator_grades(_evaluated(spark, sf_dir), "json").withColumn("failed_inputs", F.array_join("failed_inputs", ","))


# Integrity ----------------------------------------------------------------------------------------------------------


@query(f"""{CAND} select task_id, candidate_index, 'token_sum' as rule from cand where task_id % 7 = 0 union all select task_id, candidate_index, 'cumulative_tokens' from cand where candidate_index = 3""")
def accounting_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh task's sums are spoiled, and each fourth attempt's cumulative cost."""
    own = views.candidates(spark, sf_dir).select("task_id", F.lit("pool").alias("policy_name"), F.col("candidate_index").alias("attempt_index"), "input_tokens", "output_tokens", "total_tokens")
    spoiled = own.withColumn("output_tokens", F.col("output_tokens") + (F.col("task_id") % 7 == 0).cast("int"))
    whole = spoiled.withColumn("cumulative_tokens", F.when(F.col("attempt_index") == 3, 0).otherwise(F.col("total_tokens"))).withColumn("cumulative_verifier_calls", F.col("attempt_index") + 1)
    return integrity.attempt_accounting(whole).select("task_id", F.col("attempt_index").alias("candidate_index"), "rule")


@query(f"{ATT} select task_id, policy_name, budget_name, 'success_selected' as rule from results where not success and task_id % 2 = 0 union all select task_id, policy_name, budget_name, 'decision_costs' from results where success and task_id % 3 = 0")
def result_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of even users are called successes, and every third user's calls to a solution are lost."""
    attempted = _attempts(spark, sf_dir)
    spoiled = views.results(attempted).withColumn("decision_verifier_calls", F.when(F.col("task_id") % 3 != 0, F.col("decision_verifier_calls"))).withColumn("success", F.col("success") | (F.col("task_id") % 2 == 0))
    return integrity.result_consistency(spoiled, attempted, RESULT_KEYS)


@query(f"{CAND} select task_id, candidate_index from pool where task_id % 11 = 0")
def hash_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.pool(spark, sf_dir).withColumn("digest", scalars.sha256_hex(F.concat("code", F.when(F.col("task_id") % 11 == 0, "x").otherwise(""))))
    return integrity.hash_mismatches(own, "code", "digest")


@query(f"""{CAND}, grid as (select o_orderkey as task_id, unnest(range(0, 4)) as candidate_index from (select distinct o_orderkey from orders)), have as (select task_id, candidate_index, count(*) as n from cand group by all)
select coalesce(grid.task_id, have.task_id) as task_id, coalesce(grid.candidate_index, have.candidate_index) as candidate_index, case when n is null then 'missing' else 'unexpected' end as problem from grid full join have on grid.task_id = have.task_id and grid.candidate_index = have.candidate_index where n is null or grid.task_id is null""")
def pool_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.by_key(table(spark, sf_dir, "orders"), "o_orderkey", parts=views.parts_of(table(spark, sf_dir, "lineitem")))
    return integrity.incomplete_pool(views.candidates(spark, sf_dir), asked.select(F.col("o_orderkey").alias("task_id")), POOL_SIZE)


@query("with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as b, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as file_pos from lineitem) select l_orderkey, l_partkey, file_pos from l where b > l_partkey")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return integrity.out_of_order(table(spark, sf_dir, "lineitem").withColumn("file_pos", at), ["l_partkey"], "file_pos", ["l_orderkey"])


@query(f"""{CAND} select task_id, candidate_index, case when candidate_index = 3 then 'missing' when task_id % 5 = 0 then 'duplicate' when task_id % 7 = 0 then 'digest' end as problem from pool where candidate_index = 3 or task_id % 5 = 0 or task_id % 7 = 0
  union all select task_id, candidate_index, 'unknown' from cand where candidate_index = 4""")
def grade_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades that lack the fourth candidate, have a fifth, repeat every fifth task and spoil every seventh's digest."""
    own = views.pool(spark, sf_dir)
    digest = F.concat("code", F.when(F.col("task_id") % 7 == 0, "x").otherwise(""))
    grades = views.candidates(spark, sf_dir).where("candidate_index <> 3 and candidate_index < 5 and (n_candidates >= 4)").select("task_id", "candidate_index", digest.alias("code"))
    grades = grades.union(grades.where("task_id % 5 = 0 and candidate_index < 4"))
    return integrity.exact_cover(own, grades, ["task_id", "candidate_index"], "code")


@query(f"{CAND} select task_id, candidate_index, 'passed_status' as rule from pool where base_passed and task_id % 2 = 0 union all select task_id, candidate_index, 'feedback_counts' from pool where candidate_index = 1 union all select task_id, candidate_index, 'feedback_status' from pool where candidate_index = 2 and base_passed")
def grade_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = views.pool(spark, sf_dir).select(
        "task_id", "candidate_index", c("base_passed").alias("verification_passed"), F.when(c("base_passed") & (c("task_id") % 2 == 0), "fail").when(c("base_passed"), "pass").otherwise("fail").alias("status"),
        F.when(c("candidate_index") == 2, F.when(c("base_passed"), "other").otherwise("fail")).alias("feedback_status"),
        F.when(c("candidate_index") == 1, 1).alias("total_failed_inputs"), F.lit(2).alias("kept_failed_inputs"), F.lit(False).alias("feedback_truncated"),
    )
    return integrity.grade_rules(own, "base")


@query(f"{STEPS} select pool_id, task_id, candidate_index, 'parent_before' as rule from steps where depth > 0 and task_id % 3 = 0")
def step_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoiled = _steps(spark, sf_dir).withColumn("parent_candidate_index", F.when((F.col("depth") > 0) & (F.col("task_id") % 3 == 0), F.col("candidate_index")).otherwise(F.col("parent_candidate_index")))
    return integrity.step_lineage(spoiled)


@query(f"""{STEPS}, few as (select distinct task_id from cand), s as (select * from steps where pool_id = '2x2' and not (task_id % 4 = 0 and candidate_index = 0)), g as (select task_id, count(*) as n, min(candidate_index) as lo, max(candidate_index) as hi, count(*) filter (base_passed) as passes from s group by task_id)
select few.task_id, 'covered' as rule from few left join g on few.task_id = g.task_id where n is null union all select task_id, 'contiguous' from g where lo <> 0 or hi <> n - 1 union all select task_id, 'exhausted' from g where passes = 0 and n <> 4
union all select task_id, 'parent' from s where depth > 0 and task_id % 4 = 0 and candidate_index = 2""")
def trajectory_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth task lost its first step."""
    own = _steps(spark, sf_dir).where("pool_id = '2x2' and not (task_id % 4 = 0 and candidate_index = 0)")
    return integrity.trajectory_rules(own, views.candidates(spark, sf_dir), POOL_SIZE)


@query("select cast(n_nationkey as varchar) as pool_id, 'n_regionkey' as field from nation where n_regionkey <> (select n_regionkey from nation order by n_nationkey limit 1)")
def manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("pool_id"), "n_nationkey", "n_regionkey", F.lit(None).cast("string").alias("note"))
    return integrity.manifest_differences(own, ["n_regionkey", "note"], "n_nationkey")


@query(f"{CAND} select task_id, candidate_index, 'error_type' as field from pool where not base_passed and task_id % 6 = 0")
def base_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.pool(spark, sf_dir).withColumn("error_type", F.when(~F.col("base_passed"), "fail"))
    again = own.withColumn("error_type", F.when(F.col("task_id") % 6 != 0, F.col("error_type")))
    return integrity.base_recheck(own, again, ["base_passed", "error_type"])


@query(f"{OBS} select distinct task_id, k from obs where k = 2 and c_mark union all select task_id, k from obs where false".replace("c_mark", "correct_in_pool > 0 and task_id % 9 = 0"))
def selector_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selector's Pass@2 of every ninth task is spoiled where it is not 0."""
    bad = (F.col("selector_name") == "first_sample") & (F.col("k") == 2) & (F.col("task_id") % 9 == 0)
    return integrity.selectors_disagree(_observed(spark, sf_dir).withColumn("pass_at_k", F.when(bad, 0.0).otherwise(F.col("pass_at_k"))))


@query(f"{OBS} select distinct task_id, k, 'first_sample' as lacks from obs where task_id % 8 = 0")
def unpaired_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.unpaired(_observed(spark, sf_dir).where("not (selector_name = 'first_sample' and task_id % 8 = 0)"), "first_base_pass", "first_sample")


@query(_curve_sql("decision_tokens", "cumulative_tokens", "success") + ", m as (select *, case when budget % 50 = 49 then 0 else success_rate end as s from curve), b as (select *, coalesce(lag(s) over (partition by budget_name, policy_name order by budget), 0) as before from m) select budget_name, policy_name, budget, cast(s as double) as success_rate from b where s < before")
def falling_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoiled = success_by_tokens(spark, sf_dir).withColumn("success_rate", F.when(F.col("budget") % 50 == 49, 0.0).otherwise(F.col("success_rate")))
    return integrity.falling_curve(spoiled, ["budget_name", "policy_name"])


@query("select o_orderkey as task_id, 'unknown' as problem from orders where o_orderkey not in (select l_orderkey from lineitem)")
def unknown_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    asked = views.by_key(table(spark, sf_dir, "orders"), "o_orderkey", parts=views.parts_of(lines))
    known = views.by_key(lines, "l_orderkey")
    return integrity.unknown_tasks(asked.select(F.col("o_orderkey").alias("task_id")), known.select(F.col("l_orderkey").alias("task_id")))


# Task suites --------------------------------------------------------------------------------------------------------


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.with_split(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id")), "split-1")


@query("select distinct o_orderkey as task_id from orders where cast('0x' || substr(sha256('split-1' || cast(o_orderkey as varchar)), 1, 16) as ubigint) % 5 = 0 order by 1 limit 50 offset 10")
def task_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_slice(_suite(spark, sf_dir), "development", 10, 50)


@query("select task_id from (select distinct o_orderkey as task_id from orders) order by sha256('sample-1' || cast(task_id as varchar)) limit 100")
def hash_ordered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.hash_ordered_sample(_suite(spark, sf_dir), "sample-1", 100)


@query("select event_id, cast(user_id as varchar) as run, event_type as policy, 'full' as budget from events")
def annotated_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts whose metadata gets the run's values; the run's policy replaces the one that was there."""
    own = table(spark, sf_dir, "events").withColumn("metadata", F.create_map(F.lit("run"), F.col("user_id").cast("string"), F.lit("policy"), F.lit("old")))
    done = tasks.annotated(own, "metadata", {"policy": F.col("event_type"), "budget": F.lit("full")})
    return done.select("event_id", *[F.col("metadata")[k].alias(k) for k in ("run", "policy", "budget")])


@query("""with s as (select event_id, event_type as policy, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as call from events)
select event_id, case when call = 0 then 'return wrong' else 'return right' end as reply from s""")
def scripted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scripted provider's replies, call by call, the last one again and again."""
    from trialspark.plans.studies import scripted

    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    calls = table(spark, sf_dir, "events").select("event_id", F.lit("best_of_n").alias("policy"), nth.alias("call"))
    return scripted(calls, 100).select("event_id", "reply")


@query(f"{CAND} select task_id, candidate_index, base_passed, total_tokens, code, row_number() over (order by task_id, candidate_index) - 1 as line from pool")
def published_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool published as a bundle in many parts, read back through its manifest, with the place of each row over all parts."""
    folder = new_path(spark, "bundle")
    pool = views.pool(spark, sf_dir).select("task_id", "candidate_index", "base_passed", "total_tokens", "code")
    bundles.publish(spark, folder, {"candidates": (pool, ["task_id", "candidate_index"])}, {"pool": "published"}, files=8)
    schema = "task_id long, candidate_index long, base_passed boolean, total_tokens long, code string"
    rows = bundles.read_ordered(spark, folder, "candidates", schema)
    return rows.select("task_id", "candidate_index", "base_passed", "total_tokens", "code", "line")


@query(f"""{CAND}, t as (select distinct task_id from pool)
select cast(null as varchar) as task_id, cast(null as bigint) as candidate_index, 'dataset_hash' as rule from t where task_id % 6 = 0 and task_id % 4 <> 0
union all select cast(task_id as varchar), null, 'tasks' from t where task_id % 4 = 0 union all select cast(task_id as varchar), null, 'count' from t where task_id % 5 = 0 and task_id % 4 <> 0
union all select cast(task_id as varchar), candidate_index, 'digest' from pool where task_id % 7 = 0 and task_id % 4 <> 0 and candidate_index = 1""")
def evaluator_row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluator output that lost every fourth task, the last row of every fifth, the second code of every seventh, and some hashes."""
    task = F.col("task_id")
    keep = (task % 4 != 0) & ~((task % 5 == 0) & (F.col("candidate_index") == POOL_SIZE - 1))
    own = graded.with_digest(views.pool(spark, sf_dir))
    solution = F.when((task % 7 == 0) & (F.col("candidate_index") == 1), "other").otherwise(F.col("code"))
    entries = own.where(keep).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("candidate_index", solution.alias("solution")))), lambda x: F.struct(x["solution"].alias("solution"))).alias("entries"))
    named = F.struct(F.when(task % 6 != 0, "hash").alias("hash"), F.map_from_arrays(F.array(task.cast("string")), F.array("entries")).alias("eval"))
    return integrity.evaluator_rows(entries.select(F.to_json(named).alias("json")), "json", own)


@query("""select cast(user_id as varchar) as run, count(*) as attempts_logged, array_to_string(list_filter([case when arg_min(event_id, event_id) % 3 = 0 then 'model_id' end, case when arg_min(event_id, event_id) % 5 = 0 then 'total_tokens' end], lambda x: x is not null), ',') as missing_fields,
  min(event_id) % 5 <> 0 and min(event_id) % 7 <> 0 as token_accounting_ok, min(event_id) % 2 = 0 as budget_name_present from events group by user_id""")
def first_attempt_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check of each user's first event, as a logged attempt that may lack fields, add up wrong or name no budget."""
    e = F.col("event_id")
    of = {
        "model_id": F.when(e % 3 != 0, "m"), "policy_name": F.col("event_type"), "operator_name": F.lit("sample"), "input_tokens": e, "output_tokens": F.lit(2),
        "total_tokens": F.when(e % 5 != 0, e + 2 + F.when(e % 7 == 0, 1).otherwise(0)), "verification_passed": F.lit(True), "cumulative_tokens": e, "cumulative_verifier_calls": F.lit(1),
        "metadata": F.when(e % 4 == 0, F.struct(F.lit("b").alias("budget_name"))), "result_metadata": F.when(e % 4 == 2, F.struct(F.lit("b").alias("budget_name"))),
    }
    record = F.parse_json(F.to_json(F.struct(*[v.alias(n) for n, v in of.items()])))
    logged = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), e.alias("line"), record.alias("record"))
    return integrity.first_attempts(logged).withColumn("missing_fields", F.array_join("missing_fields", ","))


@query("select l_orderkey as task_id, l_linenumber as candidate_index, case when l_orderkey % 3 <> 0 then case when l_orderkey % 2 = 0 then 'dev' else 'test' end end as task_split, cast(l_linenumber as double) / 10 as temperature from lineitem")
def candidate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as candidates with their order's split, where it has one, and the temperature that was asked for."""
    lines_ = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("candidate_index"), F.struct((F.col("l_linenumber") / 10).alias("temperature")).alias("sampling"))
    known = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderkey") % 2 == 0, "dev").otherwise("test").alias("split"))
    return tasks.candidate_metadata(lines_, known).select("task_id", "candidate_index", "metadata.task_split", F.col("metadata.requested_sampling.temperature").alias("temperature"))


@query("select l_orderkey * 10 + l_linenumber as shard, '--read-only' as flag, count(*) as n from lineitem where l_returnflag = 'R' group by all union all select l_orderkey * 10 + l_linenumber, '--network=none', count(*) from lineitem where l_linestatus = 'O' group by all")
def sandbox_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container commands that lack a required flag."""
    words = F.array_compact(F.array(F.lit("run"), F.when(F.col("l_returnflag") != "R", "--read-only"), F.when(F.col("l_linestatus") != "O", "--network=none")))
    commands = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("shard"), words.alias("command"))
    return integrity.sandbox_flags(commands, ["--read-only", "--network=none"]).groupBy("shard", "flag").agg(F.count("*").alias("n"))
