"""The canonical search tables, derived from the given tables.

Public and hidden columns are separate tables from the start: a selector is handed a public table only, and labels are
joined by task and candidate after it has chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POOL_SIZE = 4
KS = (1, 2, 4)
#: The second budget of results: so many attempts at most.
TIGHT_ATTEMPTS = 4
#: Bytes of an input's files that a partition by key takes, about.
PARTITION_BYTES = 2**21
DECISION_POLICY, BASELINES = "purchase", ("view", "click", "signup", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(rows: DataFrame) -> int:
    """The partitions that by_key() deals rows to."""
    size = int(rows._jdf.queryExecution().analyzed().collectLeaves().head().stats().sizeInBytes())
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))


def by_key(rows: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """rows dealt by keys to partitions whose number grows with the size of their files, so that a task's rows do not.

    Groups and windows by keys or more columns, and joins by just keys, need no other shuffle; joins by more columns do.
    Tables that meet are dealt to the same number of parts.
    """
    return rows.repartition(parts or parts_of(rows), *keys)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a candidate of its order, numbered in the fixed order, with public and hidden columns."""
    order = Window.partitionBy("task_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    base = F.col("l_returnflag") != "R"
    # named before the windows, so that what is asked of a task is asked of the lines in the files
    lines = by_key(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumnRenamed("l_orderkey", "task_id").select(
        "task_id",
        (F.row_number().over(order) - 1).cast("long").alias("candidate_index"),
        F.count("*").over(Window.partitionBy("task_id")).alias("n_candidates"),
        base.alias("base_passed"),
        (base & (F.col("l_linestatus") == "F")).alias("plus_passed"),
        F.col("l_quantity").cast("long").alias("input_tokens"),
        (F.floor("l_extendedprice").cast("long") % 256 + 1).alias("output_tokens"),
        F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("code"),
        F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("trace"),
    )
    return lines.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first POOL_SIZE candidates of tasks that have as many, public columns only."""
    full = candidates(spark, sf_dir).where((F.col("n_candidates") >= POOL_SIZE) & (F.col("candidate_index") < POOL_SIZE))
    return full.drop("plus_passed", "n_candidates")


def pool_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hidden grades of pool()."""
    full = candidates(spark, sf_dir).where((F.col("n_candidates") >= POOL_SIZE) & (F.col("candidate_index") < POOL_SIZE))
    return full.select("task_id", "candidate_index", "plus_passed")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an attempt of (user, type): (task_id, policy_name, budget_name, attempt_index, ...), under two budgets."""
    own = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    until = own.rowsBetween(Window.unboundedPreceding, 0)
    tokens, passed = F.floor("value").cast("long") + 1, F.col("value") >= 40
    latency = (F.col("event_id") * 37 % 5000 + 1).cast("long")
    one = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"),
        F.col("event_type").alias("policy_name"),
        "event_id",
        (F.row_number().over(own) - 1).cast("long").alias("attempt_index"),
        tokens.alias("total_tokens"),
        F.sum(tokens).over(until).alias("cumulative_tokens"),
        F.row_number().over(own).cast("long").alias("cumulative_verifier_calls"),
        latency.alias("latency_ms"),
        F.sum(latency).over(until).alias("cumulative_ms"),
        passed.alias("verification_passed"),
        (F.sum(passed.cast("long")).over(until) - passed.cast("long") == 0).alias("none_before"),
        (F.col("event_id") % 3 != 0).alias("hidden_passed"),
    )
    one = one.withColumn("selected", F.col("verification_passed") & F.col("none_before")).drop("none_before")
    budgets = F.explode(F.when(F.col("attempt_index") < TIGHT_ATTEMPTS, F.array(F.lit("full"), F.lit("tight"))).otherwise(F.array(F.lit("full"))))
    return one.select("task_id", "policy_name", budgets.alias("budget_name"), *[c for c in one.columns if c not in ("task_id", "policy_name")])


def results(attempted: DataFrame) -> DataFrame:
    """One row a result: the selected attempt's costs are decision costs, null without a selection."""
    on = lambda c: F.max(F.when(F.col("selected"), F.col(c)))
    passing = F.col("verification_passed") & F.col("hidden_passed")
    return attempted.groupBy("task_id", "policy_name", "budget_name").agg(
        F.bool_or("selected").alias("success"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count("*").alias("total_verifier_calls"),
        on("cumulative_tokens").alias("decision_tokens"),
        on("cumulative_verifier_calls").alias("decision_verifier_calls"),
        F.sum("latency_ms").alias("total_ms"),
        on("cumulative_ms").alias("decision_ms"),
        F.coalesce(F.bool_or(F.col("selected") & passing), F.lit(False)).alias("hidden_success"),
        F.bool_or(passing).alias("oracle_hidden_success"),
        F.min(F.when(passing, F.col("cumulative_tokens"))).alias("oracle_hidden_tokens"),
        F.min(F.when(passing, F.col("cumulative_verifier_calls"))).alias("oracle_hidden_calls"),
        F.min(F.when(passing, F.col("cumulative_ms"))).alias("oracle_hidden_ms"),
        F.sum(passing.cast("long")).alias("hidden_correct"),
    )


#: DuckDB forms of the tables above, as a WITH list.
CAND_SQL = """
cand as (select l_orderkey as task_id,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as candidate_index,
    count(*) over (partition by l_orderkey) as n_candidates,
    l_returnflag <> 'R' as base_passed, l_returnflag <> 'R' and l_linestatus = 'F' as plus_passed,
    cast(l_quantity as bigint) as input_tokens, cast(floor(l_extendedprice) as bigint) % 256 + 1 as output_tokens,
    cast(l_quantity as bigint) + cast(floor(l_extendedprice) as bigint) % 256 + 1 as total_tokens,
    cast(l_partkey as varchar) || ':' || cast(l_suppkey as varchar) as code,
    [l_returnflag, l_linestatus, cast(l_linenumber as varchar)] as trace
  from lineitem),
pool as (select * from cand where n_candidates >= 4 and candidate_index < 4)"""
ATTEMPTS_SQL = """
one as (select user_id as task_id, event_type as policy_name, event_id,
    row_number() over w - 1 as attempt_index, cast(floor(value) as bigint) + 1 as total_tokens,
    cast(sum(cast(floor(value) as bigint) + 1) over (w rows between unbounded preceding and current row) as bigint) as cumulative_tokens,
    row_number() over w as cumulative_verifier_calls, cast(event_id * 37 % 5000 + 1 as bigint) as latency_ms,
    cast(sum(event_id * 37 % 5000 + 1) over (w rows between unbounded preceding and current row) as bigint) as cumulative_ms, value >= 40 as verification_passed,
    value >= 40 and coalesce(max(case when value >= 40 then 1 else 0 end) over (w rows between unbounded preceding and 1 preceding), 0) = 0 as selected,
    event_id % 3 <> 0 as hidden_passed
  from events window w as (partition by user_id, event_type order by ts, event_id)),
attempts as (select *, 'full' as budget_name from one union all select *, 'tight' as budget_name from one where attempt_index < 4),
results as (select task_id, policy_name, budget_name, bool_or(selected) as success,
    cast(sum(total_tokens) as bigint) as total_tokens, count(*) as total_verifier_calls,
    max(case when selected then cumulative_tokens end) as decision_tokens,
    max(case when selected then cumulative_verifier_calls end) as decision_verifier_calls,
    cast(sum(latency_ms) as bigint) as total_ms, max(case when selected then cumulative_ms end) as decision_ms,
    min(case when verification_passed and hidden_passed then cumulative_ms end) as oracle_hidden_ms,
    bool_or(selected and hidden_passed) as hidden_success, bool_or(verification_passed and hidden_passed) as oracle_hidden_success,
    min(case when verification_passed and hidden_passed then cumulative_tokens end) as oracle_hidden_tokens,
    min(case when verification_passed and hidden_passed then cumulative_verifier_calls end) as oracle_hidden_calls,
    cast(sum(case when verification_passed and hidden_passed then 1 else 0 end) as bigint) as hidden_correct
  from attempts group by task_id, policy_name, budget_name)"""
