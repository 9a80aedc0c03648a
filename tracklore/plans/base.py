"""Runs, steps and scored rows made from the driver's tables, in SQL that Spark and DuckDB read alike.

The tables hold no agent logs, so actions and observations are spelled out of keys: lineitem rows are the steps of short
runs (one per order), events those of long runs (one per user).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.session import ready

ORDER_ACTION = """CASE l_partkey % 7 WHEN 0 THEN concat('python  run_', l_suppkey % 3, '.py') WHEN 1 THEN concat('pytest tests/test_', l_suppkey % 2, '.py')
 WHEN 2 THEN concat('edit ', l_suppkey % 50, ':', l_suppkey % 50 + 5) WHEN 3 THEN concat('open /src/mod_', l_suppkey % 4, '.py')
 WHEN 4 THEN concat('str_replace_editor str_replace /src/f', l_suppkey % 2, '.py') WHEN 5 THEN 'ls -la' ELSE 'submit' END"""
ORDER_SEEN = """CASE l_partkey % 7 WHEN 0 THEN concat('Traceback (most recent call last)', chr(10), 'ValueError: bad value ', l_partkey)
 WHEN 1 THEN concat(l_partkey % 4, ' passed, ', l_suppkey % 3, ' failed in 1s') WHEN 2 THEN 'File updated' WHEN 3 THEN concat('12: x', chr(10), '[File: mod]')
 WHEN 4 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'No replacement was performed' ELSE 'The file has been edited' END WHEN 5 THEN 'fatal: not a repository' ELSE '' END"""
EVENT_ACTION = """CASE event_type WHEN 'click' THEN 'python run.py' WHEN 'purchase' THEN 'python run.py' WHEN 'error' THEN 'pytest -q'
 WHEN 'view' THEN 'open src/a.py' ELSE concat('edit ', CAST(floor(value) AS INT) % 3 * 10, ':99') END"""
EVENT_SEEN = """CASE event_type WHEN 'click' THEN 'done' WHEN 'purchase' THEN concat('ValueError: code ', CAST(floor(value) AS INT) % 2) WHEN 'error' THEN concat(CAST(floor(value) AS INT) % 4, ' passed, ', CAST(floor(value) AS INT) % 3, ' failed')
 WHEN 'view' THEN 'text' ELSE CASE WHEN value > 15 THEN 'No replacement was performed' ELSE 'File updated' END END"""
#: Steps of both kinds of runs: run, i (from 1), action, observation.
ORDER_STEPS = f"SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, {ORDER_ACTION} AS action, {ORDER_SEEN} AS observation FROM lineitem"
EVENT_STEPS = f"SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {EVENT_ACTION} AS action, {EVENT_SEEN} AS observation FROM events"
ORDER_RUNS = "SELECT o_orderkey AS run, concat('task', o_custkey) AS task_id, o_orderpriority AS policy_model, o_orderstatus = 'F' AS outcome, concat('owner', o_custkey % 41, '/repo', o_custkey) AS repo FROM orders"
#: A score in (0, 1) and a label for documents, from their length and labels.
SCORED_DOCS = "SELECT l.doc_id, d.source, d.lang, l.toxic, l.quality, (d.n_chars % 997) / 1e3 + 5e-4 AS p, (l.doc_id % 100) / 1e2 AS frac FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A statement over the named tables."""
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, ORDER_STEPS, "lineitem")


def _gather(steps: DataFrame) -> DataFrame:
    s = F.struct("i", "action", "observation", F.lit(None).cast("string").alias("thought"), F.lit("{}").alias("extra"))
    sorted_ = F.array_sort(F.collect_list(s))
    return steps.groupBy("run").agg(F.transform(sorted_, lambda x: x.dropFields("i")).alias("steps"))


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with steps: traj_id, run, task_id, policy_model, outcome, repo_or_site, task, steps."""
    runs = sql(spark, sf_dir, ORDER_RUNS, "orders")
    d = _gather(order_steps(spark, sf_dir)).join(runs, "run")
    return d.select(
        F.concat(F.lit("run"), F.col("run").cast("string")).alias("traj_id"), "run", "task_id", "policy_model", "outcome", F.col("repo").alias("repo_or_site"), F.lit("swe").alias("domain"), F.lit("demo").alias("scaffold"),
        F.concat(F.lit("Fix the bug of "), "task_id").alias("task"), "steps",
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gather(sql(spark, sf_dir, EVENT_STEPS, "events"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sql(spark, sf_dir, SCORED_DOCS, "labels", "documents")
    return d.withColumns({"p": F.col("p").cast("double"), "frac": F.col("frac").cast("double")})
