"""Profiles, counts and checks over trajectories and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.operators.metrics import running


def task_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("outcome").cast("int")).alias("n_success"))


def policy_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("policy_model").agg(F.avg(F.col("outcome").cast("int")).alias("policy_rate"))


def profile(df: DataFrame) -> DataFrame:
    """One row: runs, pass rate, steps (mean, median, most; means by outcome), distinct repositories, thought share.
    df: outcome, n_steps, repo, has_thought."""
    won = F.col("outcome")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(won.cast("int")).alias("success_rate"), F.avg("n_steps").alias("steps_mean"), F.percentile("n_steps", F.lit(0.5)).alias("steps_median"), F.max("n_steps").alias("steps_max"),
        F.avg(F.when(won, F.col("n_steps"))).alias("steps_mean_success"), F.avg(F.when(~won, F.col("n_steps"))).alias("steps_mean_failure"), F.count_distinct("repo").alias("n_repos"), F.avg(F.col("has_thought").cast("int")).alias("thought_share"),
    )


def mixed_tasks(df: DataFrame) -> DataFrame:
    """One row: tasks, tasks with both outcomes, and their share."""
    per = df.groupBy("task_id").agg(F.bool_or("outcome").alias("some"), F.bool_and("outcome").alias("every"))
    mixed = F.sum((F.col("some") & ~F.col("every")).cast("int"))
    return per.agg(F.count(F.lit(1)).alias("n_tasks"), mixed.alias("n_mixed"), (mixed / F.count(F.lit(1))).alias("mixed_share"))


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, key: str, k: int = 12) -> DataFrame:
    """The k most frequent values; ties in order of the value."""
    return frequency(df, key).orderBy(F.desc("n"), key).limit(k)


def label_histogram(df: DataFrame, labels: list[str]) -> DataFrame:
    """(question, label, n) of the labels that are not masked."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("question"), F.col(c).cast("string").alias("label")) for c in labels])).alias("x")).select("x.*")
    return long.where("label IS NOT NULL").groupBy("question", "label").agg(F.count(F.lit(1)).alias("n"))


def rank_percentiles(df: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """One row: the value at index int(p * n) of the sorted values for each p, and the largest.

    Exact without a global sort on one task: counts per value first, then running sums over ranges of values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n")).withColumn("_one", F.lit(1))
    run = running(counts, [], "v", ["c"]).withColumn("_one", F.lit(1)).join(total, "_one")
    pick = [F.min(F.when(F.col("upto_c") > F.floor(F.lit(p) * F.col("n")), F.col("v"))).alias(f"p{round(p * 100)}") for p in ps]
    return run.agg(*pick, F.max("v").alias("max"))


def split_stats(df: DataFrame, questions: list[str]) -> DataFrame:
    """Per split: records, positive rate, records with each question, tokens, distinct trajectories."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.avg(F.col("p_success").cast("int")).alias("positive_rate"), *[F.count(q).alias(f"has_{q}") for q in questions],
        F.sum("state_tokens").alias("tokens"), F.count_distinct("traj_id").alias("trajectories"),
    )


def prefix_bucket(frac: Column) -> Column:
    return F.least(F.lit(3), F.floor(frac * 4)).cast("int")


def success_by_bucket(df: DataFrame) -> DataFrame:
    return df.groupBy(prefix_bucket(F.col("prefix_frac")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p_success").cast("int")).alias("success_rate"))


def rules_fired(df: DataFrame) -> DataFrame:
    """(rule, n): the stuck rules that fired, without their counts."""
    return df.select(F.explode("stuck_reasons").alias("r")).groupBy(F.substring_index("r", " x", 1).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def top_progress_rules(df: DataFrame, k: int = 8) -> DataFrame:
    """Per progress level the k most frequent rules, named by their first two words; ties in order of the rule."""
    per = df.groupBy("progress", F.substring_index("progress_reason", " ", 2).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("progress").orderBy(F.desc("n"), "rule")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pattern_balance(df: DataFrame, text: str, label: str, patterns: dict[str, str]) -> DataFrame:
    """Per label: rows and, for each pattern, the rows whose text has it: a leak shows as unequal shares."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(text).rlike(p)).alias(k) for k, p in patterns.items()])


def split_overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(split_a, split_b, n): keys that two splits share. One pass: the set of splits of each key, then its pairs."""
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode(F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a AS split_a, b AS split_b))))")).alias("p")).select("p.*")
    return pairs.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n"))


def assert_held_out(df: DataFrame, held: DataFrame, key: str, split: str = "split", name: str = "verified_holdout") -> int:
    """Rows of held-out keys outside their split; raises if there are any."""
    n = df.where(F.col(split) != name).join(held.select(key).distinct(), key, "left_semi").count()
    if n:
        raise ValueError(f"{n} rows of held-out keys are in other splits")
    return n
