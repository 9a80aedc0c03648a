"""Ordered jobs over tables: relabel, check, baselines, report."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.operators import features, labels, metrics, stats
from tracklore.sources import files

Job = tuple[str, Callable[[], object]]


def run(jobs: list[Job], tell: Callable[[str], None] = print) -> dict[str, object]:
    """What each job returns, in order. A job that fails ends the run: its name is told and its error raised."""
    out: dict[str, object] = {}
    for name, job in jobs:
        t = time.time()
        try:
            out[name] = job()
        except Exception:
            tell(f"{name}: failed after {time.time() - t:.0f} s")
            raise
        tell(f"{name}: done in {time.time() - t:.0f} s")
    tell("all jobs done")
    return out


def relabel(spark: SparkSession, runs: DataFrame, path: str) -> dict[str, int]:
    """Labels of the records published at `path` made again from the runs; the new version takes the old one's place at
    once. Changed labels per question."""
    records = files.read_published(spark, path)
    d = labels.derive(labels.with_policy_rate(labels.with_task_stats(runs)))
    made = labels.label_prefixes(records.select("id", "traj_id", "prefix_len", "n_steps").join(d.drop("n_steps"), "traj_id"))
    fresh, changed = labels.relabel(records, made)
    files.publish(fresh, path)
    return changed.first().asDict()


def quality(records: DataFrame) -> DataFrame:
    return stats.rules_fired(records).unionByName(stats.top_progress_rules(records).select(F.concat_ws(" ", F.lit("progress"), "progress", "rule").alias("rule"), "n"))


def baselines(train: DataFrame, test: DataFrame, label: str = "p_success") -> DataFrame:
    """(baseline, metrics of the test rows) of the prior, two mapped scores and boosted trees; rows have features_by_name."""
    y = F.col(label).cast("double")
    train, test = (features.feature_vector(d.withColumn("_y", y)) for d in (train, test))
    scores = features.heuristic_scores()
    out = []
    for name in ("few_steps", "tests_pass"):
        model = features.platt(train.withColumn("_s", scores[name]), "_s", "_y")
        out.append((name, features.predict(model, test.withColumn("_s", scores[name]))))
    out += [("boosted", features.predict(features.boosted(train, "_y"), test)), ("prior", test.withColumn("p", F.lit(features.prior(train, "_y"))))]
    made = [metrics.binary_report(d.withColumn("_y", F.col("_y").cast("int")), "_y", "p").select(F.lit(name).alias("baseline"), "*") for name, d in out]
    done = made[0]
    for d in made[1:]:
        done = done.unionByName(d)
    return done


def chain(spark: SparkSession, runs: DataFrame, path: str, report_path: str, tell: Callable[[str], None] = print) -> dict[str, object]:
    """Relabel, label checks and the report of a published record table, in this order."""
    return run(
        [
            ("relabel", lambda: relabel(spark, runs, path)),
            ("label checks", lambda: quality(files.read_published(spark, path)).collect()),
            ("report", lambda: files.write_text(spark, report_path, files.report_markdown("Labels", stats.label_histogram(files.read_published(spark, path), list(labels.LABELS)).orderBy("question", "label")))),
        ],
        tell,
    )
