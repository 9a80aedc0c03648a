"""Scored rows against records: joins, fresh labels, and reports per question, raw and calibrated.

Scored rows: id, group, question, type, variant, keys, label, p (see files.SCORED). Records: id, with labels as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions.arrays import argmax, temper, yes_index
from tracklore.operators import calibration, metrics

QUESTION_TYPES = {"p_success": "noul", "stuck": "noul", "escalate": "noul", "progress": "score", "steps_left": "score", "best_next": "choice"}


def clean(rows: DataFrame, variant: str = "clean") -> DataFrame:
    """Rows of one variant; null counts as clean."""
    return rows.where(F.coalesce("variant", F.lit("clean")) == variant)


def with_record(rows: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Scored rows with the given columns of their records; rows without a record are left out."""
    return rows.join(records.select("id", *columns), "id")


def known_rows(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Clean rows whose id is among the records."""
    return clean(rows).join(records.select("id"), "id", "left_semi")


def long_labels(records: DataFrame, questions: list[str]) -> DataFrame:
    """(id, question, said): the labels of records, one row each, masked ones left out. said is text: true or false, a
    level, or an option's key."""
    cells = [F.struct(F.lit(q).alias("question"), F.col(q).cast("string").alias("said")) for q in questions]
    return records.select("id", F.inline(F.array(*cells))).where("said IS NOT NULL")


def with_fresh_labels(rows: DataFrame, records: DataFrame, questions: list[str]) -> DataFrame:
    """Scored rows with the labels that the records have now; rows whose question is masked there are left out.

    A yes/no label becomes the place of true or false among the lower-cased keys, a level its number, an option the place
    of its key; an option that is not among the keys leaves the label as it was."""
    new = rows.join(long_labels(records, questions), ["id", "question"])
    place = lambda keys, x: F.nullif(F.array_position(keys, x), F.lit(0)) - 1
    low = F.transform("keys", lambda k: F.lower(k))
    label = F.when(F.col("type") == "noul", place(low, F.lower("said"))).when(F.col("type") == "choice", F.coalesce(place(F.col("keys"), F.col("said")), F.col("label"))).otherwise(F.col("said").try_cast("int"))
    return new.withColumn("label", label.cast("int")).drop("said")


def binary_view(rows: DataFrame, p: str = "p") -> DataFrame:
    """Yes/no rows with y and q, the label and the probability of yes."""
    yes = yes_index(F.col("keys"))
    return rows.where("type = 'noul'").withColumns({"y": (F.col("label") == yes).cast("int"), "q": F.element_at(p, yes + 1)})


def _long(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, value) of a wide report."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c not in by]
    return df.select(*by, F.inline(F.array(*cells)))


def reports(rows: DataFrame, p: str = "p", extra: list[str] | None = None) -> DataFrame:
    """(question, extra..., metric, value): the report of each question by its type."""
    by = ["question", *(extra or [])]
    parts = [
        metrics.binary_report(binary_view(rows, p), "y", "q", by), metrics.ordinal_report(rows.where("type = 'score'"), "label", p, by),
        rows.where("type = 'choice'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((argmax(F.col(p)) == F.col("label")).cast("int")).alias("top1"), F.avg(F.size(p)).alias("k_mean"), _nll(p).alias("nll")),
    ]
    out = _long(parts[0], by)
    for part in parts[1:]:
        out = out.unionByName(_long(part, by))
    return out


def _nll(p: str) -> Column:
    return -F.avg(F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-9), F.element_at(p, F.col("label") + 1)))))


def raw_and_calibrated(dev: DataFrame, test: DataFrame, least_rows: int = 50) -> DataFrame:
    """(question, metric, raw, calibrated, temperature) on test rows, with temperatures fitted on dev rows. Questions with
    fewer dev rows than `least_rows`, or without test rows, are left out."""
    temps = calibration.fit_temperatures(dev, "question", "p", "label", least_rows=least_rows)
    d = test.join(temps.select("question", "temperature"), "question")
    d = d.withColumns({"raw": temper(F.col("p"), 1.0), "calibrated": temper(F.col("p"), F.col("temperature"))})
    sides = [reports(d, c).withColumnRenamed("value", c) for c in ("raw", "calibrated")]
    return sides[0].join(sides[1], ["question", "metric"]).join(temps.select("question", "temperature"), "question")


def keep_questions(records: DataFrame, keep: list[str], questions: tuple[str, ...] = tuple(QUESTION_TYPES)) -> DataFrame:
    """Records with the labels of the kept questions only; other questions' columns go, other columns stay."""
    return records.select(*[c for c in records.columns if c not in questions or c in keep])


def mask_question(records: DataFrame, question: str, domain: str) -> DataFrame:
    """The question's label is null in one domain's records."""
    return records.withColumn(question, F.when(~F.col("domain").eqNullSafe(domain), F.col(question)))
