"""Ranking, calibration and operating-point aggregates over scored rows.

Each takes a table with a 0/1 label and a probability and groups by `by` (none: one row for all), so many questions or
slices are one job. Ranks come from counts per distinct score, so ties are exact, and running sums over them are taken in
ranges of scores, see `running`: no task holds all of them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions.arrays import argmax, expected_level, total
from tracklore.operators.bootstrap import grouped_bootstrap  # noqa: F401


def _by(by: list[str] | None) -> list[str]:
    return list(by or [])


RANGES = 256


def running(df: DataFrame, by: list[str], order: str, values: list[str], falling: bool = False) -> DataFrame:
    """Adds upto_<value> for each value: its sum over the group's rows up to this one in order. `order` has distinct values
    in a group.

    Rows are dealt by quantiles of `order` (a list of fixed size on the driver); sums of whole ranges are added to sums
    within a range."""
    ends = sorted(set(df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [i / RANGES for i in range(1, RANGES)], 0.002)))
    ends = [e for e in ends if math.isfinite(e)]
    df = df.withColumn("_o", F.col(order).cast("double"))
    if ends:
        df = Bucketizer(splits=[-math.inf, *ends, math.inf], inputCol="_o", outputCol="_range", handleInvalid="keep").transform(df)
    else:
        df = df.withColumn("_range", F.lit(0.0))
    turn = F.desc if falling else F.asc
    sums = df.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_from_{v}") for v in values])
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    w = Window.partitionBy(*by, "_range").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"_in_{v}": F.sum(v).over(w) for v in values}).join(sums, same)
    return out.withColumns({f"upto_{v}": F.col(f"_from_{v}") + F.col(f"_in_{v}") for v in values}).drop("_o", "_range", "_at", *[f"_by{i}" for i in range(len(by))], *[f"_{x}_{v}" for v in values for x in ("from", "in")])


def auroc(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties half; null if a class is missing."""
    by = _by(by)
    c = df.groupBy(*by, F.col(p).alias("_p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    won = F.sum(F.col("pos") * (F.col("upto_neg") - F.col("neg") * F.lit(0.5)))
    return running(c, by, "_p", ["neg"]).groupBy(*by).agg((won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)).cast("double")).alias("auroc"))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def nll(y: Column, p: Column, eps: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg(((p >= 0.5).cast("int") == y).cast("int"))


def confident_error(y: Column, p: Column, threshold: float = 0.9) -> Column:
    return F.avg(((F.greatest(p, 1 - p) >= threshold) & ((p >= 0.5).cast("int") != y)).cast("int"))


def bin_of(p: Column, bins: int) -> Column:
    """Bin from 0 by the edges i / bins as doubles; the last bin is closed."""
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0, 1, bins + 1)])
    return F.least(F.lit(bins - 1), F.size(F.filter(edges, lambda e: e <= p)) - 1)


def _binned(df: DataFrame, y: str, p: str, bins: int, by: list[str]) -> DataFrame:
    return df.groupBy(*by, bin_of(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def ece(df: DataFrame, y: str, p: str, bins: int = 15, by: list[str] | None = None) -> DataFrame:
    by = _by(by)
    b = _binned(df, y, p, bins, by)
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias(f"ece{bins}"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 15) -> DataFrame:
    """bin, n, confidence, accuracy; empty bins have n = 0 and nulls."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(_binned(df, y, p, bins, []), "bin", "left")
    return out.select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "confidence", "accuracy")


def recall_at_fpr(df: DataFrame, y_fail: str, score: str, fpr: float, by: list[str] | None = None) -> DataFrame:
    """Threshold that flags at most a share `fpr` of the successes (y_fail = 0), and recall, precision and fired share of
    score > threshold. All null without a success; the threshold is minus infinity if the budget covers them all."""
    by = _by(by)
    s, y = F.col(score), F.col(y_fail)
    c = df.groupBy(*by, s.alias("_s")).agg(F.sum(1 - y.cast("long")).alias("ok"), F.sum(y.cast("long")).alias("bad"))
    c = running(c, by, "_s", ["ok", "bad"], falling=True)
    # rows come from the highest score down: the threshold is the first that would flag one success too many
    total = c.groupBy(*by).agg(F.sum("ok").alias("n_ok"), F.sum("bad").alias("n_bad")).withColumn("k", F.floor(F.lit(fpr) * F.col("n_ok")))
    one = [] if by else ["_one"]  # without groups all rows meet the one row of totals
    c = c.withColumns(dict.fromkeys(one, F.lit(1))).join(total.withColumns(dict.fromkeys(one, F.lit(1))), by or one)
    first = F.max_by(F.struct("_s", (F.col("upto_ok") - F.col("ok")).alias("ok"), (F.col("upto_bad") - F.col("bad")).alias("bad")), F.when((F.col("ok") > 0) & (F.col("upto_ok") >= F.col("k") + 1), F.col("_s")))
    d = c.groupBy(*by).agg(first.alias("t"), *[F.max(x).alias(x) for x in ("n_ok", "n_bad", "k")])
    whole = F.col("k") >= F.col("n_ok")  # the budget covers all successes
    known = F.col("n_ok") > 0
    tp, fp = F.when(whole, F.col("n_bad")).otherwise(F.col("t.bad")), F.when(whole, F.col("n_ok")).otherwise(F.col("t.ok"))
    return d.select(
        *by, F.when(known, tp / F.greatest(F.lit(1), "n_bad")).alias("recall"), F.when(known, tp / F.greatest(F.lit(1), tp + fp)).alias("precision"), F.when(known, (tp + fp) / (F.col("n_ok") + F.col("n_bad"))).alias("fired"),
        F.when(known, F.when(whole, F.lit(-math.inf)).otherwise(F.col("t._s"))).alias("threshold"),
    )


def binary_report(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """n, positive_rate, auroc, accuracy, brier, nll, ece15, confident_error."""
    by = _by(by)
    yc, pc = F.col(y), F.col(p)
    flat = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(yc.cast("double")).alias("positive_rate"), accuracy(yc, pc).alias("accuracy"), brier(yc, pc).alias("brier"), nll(yc, pc).alias("nll"), confident_error(yc, pc).alias("confident_error"))
    parts = [auroc(df, y, p, by), ece(df, y, p, 15, by)]
    if by:
        return flat.join(parts[0], by).join(parts[1], by)
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(flat).join(one(parts[0]), "_k").join(one(parts[1]), "_k").drop("_k")


def ordinal_report(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, mae of the expected level, rps, within_one over arrays of level probabilities."""
    by = _by(by)
    yc, pc = F.col(y), F.col(p)
    pred = argmax(pc)
    below = F.transform(pc, lambda x, i: total(F.slice(pc, F.lit(1), i + 1)) - F.when(i >= yc, 1.0).otherwise(0.0))
    rps = total(F.transform(below, lambda d: d * d)) / (F.size(pc) - 1)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((pred == yc).cast("int")).alias("accuracy"), F.avg(F.abs(expected_level(pc) - yc)).alias("mae"), F.avg(rps).alias("rps"), F.avg((F.abs(pred - yc) <= 1).cast("int")).alias("within_one")
    )


def choice_report(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("n"), F.avg((argmax(F.col(p)) == F.col(y)).cast("int")).alias("top1"), F.avg(F.size(p)).alias("k_mean"))


def prefix_slices(df: DataFrame, y: str, p: str, frac: str, least: int = 20) -> DataFrame:
    """auroc and brier per quarter of the run; quarters with fewer rows or one class are left out."""
    d = df.withColumn("bucket", F.least(F.lit(3), F.floor(F.col(frac) * 4)).cast("int"))
    flat = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), brier(F.col(y), F.col(p)).alias("brier"), F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    return flat.where((F.col("n") >= least) & (F.col("_lo") < F.col("_hi"))).drop("_lo", "_hi").join(auroc(d, y, p, ["bucket"]), "bucket")


def selective_report(df: DataFrame, y: str, p: str, coverages: tuple[float, ...] = (0.5, 0.8), errors: tuple[float, ...] = (0.05, 0.01)) -> DataFrame:
    """Extension: risk over coverage by top probability: aurc, accuracy of the most certain shares, and the largest
    coverage within each error rate. Rows of equal certainty enter together."""
    d = df.select(F.array_max(p).alias("c"), (argmax(F.col(p)) != F.col(y)).cast("long").alias("e"))
    c = d.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.sum("e").alias("e"))
    c = running(c, [], "c", ["k", "e"], falling=True).withColumnsRenamed({"upto_k": "n", "upto_e": "bad"})
    total = d.agg(F.count(F.lit(1)).alias("all")).withColumn("_one", F.lit(1))
    c = c.withColumn("_one", F.lit(1)).join(total, "_one")
    rate = F.col("bad") / F.col("n")
    return c.agg(
        (F.sum(rate * F.col("k")) / F.max("all")).alias("aurc"), *[(1 - F.min_by(rate, F.when(F.col("n") >= q * F.col("all"), F.col("n")))).alias(f"accuracy_at_{round(q * 100)}") for q in coverages],
        *[F.coalesce(F.max(F.when(rate <= e, F.col("n") / F.col("all"))), F.lit(0.0)).alias(f"coverage_at_{round(e * 100)}") for e in errors],
    )
