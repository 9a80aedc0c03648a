"""Temperatures and flag thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.functions.arrays import logits, temper
from tracklore.operators.metrics import recall_at_fpr


def fit_temperatures(df: DataFrame, by: str, p: str = "p", label: str = "label", logits_col: str | None = None, least_rows: int = 50, lo: float = 0.2, hi: float = 10.0, points: int = 25, rounds: int = 4) -> DataFrame:
    """(by, temperature, nll, n): the temperature in [lo, hi] with the least mean NLL, per group of at least `least_rows`.

    Each round scores a grid of temperatures for all groups in one aggregation and narrows each group's bracket around
    its best point; the NLL is unimodal in the temperature. Brackets are one row per group on the driver."""
    z = logits(F.col(p), F.col(logits_col) if logits_col else None)
    rows = df.select(F.col(by).alias("g"), z.alias("z"), F.col(label).alias("y"))
    sizes = {r.g: r.n for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows).collect()}
    box = {g: (float(np.log(lo)), float(np.log(hi))) for g in sizes}
    best: dict = {}
    for _ in range(rounds):
        grid = {g: np.exp(np.linspace(a, b, points)).tolist() for g, (a, b) in box.items()}
        if not grid:
            break
        spark = df.sparkSession
        kind = rows.schema["g"].dataType.simpleString()
        t = spark.createDataFrame([(g, x) for g, xs in grid.items() for x in [xs]], f"g {kind}, ts array<double>")
        cost = F.transform("ts", lambda x: _nll_at("z", "y", x))
        d = rows.join(t, "g")
        got = d.groupBy("g").agg(F.array(*[F.avg(F.element_at(cost, i + 1)) for i in range(points)]).alias("c")).collect()
        for r in got:
            i = int(np.argmin(r.c))
            xs = grid[r.g]
            best[r.g] = (xs[i], r.c[i])
            box[r.g] = (float(np.log(xs[max(0, i - 1)])), float(np.log(xs[min(points - 1, i + 1)])))
    kind = rows.schema["g"].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, float(t), float(c), sizes[g]) for g, (t, c) in best.items()], f"`{by}` {kind}, temperature double, nll double, n long")


def _nll_at(z: str, y: str, t):
    """Negative log-likelihood of option y under softmax(z / t)."""
    top = F.array_max(z)
    norm = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))
    return F.log(norm) - (F.element_at(z, F.col(y) + 1) - top) / t


def apply_temperatures(df: DataFrame, temps: DataFrame, by: str, p: str = "p", to: str = "calibrated") -> DataFrame:
    """Adds the tempered probabilities; groups without a temperature stay as they are. Raw ones are kept, so nothing is
    tempered twice."""
    out = df.join(temps.select(by, F.col("temperature").alias("_t")), by, "left")
    return out.withColumn(to, temper(F.col(p), F.coalesce("_t", F.lit(1.0)))).drop("_t")


def flag_thresholds(dev: DataFrame, test: DataFrame, y_fail: str, score: str, budgets: tuple[float, ...] = (0.05, 0.10, 0.25)) -> DataFrame:
    """Per budget the threshold that dev gives, with dev's recall, and what it does on test: fpr, recall, fired."""
    out = None
    for b in budgets:
        d = recall_at_fpr(dev, y_fail, score, b).select(F.lit(b).alias("budget"), "threshold", F.col("recall").alias("dev_recall"))
        over = (F.col(score) > F.col("threshold")).cast("int")
        t = test.select(y_fail, score).join(F.broadcast(d))  # one row
        r = t.groupBy("budget", "threshold", "dev_recall").agg(F.avg(F.when(F.col(y_fail) == 0, over)).alias("test_fpr"), F.avg(F.when(F.col(y_fail) == 1, over)).alias("test_recall"), F.avg(over).alias("test_fired"))
        out = r if out is None else out.unionByName(r)
    return out
