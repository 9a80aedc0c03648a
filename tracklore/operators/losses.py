"""Losses of predictions as aggregates, for evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions.arrays import total

#: Weights of the questions in a record's loss.
QUESTION_WEIGHTS = {"p_success": 1.0, "stuck": 0.5, "progress": 0.5, "steps_left": 0.5, "escalate": 0.5, "best_next": 0.5}


def cross_entropy(p: Column, label: Column, eps: float = 1e-9) -> Column:
    return -F.log(F.greatest(F.element_at(p, label + 1), F.lit(eps)))


def ordinal_loss(p: Column, label: Column, ce_weight: float = 0.5, eps: float = 1e-7) -> Column:
    """Mean binary cross-entropy of P(level > k) over the cuts k, plus a share of cross-entropy."""
    def cut(k: Column) -> Column:
        above = F.least(F.greatest(total(F.slice(p, k + 2, F.size(p))), F.lit(eps)), F.lit(1 - eps))
        return F.when(label > k, -F.log(above)).otherwise(-F.log(1 - above))

    cuts = F.transform(F.sequence(F.lit(0), F.size(p) - 2), cut)
    return total(cuts) / F.size(cuts) + ce_weight * cross_entropy(p, label)


def pairwise_loss(df: DataFrame, pair: str, outcome: str, score: str) -> DataFrame:
    """(pair, loss): log(1 + exp(failure's score - success's)) of complete pairs, by one aggregation, not a self-join."""
    won, lost = F.max(F.when(F.col(outcome), F.col(score))), F.max(F.when(~F.col(outcome), F.col(score)))
    d = df.where(F.col(pair).isNotNull()).groupBy(pair).agg(won.alias("w"), lost.alias("l")).where("w IS NOT NULL AND l IS NOT NULL")
    x = F.col("l") - F.col("w")
    return d.select(pair, (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def question_loss(df: DataFrame) -> DataFrame:
    """Adds loss: ordinal for score questions, cross-entropy for others. df: type, p, label."""
    return df.withColumn("loss", F.when(F.col("type") == "score", ordinal_loss(F.col("p"), F.col("label"))).otherwise(cross_entropy(F.col("p"), F.col("label"))))


def record_loss(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, loss): weighted sum over a record's questions."""
    w = F.create_map(*[F.lit(x) for kv in (weights or QUESTION_WEIGHTS).items() for x in kv])
    return question_loss(df).groupBy("id").agg(F.sum(F.coalesce(F.try_element_at(w, F.col("question")), F.lit(1.0)) * F.col("loss")).alias("loss"))
