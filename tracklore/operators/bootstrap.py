"""Intervals of a statistic when whole groups are drawn with replacement.

Every replicate draws as many groups as there are, whatever the size of the table. The draws are not listed: how many of
them fall on the two halves of a range of group numbers is one binomial number for each replicate, seeded by the range, so
any task finds the weights of the groups it holds by going down from the whole range, and all tasks agree. Rows are never
repeated for replicates; a task folds its rows into an array with one place for each replicate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.functions.frames import frozen

RANGES = 256
#: Groups whose draws come from one multinomial number.
LEAF = 32
#: Rows whose weights are in memory at a time.
CHUNK = 2048
#: Groups that are numbered in one task.
NUMBERED = 1 << 17


class Sums(NamedTuple):
    """A statistic made of weighted sums. `part` gives the summands of rows, (rows, m), from arrays y and p; `final` makes
    values, NaN where there is none, of sums, (replicates, m)."""

    part: Callable[[np.ndarray, np.ndarray], np.ndarray]
    final: Callable[[np.ndarray], np.ndarray]


def mean_of(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Sums:
    """The mean of f(y, p) over rows."""

    def final(s: np.ndarray) -> np.ndarray:
        return np.divide(s[:, 0], s[:, 1], out=np.full(len(s), math.nan), where=s[:, 1] > 0)

    return Sums(lambda y, p: np.stack([f(y, p).astype(float), np.ones(len(y))], 1), final)


STATISTICS = {
    "mean": mean_of(lambda y, p: p),
    "brier": mean_of(lambda y, p: (p - y) ** 2),
    "accuracy": mean_of(lambda y, p: (p >= 0.5) == (y == 1)),
    "nll": mean_of(lambda y, p: -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-7, 1 - 1e-7))),
}


class Draws:
    """How often each replicate draws a group, for groups numbered from 0 to k."""

    def __init__(self, seed: int, k: int, n_boot: int):
        self.seed, self.k, self.n_boot = seed, k, n_boot

    def of(self, groups: np.ndarray) -> np.ndarray:
        """(len(groups), n_boot) of sorted distinct group numbers."""
        out = np.empty((len(groups), self.n_boot))
        todo = [(0, self.k, np.full(self.n_boot, self.k), 0, len(groups))]
        while todo:
            lo, hi, drawn, a, b = todo.pop()  # groups[a:b] are those from lo to hi
            if a == b:
                continue
            rng = np.random.default_rng([self.seed, lo, hi])
            if hi - lo <= LEAF:
                out[a:b] = rng.multinomial(drawn, np.full(hi - lo, 1 / (hi - lo))).T[groups[a:b] - lo]
                continue
            mid = (lo + hi) // 2
            left = rng.binomial(drawn, (mid - lo) / (hi - lo))
            cut = a + int(np.searchsorted(groups[a:b], mid))
            todo += [(lo, mid, left, a, cut), (mid, hi, drawn - left, cut, b)]
        return out

    def weights(self, groups: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(rows, 1 + n_boot): the count of each row as it is, then in each replicate."""
        own, at = np.unique(groups, return_inverse=True)
        return np.concatenate([np.ones((len(own), 1)), self.of(own)], 1)[at] * n[:, None]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), CHUNK):
            yield b.iloc[i : i + CHUNK]


def _numbered(groups: DataFrame, k: int) -> DataFrame:
    """(g, j): the k distinct values of g numbered from 0, by hash ranges that hold NUMBERED of them on average."""
    h = F.xxhash64("g")
    d = groups.select("g", h.alias("_h"), F.pmod(h, F.lit(max(1, -(-k // NUMBERED)))).alias("_b"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "g"))
    return d.withColumn("_i", nth).join(starts, "_b").select("g", (F.col("_start") + F.col("_i") - 1).alias("j"))


def grouped_bootstrap(df: DataFrame, group: str, y: str, p: str, stat: str | Sums | Callable = "auroc", n_boot: int = 1000, seed: int = 0, alpha: float = 0.05, parts: int = 32, most_rows: int = 1_000_000) -> DataFrame:
    """One row: point, lo, hi of `stat` when whole groups are drawn with replacement; replicates without a value are dropped.

    `stat` is auroc, the name of a weighted sum in STATISTICS, `Sums` of your own, or any function of arrays (y, p, w) where
    w says how often each row counts. The first three are folded part by part and hold no more than a chunk of rows. A
    function of your own sees a replicate's rows together, so `parts` tasks hold all distinct (group, y, p) each, and more
    than `most_rows` of them are an error.

    Rows whose y or p is null, or whose p is not a number, are left out; a null group is a group of its own. Replicates depend on
    the seed and on the groups, not on how rows are dealt. Without rows, all three are null."""
    own = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    known = df.select(own.alias("g"), F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p")).where("y IS NOT NULL AND p IS NOT NULL AND NOT isnan(p)")
    table = frozen(known.groupBy("g", "y", "p").agg(F.count(F.lit(1)).alias("n")))
    groups = table.select("g").distinct()
    k = groups.count()
    rows = table.join(_numbered(groups, k), "g").select("j", "y", "p", "n")
    draws = Draws(seed, k, n_boot)
    if stat == "auroc":
        reps = _ranked(rows, table, draws)
    elif callable(stat) and not isinstance(stat, Sums):
        if table.count() > most_rows:
            raise ValueError(f"over {most_rows} distinct rows: give the statistic as Sums")
        reps = _whole(rows, stat, draws, parts)
    else:
        reps = _summed(rows, STATISTICS[stat] if isinstance(stat, str) else stat, draws, parts)
    vals = F.array_sort(F.collect_list(F.when(F.col("id") > 0, F.col("v"))))  # n_boot numbers
    r = reps.where("NOT isnan(v)").agg(F.max(F.when(F.col("id") == 0, F.col("v"))).alias("point"), vals.alias("s"))
    m = F.size("s")
    pick = lambda q: F.try_element_at(F.col("s"), F.greatest(F.lit(1), F.least(m, F.floor(F.lit(q) * m).cast("int") + 1)))
    return r.select("point", pick(alpha / 2).alias("lo"), pick(1 - alpha / 2).alias("hi"))


def _summed(rows: DataFrame, stat: Sums, draws: Draws, parts: int) -> DataFrame:
    """(id, v) of replicates, id 0 being the rows as they are: each task gives one row of sums a replicate."""
    m = stat.part(np.zeros(0), np.zeros(0)).shape[1]
    names = [f"s{i}" for i in range(m)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((1 + draws.n_boot, m))
        for b in _chunks(batches):
            sums += draws.weights(b["j"].to_numpy(), b["n"].to_numpy()).T @ stat.part(b["y"].to_numpy(), b["p"].to_numpy())
        yield pd.DataFrame(sums, columns=names).assign(id=range(len(sums)))

    def value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "v": stat.final(b[names].to_numpy())})

    # a task's groups lie close together, so that their weights share most of the way down
    made = rows.repartitionByRange(parts, "j").sortWithinPartitions("j").mapInPandas(fold, ", ".join(["id long", *[f"{c} double" for c in names]]))
    return made.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).mapInPandas(value, "id long, v double")


def _ranked(rows: DataFrame, table: DataFrame, draws: Draws) -> DataFrame:
    """(id, v) of replicates of the AUROC: each range of p is read in order and gives a replicate's positives, negatives and
    won pairs; running sums over the ranges give the pairs between them. A value of p that is several quantiles has a range
    of its own, dealt in as many parts: no order matters in it."""
    ends = Counter(e for e in table.approxQuantile("p", [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES) if math.isfinite(e))
    cuts = sorted(set(ends) | {math.nextafter(e, math.inf) for e, times in ends.items() if times > 1})
    shares = {i + 1: ends[e] for i, e in enumerate(cuts) if ends[e] > 1}  # of ranges with one value: range i + 1 begins at cut i
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e <= F.col("p"))) if cuts else F.lit(0)
    d = rows.withColumn("r", at)
    alone: Column = F.lit(False)
    part: Column = F.lit(0)
    if shares:
        by_range = F.create_map(*[F.lit(x) for i, s in shares.items() for x in (i, s)])
        part = F.coalesce(F.pmod(F.xxhash64("j"), by_range[F.col("r")]).cast("int"), F.lit(0))
        alone = F.col("r").isin(*shares)
    d = d.withColumn("part", part).repartition("r", "part").sortWithinPartitions("r", "part", "p")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = value = None

        def done() -> pd.DataFrame:
            won = sums[2] + held[0] * (sums[1] + held[1] / 2)
            return pd.DataFrame({"id": range(1 + draws.n_boot), "r": key[0], "pos": sums[0] + held[0], "neg": sums[1] + held[1], "won": won})

        for b in _chunks(batches):
            for own, c in b.groupby(["r", "part"], sort=False):
                if own != key:
                    if key is not None:
                        yield done()
                    key, value = own, None
                    sums, held = np.zeros((3, 1 + draws.n_boot)), np.zeros((2, 1 + draws.n_boot))  # sums before, and of, the last value of p
                ps, w = c["p"].to_numpy(), draws.weights(c["j"].to_numpy(), c["n"].to_numpy())
                starts = np.flatnonzero(np.r_[True, ps[1:] != ps[:-1]])
                yes = (c["y"].to_numpy() == 1)[:, None]
                each = np.stack([np.add.reduceat(w * yes, starts), np.add.reduceat(w * ~yes, starts)])
                if value is not None and ps[0] == value:
                    each[:, 0] += held
                else:
                    each = np.concatenate([held[:, None], each], 1)
                pos, neg = each[0, :-1], each[1, :-1]
                below = sums[1] + np.cumsum(neg, 0) - neg
                sums += np.stack([pos.sum(0), neg.sum(0), (pos * (below + neg / 2)).sum(0)])
                held, value = each[:, -1].copy(), ps[-1]
        if key is not None:
            yield done()

    c = d.mapInPandas(fold, "id long, r int, pos double, neg double, won double").groupBy("id", "r").agg(*[F.sum(x).alias(x) for x in ("pos", "neg", "won")])
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumns({"below": below, "won": F.when(alone, F.col("pos") * F.col("neg") / 2).otherwise(F.col("won"))})
    return c.groupBy("id").agg((F.sum(F.col("won") + F.col("pos") * F.col("below")) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("v"))


def _whole(rows: DataFrame, stat: Callable, draws: Draws, parts: int) -> DataFrame:
    """(id, v) of replicates of any function: a copy of the rows for each of `parts` tasks, which share the replicates."""
    d = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["j", "y", "p"])
        j, ys, ps, n = (b[c].to_numpy() for c in ("j", "y", "p", "n"))
        own, at = np.unique(j, return_inverse=True)
        ids = range(key[0], 1 + draws.n_boot, parts)
        weights = [draws.of(own[i : i + CHUNK])[:, [max(0, i - 1) for i in ids]].astype(np.int32) for i in range(0, len(own), CHUNK)]
        drawn = np.concatenate(weights).T
        out = []
        for i, w in zip(ids, drawn):
            w = (w[at] if i else 1) * n
            out.append(stat(ys[w > 0], ps[w > 0], w[w > 0]) if w.any() else math.nan)
        return pd.DataFrame({"id": list(ids), "v": out})

    return d.groupBy("turn").applyInPandas(run, "id long, v double")
