"""Quality by positive-unlabelled learning over the shape of texts.

There are trusted positives and unlabelled web text, no negatives. The share of positives in the latter, the class prior,
is estimated first: a logistic model that tells trusted from unlabelled rows is fitted on half of the rows, and on the other
half the share of unlabelled rows above a score, over that of trusted ones, is least where hardly a negative is above
(with a bound for chance). With that prior the risk of a classifier is unbiased without negatives: prior * risk of the trusted rows as
positives + (risk of all rows as negatives - prior * risk of the trusted rows as negatives). The bracket estimates a risk
and so cannot be below zero; it is taken in blocks of rows, and a block where it is negative counts as zero (the bend is
rounded, so that the risk has a slope everywhere).

Texts are read once, into some 40 numbers each; all fits are Newton steps over all of those rows, one pass a step, in which a task
sends a fixed number of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm.common import bounded_batches, frozen, hot_join, hot_keys, table
from tracklore.llm.word_bytes import START, advance, buffer, spans


def _bytes(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars.encode())] = True
    return t


BLANK = _bytes(" \t\n\x0b\f\r")
UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _bytes("0123456789")
STOP = _bytes(".,;:?'\"()-")
BANG = _bytes("!")
ODD = _bytes("#$%&*+/<=>@[\\]^_`{|}~")
BEYOND = np.arange(256) >= 0x80
LETTER = UPPER | _bytes("abcdefghijklmnopqrstuvwxyz") | BEYOND

SHARES = ("upper", "digit", "stop", "bang", "odd", "beyond", "shouted", "bare", "marked", "long", "same", "words_again", "pairs_again", "fives_again", "lines_again", "short_lines")
SIZES = ("words", "mean_word", "words_a_line")
#: Each share as it is and as its root, so that a little of something tells apart from nothing; logarithms of sizes; the bias.
FEATURES = (*SHARES, *(f"root_{s}" for s in SHARES), *SIZES, "bias")


def _again(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """How many of a row's keys have been there before in it."""
    mixed = (key ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(mixed, kind="stable")
    more = order[1:][mixed[order[1:]] == mixed[order[:-1]]]
    return np.bincount(row[more], minlength=n)


def shapes(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; a null or empty one has zeros but for the bias."""
    n = len(texts)
    data, edge = buffer(texts)
    at, size, row = spans(data, edge, ~BLANK)
    words = np.bincount(row, minlength=n)

    def per_text(of: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(of[data], dtype=np.int64)))[edge])

    def per_word(of: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(of[data], dtype=np.int64)))
        return upto[at + size] - upto[at]

    def words_with(of: np.ndarray) -> np.ndarray:
        return np.bincount(row[of], minlength=n)

    key = advance(np.full(len(at), START), data, at, size).astype(np.uint64) | (size.astype(np.uint64) << np.uint64(32))
    follows = np.zeros(len(at), dtype=bool)
    follows[1:] = row[1:] == row[:-1]

    def runs_again(k: int) -> np.ndarray:
        last = max(0, len(at) - k + 1)
        whole = row[:last] == row[k - 1 :] if last else np.zeros(0, bool)
        mixed = np.zeros(last, np.uint64)
        for i in range(k):
            mixed = (mixed * np.uint64(0x100000001B3)) ^ (key[i : i + last] * np.uint64(0x9E3779B97F4A7C15))
        runs = np.maximum(words - k + 1, 0)
        return _again(row[:last][whole], mixed[whole], n) / np.maximum(runs, 1)

    line_at, line_size, line_row = spans(data, edge, ~_bytes("\n"))
    lines = np.bincount(line_row, minlength=n)
    line_key = advance(np.full(len(line_at), START), data, line_at, line_size).astype(np.uint64) | (line_size.astype(np.uint64) << np.uint64(32))
    solid = np.maximum(per_text(~BLANK), 1)
    some = np.maximum(words, 1)
    letters, odd = per_word(LETTER), per_word(ODD)
    same = follows.copy()
    same[1:] &= key[1:] == key[:-1]
    shares = {
        "upper": per_text(UPPER) / solid, "digit": per_text(DIGIT) / solid, "stop": per_text(STOP) / solid, "bang": per_text(BANG) / solid, "odd": per_text(ODD) / solid, "beyond": per_text(BEYOND) / solid,
        "shouted": words_with((per_word(UPPER) == letters) & (letters > 1)) / some, "bare": words_with((letters == 0) & (per_word(DIGIT) == 0)) / some, "marked": words_with(odd > 0) / some, "long": words_with(size > 24) / some,
        "same": words_with(same) / some, "words_again": _again(row, key, n) / some, "pairs_again": runs_again(2), "fives_again": runs_again(5),
        "lines_again": _again(line_row, line_key, n) / np.maximum(lines, 1), "short_lines": np.bincount(line_row[line_size < 20], minlength=n) / np.maximum(lines, 1),
    }
    x = np.array([shares[s] for s in SHARES]).reshape(len(SHARES), n).T
    sizes = np.log1p(np.array([words, solid / some * (words > 0), words / np.maximum(lines, 1)]).T)
    return np.concatenate([x, np.sqrt(x), sizes, np.ones((n, 1))], axis=1)


def _shaped(df: DataFrame, text_col: str) -> DataFrame:
    """`df` with _x, the FEATURES of its texts in 32 bits each, as bytes."""
    bounded_batches(df.sparkSession)
    names = df.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shapes(b.column(len(names))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([r.tobytes() for r in x], pa.binary())], [*names, "_x"])

    return df.select("*", F.col(text_col).cast("string").alias("_text")).mapInArrow(read, df.withColumn("_x", F.lit(b"")).schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), len(FEATURES)).astype(float)


@dataclass(frozen=True)
class Model:
    """Scores are the logistic function of weights times standardised features; without training rows all are 0.5."""

    weights: list[float]
    middle: list[float]
    spread: list[float]
    prior: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - np.array(self.middle)) / np.array(self.spread)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


NOTHING = Model([0.0] * len(FEATURES), [0.0] * len(FEATURES), [1.0] * len(FEATURES))
BLOCKS = 8
#: How far around zero the bend of the non-negative part is rounded.
BEND = 0.005


def _summed(cells: DataFrame, figures) -> dict[int, float]:
    """Sums over all rows of what `figures(x, trusted, block)` gives for a batch, a fixed number of cells."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = figures(_matrix(b.column("_x")), np.asarray(b.column("_trusted")).astype(bool), b.column("_block").to_numpy())
                total = got if total is None else total + got
        if total is not None:
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["cell", "v"])

    sent = cells.select("_x", F.col("_trusted").cast("int").alias("_trusted"), "_block").mapInArrow(add, "cell int, v double")
    return {r.cell: r.v for r in sent.groupBy("cell").agg(F.sum("v").alias("v")).collect()}


def _vector(sums: dict[int, float], n: int) -> np.ndarray:
    out = np.zeros(n)
    for k, v in sums.items():
        out[k] = v
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _newton(cells: DataFrame, middle: np.ndarray, spread: np.ndarray, prior: float | None, ridge: float, rounds: int) -> np.ndarray:
    """Weights of least risk. Without a prior the two kinds of rows are told apart; with one, the risk is the non-negative one."""
    k = len(middle)
    upper = np.triu_indices(k)
    wide = 3 + 2 * k + len(upper[0])  # a line of sums for each block, and one for the trusted rows

    def square(line: np.ndarray) -> np.ndarray:
        m = np.zeros((k, k))
        m[upper] = line[3 + 2 * k :]
        return m + np.triu(m, 1).T

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Risk, its slope and its curvature."""

        def figures(x: np.ndarray, trusted: np.ndarray, block: np.ndarray) -> np.ndarray:
            x = (x - middle) / spread
            z = np.clip(x @ weights, -500, 500)
            p = 1 / (1 + np.exp(-z))
            out = np.zeros((BLOCKS + 1, wide))
            for b in range(BLOCKS):
                own = block == b
                out[b, 0], out[b, 1], out[b, 2 : 2 + k] = own.sum(), _softplus(z[own]).sum(), p[own] @ x[own]
            own, t = trusted, out[BLOCKS]
            t[0], t[1], t[2 : 2 + k] = own.sum(), _softplus(z[own]).sum(), p[own] @ x[own]
            t[2 + k], t[3 + k : 3 + 2 * k] = _softplus(-z[own]).sum(), x[own].sum(axis=0)
            curve = (p * (1 - p))[:, None]
            out[0, 3 + 2 * k :] = (x.T @ (x * curve))[upper]
            t[3 + 2 * k :] = (x[own].T @ (x[own] * curve[own]))[upper]
            return out.reshape(-1)

        got = _vector(_summed(cells, figures), (BLOCKS + 1) * wide).reshape(BLOCKS + 1, wide)
        n, t = got[:BLOCKS, 0].sum(), got[BLOCKS]
        as_negative, its_slope = t[1] / t[0], t[2 : 2 + k] / t[0]
        as_positive, slope = t[2 + k] / t[0], (t[2 : 2 + k] - t[3 + k : 3 + 2 * k]) / t[0]
        bent = square(got[0]) / n
        if prior is None:
            risk, grad = as_positive + got[:BLOCKS, 1].sum() / n, slope + got[:BLOCKS, 2 : 2 + k].sum(axis=0) / n
            bent = bent + square(t) / t[0]
        else:
            risk, grad, kept, kinks = prior * as_positive, prior * slope, 0.0, np.zeros((k, k))
            for line in got[:BLOCKS]:
                if line[0]:
                    share, rest, down = line[0] / n, line[1] / line[0] - prior * as_negative, line[2 : 2 + k] / line[0] - prior * its_slope
                    counts = 1 / (1 + np.exp(-np.clip(rest / BEND, -500, 500)))
                    risk += share * BEND * float(_softplus(rest / BEND))
                    grad = grad + share * counts * down
                    kinks += share * counts * (1 - counts) / BEND * np.outer(down, down)
                    kept += share * counts
            bent = kept * bent + prior * (1 - kept) * square(t) / t[0] + kinks
        tie = ridge * np.array([*[1.0] * (k - 1), 0.0])
        return risk + 0.5 * float(tie @ weights**2), grad + tie * weights, bent + np.diag(tie + 1e-6)

    best, least, stride, weights = np.zeros(k), np.inf, 1.0, np.zeros(k)
    for _ in range(rounds):
        risk, grad, bent = at(weights)
        if risk < least:
            gained, best, least, stride = least - risk, weights, risk, min(1.0, 2 * stride)
            move = np.linalg.solve(bent, grad)
            move *= min(1.0, 3.0 / max(1e-12, float(np.abs(move).max())))
            if gained < 1e-6:
                break
        elif stride > 0.02:
            stride /= 4
        else:
            break
        weights = best - stride * move
    return best


def estimated_prior(cells: DataFrame, middle: np.ndarray, spread: np.ndarray, ridge: float, rounds: int, sure: float = 0.05) -> float:
    """The share of positives among all rows, from a model of trusted against all that half of the blocks give and the
    other half of them in 2,000 steps of its score."""
    weights = _newton(cells.where("_block % 2 = 0"), middle, spread, None, ridge, rounds)
    steps = 2000

    def figures(x: np.ndarray, trusted: np.ndarray, block: np.ndarray) -> np.ndarray:
        z = ((x - middle) / spread) @ weights
        at = np.clip((z + 10) * (steps / 20), 0, steps - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=steps), np.bincount(at[trusted], minlength=steps)]).astype(float)

    got = _vector(_summed(cells.where("_block % 2 = 1"), figures), 2 * steps).reshape(2, steps)
    n = got.sum(axis=1)
    if not n.all():
        return 0.5
    above = np.cumsum(got[:, ::-1], axis=1) / n[:, None]
    slack = np.sqrt(np.log(4 / sure) / 2 / n)
    ok = above[1] > 0
    bound = (above[0, ok] + slack[0] + slack[1]) / above[1, ok]
    best = int(bound.argmin())
    return float(np.clip(above[0, ok][best] / above[1, ok][best], 0.02, 0.98))


def fit(cells: DataFrame, ridge: float = 1e-3, rounds: int = 30) -> Model:
    """A model from rows of _x, _trusted and _block. All rows are the unlabelled text, trusted ones among them, so the prior is that of
    the table. Sums are over all rows; the driver gets a fixed number of them a pass. Without trusted rows, or without
    rows, NOTHING."""
    k = len(FEATURES)
    moments = _vector(_summed(cells, lambda x, trusted, block: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x), trusted.sum()]])), 2 * k + 2)
    n, positives = moments[-2:]
    if not n or not positives:
        return NOTHING
    middle = moments[:k] / n
    spread = np.sqrt(np.maximum(moments[k : 2 * k] / n - middle**2, 0.0))
    middle[-1] = 0.0
    spread = np.where(spread > 1e-6, spread, 1.0)
    ridge += 1 / positives  # a normal prior of weights, which rows outweigh
    prior = estimated_prior(cells, middle, spread, ridge, rounds)
    weights = _newton(cells, middle, spread, prior, ridge, rounds)
    return Model(np.round(weights, 9).tolist(), middle.tolist(), spread.tolist(), prior)


def train_and_score(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None, threshold: float = 0.3, ridge: float = 1e-3, rounds: int = 30,
) -> tuple[DataFrame, Model]:
    """(`<id_col>`, score, predicted of every row; the model). `trusted` holds ids of rows known to be good; `training`, a
    condition on the id, says which rows the fit may read (all without it).

    Null text counts as empty; such texts are scored like others. Rows without an id are scored and are unlabelled. Repeated
    rows count as often as they are there, and score alike; an id listed twice counts once. Very long texts are read whole, in time
    n log n in their words. An empty table gives an empty result; without trusted rows all scores are 0.5. Extra columns are
    ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    rows = _shaped(rows, "_t").drop("_t").withColumns({"_key": F.xxhash64("_id"), "_block": F.pmod(F.xxhash64("_x"), F.lit(BLOCKS)).cast("int"), "_may": training if training is not None else F.lit(True)})
    rows = frozen(rows)
    known = trusted.select(F.col(id_col).alias("_same")).where("_same IS NOT NULL").distinct().withColumns({"_key": F.xxhash64("_same"), "_found": F.lit(True)})
    may = rows.where("_may").withColumn("_place", F.monotonically_increasing_id())
    cells = hot_join(may, known, "_key", hot_keys(may, "_key"), F.col("_place"), F.col("_id") == F.col("_same"), "left")
    cells = frozen(cells.select("_x", F.coalesce("_found", F.lit(False)).alias("_trusted"), "_block"))
    model = fit(cells, ridge, rounds)
    return _scored(rows, model, id_col, threshold), model


def _scored(rows: DataFrame, model: Model, id_col: str, threshold: float) -> DataFrame:
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(_matrix(b.column("_x")))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["_id", "score", "predicted"])

    kind = dict(rows.dtypes)["_id"]
    return rows.select("_id", "_x").mapInArrow(give, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`<id_col>`, score, predicted of every row by a model at hand, in one pass; odd rows as in `train_and_score`."""
    return _scored(_shaped(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_t"), model, id_col, threshold)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out & (F.col("quality") == 1))
    learnt = F.coalesce(F.crc32(F.col("_id").cast("string")) % 5 != 0, F.lit(True))
    out, model = train_and_score(table(spark, sf_dir, "documents"), labels, training=learnt)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", F.lit(model.prior).cast("double").alias("prior"))
