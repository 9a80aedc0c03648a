"""Bootstrap over groups, against plain replicates with the same weights, and weights against what drawing gives."""

import math
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from tracklore.operators import bootstrap, metrics

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this module


def auc(y, p, w):
    won = sum(a * b * (1.0 if pi > pj else 0.5 if pi == pj else 0.0) for yi, pi, a in zip(y, p, w) if yi for yj, pj, b in zip(y, p, w) if not yj)
    both = sum(a for yi, a in zip(y, w) if yi) * sum(b for yj, b in zip(y, w) if not yj)
    return won / both if both else math.nan


def spread(y, p, w):
    """No sum: the weighted median of p."""
    at = np.argsort(p)
    return float(p[at][np.searchsorted(np.cumsum(w[at]), w.sum() / 2)])


PLAIN = {
    "auroc": auc,
    "mean": lambda y, p, w: np.dot(w, p) / np.sum(w),
    "brier": lambda y, p, w: np.dot(w, (np.array(p) - y) ** 2) / np.sum(w),
    "accuracy": lambda y, p, w: np.dot(w, (np.array(p) >= 0.5) == (np.array(y) == 1)) / np.sum(w),
    "nll": lambda y, p, w: np.dot(w, [-math.log(q if v else 1 - q) for v, q in zip(y, p)]) / np.sum(w),
}


def rows_of(seed, groups, n):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.1 else f"g{rng.randrange(groups):03}", rng.randint(0, 1), rng.choice([0.1, 0.2, 0.5, 0.5, 0.5, 0.5, 0.7, round(rng.uniform(0.01, 0.99), 3)])) for _ in range(n)]


def expected(rows, spark, value, n_boot, seed):
    """point, lo, hi by plain replicates; only the numbers of the groups are the library's."""
    d = spark.createDataFrame([("" if g is None else "=" + g,) for g in {r[0] for r in rows}], "g string")
    number = {r.g: r.j for r in bootstrap._numbered(d, d.count()).collect()}
    assert sorted(number.values()) == list(range(len(number)))
    drawn = bootstrap.Draws(seed, len(number), n_boot).of(np.arange(len(number)))
    y, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    own = np.array([number["" if r[0] is None else "=" + r[0]] for r in rows])
    reps = sorted(v for v in (value(y, p, drawn[own, i]) for i in range(n_boot)) if not math.isnan(v))
    return value(y, p, np.ones(len(rows))), reps[int(0.025 * len(reps))], reps[min(len(reps) - 1, int(0.975 * len(reps)))]


@pytest.mark.parametrize("stat", [*PLAIN, spread])
def test_against_plain_replicates(spark, monkeypatch, stat):
    monkeypatch.setattr(bootstrap, "NUMBERED", 5)
    monkeypatch.setattr(bootstrap, "RANGES", 9)
    rows = rows_of(6, 40, 160)
    noise = [("g001", None, 0.5), ("g001", 1, None), ("g002", 0, math.nan)]
    d = spark.createDataFrame(rows + noise, "g string, y int, p double").repartition(3)
    value = stat if callable(stat) else PLAIN[stat]
    got = metrics.grouped_bootstrap(d, "g", "y", "p", stat, n_boot=60, seed=3, parts=3).first()
    assert tuple(got) == pytest.approx(expected(rows, spark, value, 60, 3))


def test_a_table_in_many_chunks_and_ranges(spark, monkeypatch):
    """Half of all rows have one p and a third one group; each task reads chunks of a few rows."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.3 else f"g{rng.randrange(900)}", rng.randint(0, 1), 0.25 if rng.random() < 0.5 else round(rng.random(), 4)) for _ in range(1500)]
    d = spark.createDataFrame(rows, "g string, y int, p double")
    want = metrics.grouped_bootstrap(d, "g", "y", "p", lambda y, p, w: fast_auc(y, p, w), n_boot=40, parts=2).first()
    monkeypatch.setattr(bootstrap, "NUMBERED", 100)
    whole = metrics.grouped_bootstrap(d, "g", "y", "p", n_boot=40).first()
    assert tuple(whole)[0] == pytest.approx(want.point)
    assert fast_auc(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.ones(len(rows))) == pytest.approx(want.point)


def fast_auc(y, p, w):
    _, at = np.unique(p, return_inverse=True)
    pos, neg = np.bincount(at, w * (y == 1)), np.bincount(at, w * (y == 0))
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))


def test_weights_are_those_of_draws_with_replacement():
    """Every replicate draws k groups; a group's weight has the binomial mean and variance, two of them its covariance."""
    k, n = 300, 20_000
    w = bootstrap.Draws(5, k, n).of(np.arange(k))
    assert (w.sum(0) == k).all() and abs(w.mean() - 1) < 1e-12
    assert np.allclose(w.mean(1), 1, atol=0.05) and np.allclose(w.var(1), 1 - 1 / k, atol=0.08)
    for a, b in [(0, 1), (0, 299), (31, 150), (149, 150)]:
        assert abs(np.cov(w[a], w[b])[0, 1] + 1 / k) < 0.03


def test_weights_do_not_depend_on_what_a_task_holds():
    draws = bootstrap.Draws(2, 10_000_000, 20)
    some = np.array([0, 17, 18, 5_000_000, 9_999_999])
    whole = draws.of(some)
    assert all((draws.of(some[i : i + 1])[0] == whole[i]).all() for i in range(len(some)))


def test_sums_of_your_own(spark):
    rows = rows_of(9, 12, 90)
    d = spark.createDataFrame(rows, "g string, y int, p double")
    gap = bootstrap.Sums(lambda y, p: np.stack([y * p, y, p, np.ones(len(y))], 1).astype(float), lambda s: s[:, 0] / s[:, 3] - s[:, 1] * s[:, 2] / s[:, 3] ** 2)
    got = metrics.grouped_bootstrap(d, "g", "y", "p", gap, n_boot=50, seed=1).first()
    cov = lambda y, p, w: np.average(y * p, weights=w) - np.average(y, weights=w) * np.average(p, weights=w)
    assert tuple(got) == pytest.approx(expected(rows, spark, cov, 50, 1))
    assert tuple(metrics.grouped_bootstrap(d, "g", "y", "p", cov, n_boot=50, seed=1, parts=4).first()) == pytest.approx(tuple(got))


def test_edges(spark):
    none = spark.createDataFrame([], "g string, y int, p double")
    for stat in ("auroc", "mean", spread):
        assert tuple(metrics.grouped_bootstrap(none, "g", "y", "p", stat, n_boot=5).first()) == (None, None, None)
    one = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5)], "g string, y int, p double")
    assert tuple(metrics.grouped_bootstrap(one, "g", "y", "p", "auroc", n_boot=5).first()) == (None, None, None)
    assert tuple(metrics.grouped_bootstrap(one, "g", "y", "p", "mean", n_boot=5).first()) == (0.5, 0.5, 0.5)
    with pytest.raises(ValueError, match="Sums"):
        metrics.grouped_bootstrap(one, "g", "y", "p", spread, most_rows=0)


def test_no_row_is_repeated_for_replicates(spark):
    d = spark.createDataFrame(rows_of(2, 5, 40), "g string, y int, p double")
    plan = metrics.grouped_bootstrap(d, "g", "y", "p", n_boot=30)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
