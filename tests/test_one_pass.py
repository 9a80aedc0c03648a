"""Labels of all prefixes in one pass over a run, and counters that need no scan of their own."""

import random
import time

from pyspark.sql import functions as F

from tracklore.functions import arrays
from tracklore.operators import labels
from tracklore.sources import convert

STEPS = "run long, steps array<struct<action:string,observation:string,thought:string,extra:string>>"
ACTS = [("pytest -q", "3 passed, 2 failed in 1s"), ("pytest -q", "5 passed in 1s"), ("pytest -q", "1 passed, 4 failed"), ("edit 1:5", "File updated"), ("edit 300:9", "No replacement was performed"), ("ls", ""), ("open a.py", "x"), ("cat b.py", "No such file or directory"), ("python run.py", "Traceback\nValueError: bad 3"), ("submit", "")]


def runs(rng, sizes):
    return [(k, [(*rng.choice(ACTS), None, "{}") for _ in range(n)]) for k, n in enumerate(sizes)]


def test_running_maxima(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(50) for _ in range(n)],) for n in (0, 1, 2, 5, 16, 17)]
    for r in spark.createDataFrame(rows, "a array<int>").select("a", arrays.scanned(F.col("a"), lambda x, y: F.greatest(x, y)).alias("m")).collect():
        assert r.m == [max(r.a[: k + 1]) for k in range(len(r.a))]


def test_progress_of_all_prefixes_equals_that_of_each(spark):
    d = labels.derive(spark.createDataFrame(runs(random.Random(2), [0, 1, 2, 7, 30, 60]), STEPS))
    key = lambda d: sorted((r.run, r.prefix_len, r.x.value, r.x.reason) for r in d.collect())
    want = key(labels.all_prefixes(d, labels.progress, "x", "run"))
    assert key(labels.all_progress(d, "x", "run")) == want and len({w[3] for w in want}) > 8


def test_a_long_run_costs_no_more_a_step(spark):
    took = {}
    for n in (400, 400, 1600):
        d = labels.derive(spark.createDataFrame(runs(random.Random(3), [n] * 4), STEPS))
        t = time.time()
        assert labels.all_progress(d, "x", "run").agg(F.count("x.reason")).first()[0] == 4 * n
        took[n] = time.time() - t
    assert took[1600] < 5 * took[400] + 2


def test_dropped_rows_are_counted_in_the_same_pass(spark):
    d = spark.createDataFrame([(0,), (1,), (2,), (None,), (1,)], "resolved int")
    kept, seen = convert.labelled_in_one_pass(d)
    assert sorted(r.resolved for r in kept.collect()) == [0, 1, 1] and seen.get == {"rows": 5, "unlabelled": 2}
    reasons = [None, "empty", "empty", "unlabelled", None, "no assistant turns"]
    out, seen = convert.kept_runs(spark.createDataFrame([(i, r) for i, r in enumerate(reasons)], "traj_id int, skip_reason string"))
    assert sorted(r.traj_id for r in out.collect()) == [0, 4] and out.columns == ["traj_id"]
    assert seen.get == {"rows": 6, "unlabelled": 1, "empty": 2, "unexpected_message_prefix": 0, "roles_do_not_alternate": 0, "no_assistant_turns": 1}
