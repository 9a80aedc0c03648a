"""The threshold grid by difference cells against one simulated run after another; call lookup in linear steps."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tracklore.operators import simulate, splits
from tracklore.sources import convert


def points(rng, n, policies=("a", "b", None)):
    out = []
    for run in range(n):
        steps, won, policy = rng.randint(1, 12), rng.random() < 0.4, rng.choice(policies)
        for k in sorted(rng.sample(range(1, steps + 1), rng.randint(1, steps))):
            out.append((run, k, steps, won, rng.choice([0.1, 0.3, 0.5, rng.random()]), policy))
    return out


def plain_metrics(rows, grid, min_frac):
    runs = {}
    for run, k, n, won, p, _ in rows:
        runs.setdefault(run, (n, won, []))[2].append((k, p))
    out = {}
    for thr in grid:
        cut = {r: min((k for k, p in ps if k / n >= min_frac and p < thr), default=None) for r, (n, _, ps) in runs.items()}
        won, fired = [r for r in runs if runs[r][1]], [r for r in runs if cut[r] is not None]
        lost = [r for r in runs if not runs[r][1]]
        hit, miss = [r for r in fired if runs[r][1]], [r for r in fired if not runs[r][1]]
        out[thr] = (len(runs), len(hit) / max(1, len(won)), len(miss) / max(1, len(lost)), len(miss) / max(1, len(fired)), len(fired) / len(runs), sum(runs[r][0] - cut[r] for r in fired) / max(1, sum(runs[r][0] for r in runs)), len(won) / len(runs), (len(won) - len(hit)) / len(runs))
    return out


NAMES = ("runs", "fpr", "recall", "precision", "fired", "steps_saved", "resolve_rate", "resolve_rate_with_abort")


@pytest.mark.parametrize("grid", [simulate.thresholds(), [0.3], [0.0, 0.1, 0.10001, 0.5, 1.0, 2.0]])
def test_grid_against_every_run_and_threshold(spark, grid):
    rows = points(random.Random(len(grid)), 150)
    d = spark.createDataFrame(rows, "run long, prefix_len int, n_steps int, outcome boolean, p double, policy string")
    got = {round(r.thr, 6): tuple(r[c] for c in NAMES) for r in simulate.abort_table(d, grid, min_frac=0.3).collect()}
    want = {round(t, 6): pytest.approx(v) for t, v in plain_metrics(rows, grid, 0.3).items()}
    assert got == want
    old = simulate.abort_metrics(simulate.abort_runs(d, grid, min_frac=0.3, by=["policy"]), ["policy"]).collect()
    new = simulate.abort_table(d, grid, min_frac=0.3, by=["policy"]).collect()
    key = lambda r: (r.policy or "", round(r.thr, 6))
    assert {key(r): tuple(r[c] for c in NAMES) for r in new} == {key(r): pytest.approx(tuple(r[c] for c in NAMES)) for r in old} and len(new) == 3 * len(grid)
    plan = simulate.abort_table(d, grid)._jdf.queryExecution().executedPlan().toString()
    assert simulate.abort_table(d.where("false"), grid).count() == 0 and "Expand" not in plan


def test_places_of_a_whole_shuffle(spark):
    d = spark.createDataFrame([(i,) for i in range(500)], "id long")
    got = {r.id: r.place for r in splits.with_place(d, "s", "id", ranges=16).collect()}
    order = [r.id for r in splits.shuffled(d, "s", "id").collect()]
    assert got == {i: k for k, i in enumerate(order, 1)}
    assert splits.with_place(d.where("false"), "s", "id").count() == 0


CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
RAW = f"trajectory_id string, instance_id string, repo string, trajectory array<struct<role:string,content:string,tool_calls:array<{CALL}>,name:string,tool_call_id:string>>, model_patch string, exit_status string, resolved int, gen_tests_correct double, pred_passes_gen_tests double"


def long_run(n):
    msgs = [("system", "s", None, None, None), ("user", "<issue_description> fix it </issue_description>", None, None, None)]
    for k in range(n):
        calls = [(f"c{k}{x}", "function", ("execute_bash", json.dumps({"command": f"run {k}{x}"}))) for x in "ab"]
        msgs.append(("assistant", f"say {k}", calls, None, None))
        msgs += [("tool", f"early {k}", None, None, f"c{k}a"), ("tool", f"out {k}", None, None, f"c{k}a")] + ([("tool", f"b {k}", None, None, f"c{k}b")] if k % 3 else [])
    return msgs


def test_calls_find_the_last_result_and_long_runs_cost_no_more_a_call(spark):
    d = lambda n: spark.createDataFrame([("r", "owner__repo-1", "owner/repo", long_run(n), "", "", 1, 0.0, 0.0)], RAW)
    steps = convert.tool_calls(d(40)).first().steps
    assert [(s.action, s.observation) for s in steps] == [x for k in range(40) for x in ((f"run {k}a", f"out {k}"), (f"run {k}b", f"b {k}" if k % 3 else ""))]
    assert [s.thought for s in steps[:4]] == ["say 0", None, "say 1", None]
    took = {}
    for n in (300, 300, 1500):
        rows = d(n)
        t = time.time()
        assert convert.tool_calls(rows).select(F.size("steps")).first()[0] == 2 * n
        took[n] = time.time() - t
    assert took[1500] < 5 * took[300] + 5
