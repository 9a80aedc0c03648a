"""States of many prefixes of a run at once: the same texts as one choice after another, and nothing but parts in Python."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tracklore.functions import arrays
from tracklore.operators import state

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
STEPS = "traj_id string, task string, policy_model string, steps array<struct<action:string,observation:string,thought:string>>"


def test_running_sums_and_bisection(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(-9, 99) for _ in range(n)],) for n in (0, 1, 2, 3, 7, 8, 9, 100)]
    for r in spark.createDataFrame(rows, "a array<int>").select("a", arrays.cumulative(F.col("a")).alias("c")).collect():
        assert r.c == [sum(r.a[:k]) for k in range(len(r.a) + 1)]
    cases = [(lo, hi, at) for lo in (0, 1, 5) for hi in (5, 6, 40, 1000) for at in {lo, hi, (lo + hi) // 2}]
    d = spark.createDataFrame(cases, "lo int, hi int, at int")
    for r in d.select("at", arrays.least_where(F.col("lo"), F.col("hi"), lambda x: x >= F.col("at")).alias("found")).collect():
        assert r.found == r.at


def runs(rng, n):
    act = lambda: rng.choice(["ls", "edit 1:2", "think", "python run_all_of_it.py --fast"])
    return [(f"t{i}", "Mend it " * rng.randint(0, 25), rng.choice(["m", "", None]), [(act(), " ".join(["seen"] * rng.randint(0, 40)), None) for _ in range(rng.randint(1, 14))]) for i in range(n)]


def plain_parts(steps, length, cfg):
    """Lines and blocks of steps that need no cleaning."""
    own = [(i, a, o) for i, (a, o, _) in enumerate(steps[:length], 1)]
    seen = [s for s in own if s[1] != "think"] or own[-1:]
    short = lambda o: "(no output)" if not o else o if len(o) <= cfg.hist_chars else o[: cfg.hist_chars - 3] + "..."
    lines = [f"{i}. $ {a} -> {short(o)}" for i, a, o in seen]
    return lines, [f"## step {i}\n$ {a}\n{o or '(no output)'}" for i, a, o in seen[-cfg.recent_steps :]]


@pytest.mark.parametrize("budget", [60, 130, 400, 5000])
def test_all_prefixes_of_runs_against_one_choice_each(spark, budget):
    """Blocks of one line have no shorter form, so lines, blocks and the task are what is saved."""
    cfg = state.StateConfig(budget=budget, recent_steps=3, safety=12, shrink=(), task_tokens=40)
    rows = runs(random.Random(budget), 60)
    d = spark.createDataFrame(rows, STEPS).withColumns({"n": F.lit("kept"), "h": F.lit(1)})
    out = state.with_states(d, F.sequence(F.lit(1), F.size("steps")), cfg, lambda n: F.when(n % 3 == 0, F.lit("other")))
    assert out.columns == [*d.columns, "states"] and out.where("n <> 'kept'").count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    got = {(r.traj_id, s.prefix_len): (s.state, s.state_tokens) for r in out.select("traj_id", "states").collect() for s in r.states}
    assert len(got) == sum(len(r[3]) for r in rows)
    for traj, task, policy, steps in rows:
        for length in range(1, len(steps) + 1):
            lines, blocks = plain_parts(steps, length, cfg)
            shown = "other" if length % 3 == 0 else policy or "unknown"
            assert got[traj, length] == state.fit(task.strip(), shown, lines, blocks, [], cfg), (traj, length)


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="tokenizer absent")
def test_only_parts_go_through_python(spark):
    cfg = state.StateConfig(budget=170, recent_steps=2, safety=30, shrink=(), tokenizer=TOKENIZER)
    rows = runs(random.Random(2), 40)
    d = spark.createDataFrame(rows, STEPS).withColumn("prefix_len", F.size("steps"))
    out = state.render_states(d, cfg)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    for node in re.findall(r"ArrowEvalPython \[(.*?)\], \[pythonUDF", plan, re.S):
        assert "steps#" not in node and "_whole#" not in node
    count = state.counter(TOKENIZER)
    got = {r.traj_id: (r.state, r.state_tokens, len(r.steps)) for r in out.collect()}
    for traj, task, policy, steps in rows:
        lines, blocks = plain_parts(steps, len(steps), cfg)
        assert got[traj] == (*state.fit(task.strip(), policy or "unknown", lines, blocks, [], cfg, 0, count), len(steps)), traj
