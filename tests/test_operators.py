"""Operators against plain Python: metrics, state, pairs, candidates, sources, scoring, streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tracklore.operators import calibration, candidates, losses, metrics, scoring, simulate, splits, state
from tracklore.plans import catalog
from tracklore.sources import convert, files, schema


def test_auroc_with_ties_and_one_class(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(200)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    d = spark.createDataFrame(rows, "y int, p double")
    got = metrics.auroc(d, "y", "p").first().auroc
    assert got == pytest.approx(want)
    assert metrics.auroc(d.withColumn("p", 1 - F.col("p")), "y", "p").first().auroc == pytest.approx(1 - want)
    assert metrics.auroc(d.where("y = 1"), "y", "p").first().auroc is None


def test_recall_at_fpr(spark):
    d = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.9), (0, 0.4), (1, 0.5), (1, 0.95)], "y int, s double")
    r = metrics.recall_at_fpr(d, "y", "s", 0.25).first()
    assert (r.threshold, r.recall, r.precision) == (0.4, 1.0, pytest.approx(2 / 3))
    assert metrics.recall_at_fpr(d, "y", "s", 1.0).first().threshold == -math.inf
    assert metrics.recall_at_fpr(d.where("y = 1"), "y", "s", 0.1).first().recall is None


def test_bootstrap_is_seeded_and_brackets(spark):
    rng = random.Random(2)
    rows = [(f"g{i // 8}", rng.randint(0, 1), rng.random()) for i in range(400)]
    d = spark.createDataFrame(rows, "g string, y int, p double")
    a = metrics.grouped_bootstrap(d, "g", "y", "p", n_boot=100, parts=4).first()
    assert a == metrics.grouped_bootstrap(d.repartition(3), "g", "y", "p", n_boot=100, parts=2).first()
    assert a.lo < a.point < a.hi


def test_fit_temperature_finds_the_scale(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        z = rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + math.exp(-z)))
        q = 1 / (1 + math.exp(-3 * z))  # three times too sure
        rows.append(("q", [1 - q, q], y))
    d = spark.createDataFrame(rows, "q string, p array<double>, label int")
    t = calibration.fit_temperatures(d, "q").first()
    assert 2.4 < t.temperature < 3.8
    assert calibration.fit_temperatures(d.limit(10), "q").count() == 0


def test_losses(spark):
    d = spark.createDataFrame([("a", True, 2.0), ("a", False, 1.0), ("b", True, 1.0)], "pair string, won boolean, s double")
    assert [(r.pair, pytest.approx(r.loss)) for r in losses.pairwise_loss(d, "pair", "won", "s").collect()] == [("a", math.log1p(math.exp(-1)))]


def long_run(spark, n, lines):
    steps = [(f"cmd{i} --flag", "\n".join(f"out {i} {k}" for k in range(lines)), "why", "{}") for i in range(n)]
    return spark.createDataFrame([("r", "t", "swe", "s", "pol", "o/r", "Fix it. " * 20, steps, True, {})], schema.TRAJECTORY)


@pytest.mark.parametrize("budget", [100000, 700, 200])
def test_state_budget_and_layout(spark, budget):
    d = long_run(spark, 40, 30).withColumn("prefix_len", F.explode(F.array(*[F.lit(k) for k in (1, 12, 40)])))
    for r in state.render_states(d, state.StateConfig(budget=budget)).collect():
        assert state.proxy_count(r.state) <= budget
        assert f"## step {r.prefix_len}\n$ cmd{r.prefix_len - 1}" in r.state and "why" not in r.state
        if budget == 100000 and r.prefix_len == 40:
            assert "1. $ cmd0 --flag -> out 0 0" in r.state and "earlier steps omitted" not in r.state
        if budget == 700 and r.prefix_len == 40:
            assert "earlier steps omitted" in r.state


def test_think_steps_are_hidden(spark):
    steps = [("think", "logged", "deep", "{}"), ("ls", "a", None, "{}"), ("think", "logged", "deeper", "{}")]
    d = spark.createDataFrame([("r", "t", "swe", "s", "p", "o/r", "task", steps, True, {})], schema.TRAJECTORY).withColumn("prefix_len", F.lit(3))
    plain = state.render_states(d).first().state
    assert "## step 2\n$ ls" in plain and "think" not in plain
    assert "> deeper" in state.render_states(d, state.StateConfig(thoughts=True)).first().state


def test_pairs_use_each_failure_once(spark):
    rng = random.Random(4)
    rows = [(f"i{k}", f"t{k % 5}", "p", rng.random() < 0.5, rng.random()) for k in range(200)]
    d = spark.createDataFrame(rows, "id string, task_id string, policy_model string, outcome boolean, prefix_frac double")
    out = [r for r in splits.pair_outcomes(d, 0.2).collect() if r.pair_id]
    by = {}
    for r in out:
        by.setdefault(r.pair_id, []).append(r)
    assert out and all(len(v) == 2 and {x.outcome for x in v} == {True, False} and len({x.task_id for x in v}) == 1 and abs(v[0].prefix_frac - v[1].prefix_frac) <= 0.2 for v in by.values())


def test_split_rule_matches_big_integers(spark):
    import hashlib

    keys = [f"own{i}/repo{i}" for i in range(3000)]
    d = spark.createDataFrame([(k,) for k in keys], "k string").select("k", splits.bucket_of(F.col("k")).alias("b"), splits.assign_split(F.col("k")).alias("s"))
    rows = d.collect()
    assert all(r.b == int(hashlib.sha1(f"{splits.SEED}:{r.k}".encode()).hexdigest(), 16) % 100 for r in rows)
    assert abs(sum(r.s == "train" for r in rows) / 3000 - 0.8) < 0.03


def test_candidate_choice():
    def choose(traj, won, norm, fam, length, others):
        got = list(candidates.run_sets(candidates.Run(traj, won, norm, fam), [length], [candidates.Run(t, w, n, f) for t, w, n, f in others], 4, 0, 0.5, "s"))
        return got[0][1:] if got else None

    runs = {"B": (True, ["ls", "edit a", "pytest"]), "C": (False, ["ls", "rm x", "pytest"]), "D": (False, ["ls", "edit a", "pytest"])}
    others = [(t, w, n, n) for t, (w, n) in runs.items()]
    options, correct, tier, sim = choose("A", True, ["ls", "fix y", "submit"], ["ls", "fix y", "submit"], 1, others)
    assert options[correct][:2] == ("fix y", "A") and {o[0] for o in options} == {"fix y", "rm x"} and tier == "branching" and sim == 1.0
    assert choose("A", True, ["ls"], ["ls"], 1, others) is None
    assert choose("A", False, ["ls", "zz", "q"], ["ls"] * 3, 1, [("B", True, ["ls", "zz"], ["ls", "zz"])]) is None  # ambiguous
    assert choose("A", False, ["ls", "zz", "q"], ["ls"] * 3, 1, [("C", False, ["ls", "k"], ["ls", "k"])]) is None  # no success
    assert choose("A", True, ["ls", "submit"], ["ls"] * 2, 1, [("C", False, ["ls", "k"], ["ls", "k"])]) is None  # finish against others


MSG = "role string, text string, system_prompt string, mask boolean, cutoff_date string"


def test_alternating_rows(spark):
    two = "think\n```\nfirst\n```\nthen\n```bash\nls -la\n```"
    wrap = "We are solving this.\nISSUE:\nIt breaks.\n\nINSTRUCTIONS:\nNow go."
    m = lambda *xs: [(r, t, None, None, None) for r, t in xs]
    rows = [
        (0, "own__rep-1", "m", True, m(("system", "s"), ("user", wrap), ("ai", two), ("user", "seen"), ("ai", "bye"))), (1, "own__rep-1", "m", True, m(("system", "s"), ("user", "x"))), (2, "own__rep-1", "m", True, m(("user", "x"), ("ai", "y"), ("user", "z"))),
    ]
    d = spark.createDataFrame(rows, f"row_index long, instance_id string, model_name string, target boolean, trajectory array<struct<{MSG.replace(' string', ':string').replace(' boolean', ':boolean')}>>")
    out = {r.traj_id[-1]: r for r in convert.alternating(d.withColumns({"shard": F.lit("part"), "exit_status": F.lit("ok"), "generated_patch": F.lit(" ")})).collect()}
    s = out["0"].steps
    assert out["0"].task == "It breaks." and out["0"].repo_or_site == "own/rep" and out["0"].meta["has_patch"] == "false"
    assert (s[0].action, s[0].observation, s[0].thought) == ("ls -la", "seen", "think\n```\nfirst\n```\nthen")
    assert (s[1].action, s[1].observation, s[1].thought) == ("message", "", "bye") and json.loads(s[0].extra) == {"n_code_blocks": 2}
    assert out["1"].skip_reason == "empty" and out["2"].skip_reason == "unexpected message prefix"


def test_call_rendering():
    assert convert.parse_call("think", '{"thought": "hm"}') == ("think", "hm", '{"tool": "think", "args": {}}')
    assert convert.tool_action("str_replace_editor", {"command": "view", "path": "/a", "view_range": [1, 2]}) == "str_replace_editor view /a view_range=[1, 2]"
    assert convert.parse_call("x", "not json")[0] == 'x {"_raw": "not json"}'
    assert convert.render_call("f", '{"b": 1, "a": "é"}') == 'f({"a": "é", "b": 1})' and convert.render_call("f", "raw") == "f(raw)"


def test_turn_based_rows(spark):
    kind = "array<struct<role:string,content:string,turn_idx:int,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"
    msgs = [("assistant", "hello", 0, None), ("user", "book it", 1, None), ("assistant", "sure", 2, [("1", "book", '{"b": 2, "a": 1}')]), ("tool", "done", 3, None), ("user", "None", 4, None), ("user", "thanks", 5, None)]
    d = spark.createDataFrame([("/m/pol", "/m/usr", "air", msgs, (1.0, True), ("7[x]", False, "stop", 2.5))], f"model_path string, user_model_path string, task_name string, messages {kind}, eval_result struct<score:double,db_match:boolean>, meta struct<id:string,is_correct:boolean,finish_reason:string,duration_seconds:double>")
    r = convert.turn_based(d).first()
    assert (r.traj_id, r.repo_or_site, r.task, r.outcome) == ("turns/pol/air/7[x]", "turns/air-7_x", "[air customer-service task] book it", True)
    assert [(s.action, s.observation, s.thought) for s in r.steps] == [("say: hello", "user: book it", None), ('book({"a": 1, "b": 2})', "tool: done\nuser: thanks", "sure")]


def test_tool_call_rows(spark):
    call = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
    kind = f"array<struct<role:string,content:string,tool_calls:{call},name:string,tool_call_id:string>>"
    ask = lambda text, *cs: ("assistant", text, [(i, "function", (n, a)) for i, n, a in cs] or None, None, None)
    msgs = [
        ("system", "s", None, None, None), ("user", "x <issue_description> fix </issue_description>", None, None, None), ask("plan", ("1", "execute_bash", '{"command": " ls "}'), ("2", "think", '{"thought": "hm"}')), ("tool", "old", None, None, "1"), ("tool", "out", None, None, "1"),
        ask("bye"), ask("", ("3", "finish", '{"message": "done"}')),
    ]
    rows = [("t", "own__rep-1", None, 1, msgs), ("u", "own__rep-1", None, -1, msgs), ("v", "own__rep-1", None, 0, msgs[:2]), ("w", "own__rep-1", None, 0, [*msgs[:2], msgs[3]])]
    d = spark.createDataFrame(rows, f"trajectory_id string, instance_id string, repo string, resolved int, trajectory {kind}")
    d = d.withColumns({"model_patch": F.lit("p"), "exit_status": F.lit("ok"), "gen_tests_correct": F.lit(0.5), "pred_passes_gen_tests": F.lit(1.0)})
    out = {r.traj_id[-1]: r for r in convert.tool_calls(d).collect()}
    assert [(s.action, s.observation, s.thought) for s in out["t"].steps] == [("ls", "out", "plan"), ("think", "", "hm"), ("message", "", "bye"), ("finish", "", "done")]
    assert out["t"].task == "fix" and out["t"].outcome and [out[k].skip_reason for k in "tuvw"] == [None, "unlabelled", "empty", "no assistant turns"]


def test_files_round_trip(spark, tmp_path):
    d = long_run(spark, 2, 1)
    assert schema.write_trajectories(d, str(tmp_path / "t")) == 1
    assert schema.read_trajectories(spark, str(tmp_path / "t")).first() == d.first()
    row = {"id": "a", "group": "g", "question": "q", "keys": ["false", "true"], "label": 1, "p": [0.4, 0.6]}
    (tmp_path / "a.json").write_text(json.dumps([row]))
    (tmp_path / "b.json").write_text(json.dumps({"rows": [row, row]}))
    assert [files.read_scored(spark, str(tmp_path / n)).count() for n in ("a.json", "b.json")] == [1, 2]
    d.select("traj_id").write.parquet(str(tmp_path / "p"))
    assert files.scan_parquet(spark, str(tmp_path / "p"), ["traj_id"]).first().row_index == 0
    assert "| 1 |" in files.report_markdown("x", spark.createDataFrame([(1, "a")], "n int, s string"))


def test_questions_and_decisions(spark):
    with pytest.raises(ValueError):
        scoring.build_questions(["nope"])
    with pytest.raises(ValueError):
        scoring.build_questions(["best_next"], ["one"])
    assert scoring.option_keys(scoring.build_questions(["best_next"], ["a", "b"])["best_next"]) == ["option_1", "option_2"]
    rows = [(1, s, p, st, e) for s, p, st, e in [(1, 0.0, None, None), (5, 0.01, None, None), (6, 0.01, None, None), (7, None, 0.9, None), (8, 0.01, None, 0.8), (9, 0.01, None, None)]]
    d = spark.createDataFrame(rows, "run_id long, step int, p_success double, stuck double, escalate double")
    got = [(r.step, r.streak, r.decision) for r in scoring.guardian(d).orderBy("step").collect()]
    assert got == [(1, 0, "continue"), (5, 1, "continue"), (6, 2, "abort"), (7, 0, "escalate"), (8, 0, "escalate"), (9, 1, "continue")]


def test_best_of_n_draws_from_all_runs(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if i < 400 else f"t{i % 9}", i % 5 == 0, rng.random()) for i in range(450)]
    d = spark.createDataFrame(rows, "run long, task_id string, outcome boolean, p double")
    order = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("draw")).withColumn("h", F.sha1(F.concat_ws(":", F.lit("0"), "task_id", "draw", "run"))).collect()
    groups = {}
    for r in order:
        groups.setdefault((r.task_id, r.draw), []).append((r.h, r.p, float(r.outcome)))
    got = {r.n: r for r in simulate.best_of_n(d, draws=7).collect()}
    for n in (1, 2, 4, 8):
        firsts = {k: sorted(v)[:n] for k, v in groups.items() if len(v) >= n}
        want = [max(x[1:] for x in v)[1] for v in firsts.values()]
        assert got[n].model == pytest.approx(sum(want) / len(want)) and got[n].groups == len({t for t, _ in firsts})
        assert got[n].random == pytest.approx(sum(v[0][2] for v in firsts.values()) / len(firsts))


def test_registered_simulations_have_full_settings(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_points", lambda *a: spark.range(2).withColumnRenamed("id", "run"))
    monkeypatch.setattr(simulate, "latest_scores", lambda d: d)
    seen = {}
    points, best = simulate.policy_operating_points, simulate.best_of_n
    assert best.__defaults__[1] == 200
    monkeypatch.setattr(simulate, "best_of_n", lambda d, draws=200: seen.update(draws=draws) or spark.createDataFrame([(1, 0.5, 0.5, 1)], "n int, model double, random double, groups long"))
    monkeypatch.setattr(simulate, "policy_operating_points", lambda dev, test, grid: seen.update(grid=grid) or spark.range(1))
    catalog.best_of_n(spark, ""), catalog.policy_operating_points(spark, "")
    assert seen["draws"] == 200 and len(seen["grid"]) == 97 and points.__defaults__ is not None
