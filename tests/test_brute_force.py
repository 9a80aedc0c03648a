"""What SQL cannot say, against plain Python over small tables."""

import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import bootstrap, calibration, candidates, evaluation, features, labels, metrics, scoring, simulate, splits, state, stats
from tracklore.plans import jobs
from tracklore.sources import files


# ------------------------------------------------------------------------------------------------ pairs

def test_pairs_against_a_search_over_all(spark):
    import hashlib

    rng = random.Random(2)
    rows = [(f"r{i}", rng.choice("ab"), "p", rng.random() < 0.5, rng.choice([0.1, 0.2, 0.25, 0.3, 0.5, 0.55, rng.random()])) for i in range(120)]
    got = {r.id: r.pair_id for r in splits.pair_outcomes(spark.createDataFrame(rows, "id string, task_id string, policy_model string, outcome boolean, prefix_frac double"), 0.25, "s").collect()}
    want = dict.fromkeys(got)
    for task in "ab":
        own = sorted((r for r in rows if r[1] == task), key=lambda r: (hashlib.sha1(f"s:{r[0]}".encode()).hexdigest()[:13], r[0]))
        lost = [r for r in own if not r[3]]
        for r in own:
            near = [(abs(x[4] - r[4]), k) for k, x in enumerate(lost) if abs(x[4] - r[4]) <= 0.25]
            if r[3] and near:
                other = lost.pop(min(near)[1])
                want[r[0]] = want[other[0]] = hashlib.sha1(f"{r[0]}|{other[0]}".encode()).hexdigest()[:16]
    assert got == want and sum(v is not None for v in want.values()) > 40


# ------------------------------------------------------------------------------------------------ candidate sets

def plain_set(runs, me, n, k, tol, min_sim, seed):
    """The definition, word for word, over a dictionary of runs: (won, norm, fam)."""
    won, norm, fam = runs[me]
    if n >= len(norm):
        return None
    others = [t for t in sorted(runs, key=lambda t: (hash01(seed, t), t)) if t != me]
    like = {t: len({*fam[:n]} & {*runs[t][2][:n]}) / len(u) if (u := {*fam[:n], *runs[t][2][:n]}) else 1.0 for t in others}
    near = {t: [(a, i) for i, a in enumerate(runs[t][1]) if abs(i - n) <= tol and a] for t in others}
    good = {a for t in others if runs[t][0] for a, _ in near[t]} | ({norm[n]} if won else set())
    bad = [(a, t, i) for t in others if not runs[t][0] for a, i in near[t]] + ([] if won else [(norm[n], me, n)])
    if won:
        yes, sim = (norm[n], me, n), 1.0
    else:
        best = [t for t in others if runs[t][0]]
        best = next((t for t in best if like[t] == max(like[x] for x in best)), None)
        if best is None or not near[best]:
            return None
        a, i = min(near[best], key=lambda x: (abs(x[1] - n), x[1]))
        yes, sim = (a, best, i), like[best]
    if not bad or yes[0] in [b[0] for b in bad]:
        return None
    sha = lambda *x: candidates._rank(*x)
    no, seen = [], set()
    for b in sorted(bad, key=lambda b: sha(seed, me, n, b[1], b[2])):
        if b[0] not in good and (b[0] in ("submit", "finish")) == (yes[0] in ("submit", "finish")) and b[0] not in seen:
            seen.add(b[0])
            no.append(b)
    no = no[: k - 1]
    if not no:
        return None
    sims = [like[b[1]] for b in no if b[1] != me]
    tier = "branching" if sim >= min_sim and sims and max(sims) >= min_sim else "hard_negative"
    options = sorted([(*yes, True), *[(*b, False) for b in no]], key=lambda o: sha(seed, "order", me, n, *o[1:]))
    return options, options.index((*yes, True)), tier, round(sim, 3)


def hash01(seed, key):
    import hashlib

    return int(hashlib.sha1(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / (1 << 52)


@pytest.mark.parametrize("part", [1000, 3])
def test_candidate_sets_against_the_definition(spark, monkeypatch, part):
    monkeypatch.setattr(candidates, "PART_RUNS", part)
    rng = random.Random(5)
    tasks = {}
    for t in range(25):
        tasks[f"t{t}"] = {f"t{t}r{r}": (rng.random() < 0.5, *(x := [rng.choice(["a x", "b", "c y", "edit 1", "", "submit", "ls z"]) for _ in range(rng.randint(1, 9))],), ) for r in range(rng.randint(1, 8))}
    runs = {t: {r: (won, norm, [x.split(" ")[0] for x in norm]) for r, (won, norm) in rs.items()} for t, rs in tasks.items()}
    rows = [(r, t, *v) for t, rs in runs.items() for r, v in rs.items()]
    d = spark.createDataFrame(rows, "traj_id string, task_id string, outcome boolean, norm array<string>, fam array<string>")
    prefixes = d.select("traj_id", "task_id", F.explode(F.sequence(F.lit(1), F.size("norm"))).alias("prefix_len"))
    got = {(r.traj_id, r.prefix_len): ([tuple(o) for o in r.options], r.correct, r.tier, r.prefix_sim) for r in candidates.candidate_sets(prefixes, d).collect()}
    want = {(r, n): s for rs in runs.values() for r in rs for n in range(1, len(rs[r][1]) + 1) if (s := plain_set(rs, r, n, 4, 2, 0.5, "0"))}
    assert got == want and len(want) > 60
    few = candidates.candidate_sets(prefixes, d, max_others=2)
    want = {}
    for rs in runs.values():
        first = sorted(rs, key=lambda t: (hash01("0", t), t))[:3]
        for r in rs:
            own = {t: rs[t] for t in [x for x in first if x != r][:2]} | {r: rs[r]}
            want |= {(r, n): s for n in range(1, len(rs[r][1]) + 1) if (s := plain_set(own, r, n, 4, 2, 0.5, "0"))}
    assert {(r.traj_id, r.prefix_len): ([tuple(o) for o in r.options], r.correct, r.tier, r.prefix_sim) for r in few.collect()} == want


# ------------------------------------------------------------------------------------------------ states

def plain_state(task, policy, lines, blocks, small, cfg):
    """The first state of all that may be tried, each written out and its parts' tokens added up."""
    count, n = state.proxy_count, len(lines)
    first = n - len(blocks)

    def head(h):
        return [f"... {h} earlier steps omitted ..."] if h else []

    def cost(task, h, r, blocks):
        c = count(f"<task>\n{task}\n</task>") + 8 + (count(f"<policy>{policy}</policy>") + 1 if policy is not None else 0)
        c += sum(count(x) + 1 for x in head(h) + lines[h:r]) + (4 if r > h or h else 0)
        return c + sum(count(b) + 2 for b in blocks[r - first :])

    def text(task, h, r, blocks):
        hist = ["<hist>\n" + "\n".join(head(h) + lines[h:r]) + "\n</hist>"] if r > h or h else []
        return "\n".join([f"<task>\n{task}\n</task>", *([f"<policy>{policy}</policy>"] if policy is not None else []), *hist, "<recent>\n" + "\n\n".join(blocks[r - first :]) + "\n</recent>"])

    cut = state.cap(task, count, cfg.task_tokens)
    plans, low = [], 0
    for r in range(first, n):  # full blocks go one by one; what history was given up stays given up
        mine = [h for h in range(low, r + 1) if cost(cut, h, r, blocks) <= cfg.budget]
        low = mine[0] if mine else r
        plans.append((cut, low, r, blocks))
        if mine:
            break
    for form in small if cost(*plans[-1]) > cfg.budget else []:
        plans.append((cut, *plans[-1][1:3], [*blocks[:-1], form]))
        if cost(*plans[-1]) <= cfg.budget:
            break
    if cost(*plans[-1]) > cfg.budget:
        rest = cost(*plans[-1]) - count(f"<task>\n{cut}\n</task>")
        plans.append((state.cap(task, count, max(16, cfg.budget - rest - 8)), *plans[-1][1:]))
    task, h, r, blocks = plans[-1]
    if cost(*plans[-1]) <= cfg.budget - cfg.safety:
        return text(*plans[-1]), cost(*plans[-1])
    while count(text(task, h, r, blocks)) > cfg.budget and (r > h or r < n - 1):
        h, r = (h + 1, r) if r > h else (h, r + 1)
    if (over := count(text(task, h, r, blocks)) - cfg.budget) > 0:
        task = state.cap(task, count, max(8, count(task) - over - 4))
    return text(task, h, r, blocks), count(text(task, h, r, blocks))


def test_states_against_trying_all(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["ab", "cdef", "x", "longerword"]) for _ in range(n))
    for _ in range(1500):
        n = rng.randint(1, 12)
        m = rng.randint(1, min(n, 5))
        lines, blocks = [f"{i}. $ " + words(rng.randint(1, 12)) for i in range(1, n + 1)], [f"## step {i}\n" + words(rng.randint(1, 60)) for i in range(n - m + 1, n + 1)]
        small = [blocks[-1][:k] for k in (80, 40, 20)]
        cfg = state.StateConfig(budget=rng.randint(20, 400), safety=rng.choice([0, 8, 64]), task_tokens=rng.choice([10, 40, 100]))
        task, policy = words(rng.randint(0, 80)), rng.choice([None, "p"])
        assert state.fit(task, policy, lines, blocks, small, cfg) == plain_state(task, policy, lines, blocks, small, cfg)


def test_rendered_rows_against_plain_text(spark):
    """render_states over steps whose texts need no cleaning: lines and blocks written out by hand."""
    rng = random.Random(3)
    runs = [(f"t{i}", "Fix it " * rng.randint(1, 20), rng.choice(["m", "", None]), [(rng.choice(["ls", "edit 1:2", "think"]), " ".join(["seen"] * rng.randint(0, 20)), None) for _ in range(rng.randint(1, 9))]) for i in range(40)]
    d = spark.createDataFrame(runs, "traj_id string, task string, policy_model string, steps array<struct<action:string,observation:string,thought:string>>")
    cfg = state.StateConfig(budget=120, recent_steps=3, safety=8)
    got = {(r.traj_id, r.prefix_len): (r.state, r.state_tokens) for r in state.render_states(labels.expand_prefixes(d), cfg).collect()}
    for traj, task, policy, steps in runs:
        for length in range(1, len(steps) + 1):
            own = [(i, a, o) for i, (a, o, _) in enumerate(steps[:length], 1)]
            seen = [s for s in own if s[1] != "think"] or own[-1:]
            short = lambda o: "(no output)" if not o else o if len(o) <= 100 else o[:97] + "..."
            lines = [f"{i}. $ {a} -> {short(o)}" for i, a, o in seen]
            blocks = [f"## step {i}\n$ {a}\n{o or '(no output)'}" for i, a, o in seen[-3:]]
            assert got[traj, length] == plain_state(task.strip(), policy or "unknown", lines, blocks, [blocks[-1]] * 3, cfg)


# ------------------------------------------------------------------------------------------------ calibration, intervals

def test_temperatures_against_a_fine_search(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, t in (("a", 2.5), ("b", 0.6)):
        z = rng.normal(0, 2, (400, 3))
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        q = np.exp(z / t) / np.exp(z / t).sum(axis=1, keepdims=True)
        rows += [(g, x.tolist(), int(rng.choice(3, p=y))) for x, y in zip(p, q)]
    rows += [("few", [0.5, 0.5], 0)] * 3
    d = spark.createDataFrame(rows, "q string, p array<double>, label int")
    got = {r.q: r for r in calibration.fit_temperatures(d, "q").collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        z, y = np.log(np.array([p for q, p, _ in rows if q == g])), np.array([v for q, _, v in rows if q == g])
        grid = np.exp(np.linspace(math.log(0.2), math.log(10), 20_000))
        cost = [float(np.mean(np.log(np.exp((z - z.max(axis=1, keepdims=True)) / t).sum(axis=1)) - (z[np.arange(len(y)), y] - z.max(axis=1)) / t)) for t in grid[::20]]
        best = grid[::20][int(np.argmin(cost))]
        assert got[g].temperature == pytest.approx(best, rel=0.02) and got[g].nll == pytest.approx(min(cost), abs=1e-5) and got[g].n == 400


def auc(y, p, w):
    won = sum(a * b * (1.0 if pi > pj else 0.5 if pi == pj else 0.0) for yi, pi, a in zip(y, p, w) if yi for yj, pj, b in zip(y, p, w) if not yj)
    return won / (sum(a for yi, a in zip(y, w) if yi) * sum(b for yj, b in zip(y, w) if not yj))


def test_running_sums_and_what_they_give(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANGES", 7)
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randint(0, 1), round(rng.random(), rng.choice([1, 6]))) for _ in range(400)]
    d = spark.createDataFrame(rows, "q string, y int, p double")
    for r in metrics.auroc(d, "y", "p", ["q"]).collect():
        own = [x for x in rows if x[0] == r.q]
        assert r.auroc == pytest.approx(auc([x[1] for x in own], [x[2] for x in own], [1] * len(own)))
    for fpr in (0.0, 0.1, 0.6, 1.0):
        got = metrics.recall_at_fpr(d, "y", "p", fpr).first()
        ok = sorted((x[2] for x in rows if not x[1]), reverse=True)
        k = int(math.floor(fpr * len(ok)))
        thr = ok[k] if k < len(ok) else -math.inf
        fired = [x for x in rows if x[2] > thr]
        assert got.threshold == thr and got.fired == pytest.approx(len(fired) / len(rows))
        assert got.recall == pytest.approx(sum(x[1] for x in fired) / sum(x[1] for x in rows)) and got.precision == pytest.approx(sum(x[1] for x in fired) / max(1, len(fired)))
    one = metrics.recall_at_fpr(d.where("y = 1"), "y", "p", 0.1).first()
    assert one.recall is None and one.threshold is None
    v = sorted(x[2] for x in rows)
    s = stats.rank_percentiles(d, "p").first()
    assert (s.p50, s.p90, s["max"]) == (v[200], v[360], v[-1])


def test_lift_interval(spark):
    rows = [(f"t{i}", float(i % 2), 0.5) for i in range(20)]
    p = spark.createDataFrame(rows, "task_id string, model double, random double")
    r = simulate.lift_interval(p, n_boot=80, seed=1).first()
    # the library numbers the groups and draws their weights; plain drawing has the same law, so its bounds are near
    lifts = dict((f"={t}", b - c) for t, b, c in rows)
    number = {x.g: x.j for x in bootstrap._numbered(spark.createDataFrame([(g,) for g in lifts], "g string"), 20).collect()}
    weights = bootstrap.Draws(1, 20, 80).of(np.arange(20))
    reps = sorted(sum(weights[number[g], i] * x for g, x in lifts.items()) / 20 for i in range(80))
    assert r.point == pytest.approx(0.0) and r.lo == pytest.approx(reps[2]) and r.hi == pytest.approx(reps[78])
    rng = np.random.default_rng(1)
    plain = sorted(np.mean(rng.choice(list(lifts.values()), 20)) for _ in range(4000))
    many = simulate.lift_interval(p, n_boot=4000, seed=2).first()
    assert many.lo == pytest.approx(plain[100], abs=0.051) and many.hi == pytest.approx(plain[3900], abs=0.051)


def test_raw_against_calibrated(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        p = float(rng.uniform(0.02, 0.98))
        rows.append((i, "p_success", "noul", ["no", "true"], int(rng.random() < p), [1 - p, p]))
        rows.append((i, "best_next", "choice", ["a", "b"], int(rng.random() < p), [1 - p, p]))
        rows.append((i, "progress", "score", ["0", "1"], int(rng.random() < p), [1 - p, p]))
    rows += [(i, "stuck", "noul", ["false", "true"], 0, [0.5, 0.5]) for i in range(20)]
    d = spark.createDataFrame(rows, "id long, question string, type string, keys array<string>, label int, p array<double>")
    dev, test = d.where("id % 2 = 0"), d.where("id % 2 = 1")
    got = {(r.question, r.metric): r for r in evaluation.raw_and_calibrated(dev, test).collect()}
    assert {q for q, _ in got} == {"p_success", "best_next", "progress"}
    temps = {r.question: r.temperature for r in calibration.fit_temperatures(dev, "question").collect()}
    for q in ("p_success", "best_next", "progress"):
        own = [(r[4], r[5][1]) for r in rows if r[1] == q and r[0] % 2]
        t = temps[q]
        y, raw = np.array([a for a, _ in own]), np.array([b for _, b in own])
        cal = 1 / (1 + ((1 - raw) / raw) ** (1 / t))
        for side, p in (("raw", raw), ("calibrated", cal)):
            value = lambda m: got[q, m][side]
            assert value("n") == 150
            if q == "p_success":
                assert value("brier") == pytest.approx(np.mean((p - y) ** 2)) and value("auroc") == pytest.approx(auc(y, p, np.ones(150)))
            elif q == "best_next":
                assert value("nll") == pytest.approx(-np.mean(np.log(np.where(y == 1, p, 1 - p)))) and value("top1") == pytest.approx(np.mean((p > 0.5) == y))
            else:
                assert value("mae") == pytest.approx(np.mean(np.abs(p - y)))


# ------------------------------------------------------------------------------------------------ jobs, versions

def test_jobs_and_published_versions(spark, tmp_path):
    said = []
    assert jobs.run([("a", lambda: 1), ("b", lambda: 2)], said.append) == {"a": 1, "b": 2} and said[-1] == "all jobs done"
    with pytest.raises(ZeroDivisionError):
        jobs.run([("x", lambda: 1 / 0), ("y", lambda: said.append("never"))], said.append)
    assert "never" not in said and said[-1].startswith("x: failed")

    path = str(tmp_path / "records")
    steps = [[("ls", "a", None)] * 4, [("edit 1:2", "File updated", None)] * 5]
    runs = spark.createDataFrame(
        [(f"r{i}", "t1", "m", bool(i % 2), steps[i % 2]) for i in range(6)], "traj_id string, task_id string, policy_model string, outcome boolean, steps array<struct<action:string,observation:string,thought:string>>"
    )
    d = labels.expand_prefixes(labels.derive(labels.with_policy_rate(labels.with_task_stats(runs))))
    made = labels.label_prefixes(d).withColumn("id", F.concat_ws("@", "traj_id", "prefix_len")).drop("sig", "steps")
    old = made.withColumn("progress", F.when(F.col("prefix_len") == 1, 3).otherwise(F.col("progress")))
    files.publish(old, path)
    before = {r.id: r.asDict() for r in files.read_published(spark, path).collect()}
    done = jobs.chain(spark, runs, path, str(tmp_path / "report.md"), lambda s: None)
    want = {r.id: r.asDict() for r in made.collect()}
    after = {r.id: r.asDict() for r in files.read_published(spark, path).collect()}
    assert {i: r["progress"] for i, r in after.items()} == {i: r["progress"] for i, r in want.items()} and before.keys() == after.keys()
    assert done["relabel"]["progress"] == sum(before[i]["progress"] != want[i]["progress"] for i in want) and done["relabel"]["p_success"] == 0
    assert "progress" in (tmp_path / "report.md").read_text() and done["label checks"]


# ------------------------------------------------------------------------------------------------ scorers, streams

def test_http_scorer_tries_again(spark):
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(body["state"])
            if calls.count(body["state"]) == 1 and body["state"] == "b":
                self.send_error(503)
                return
            if body["state"] == "bad":
                self.send_error(400)
                return
            out = json.dumps({"answers": {q: {k: 1 / (1 + i) for i, k in enumerate(scoring.option_keys(d))} for q, d in body["questions"].items()}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s = scoring.HttpScorer(f"http://127.0.0.1:{server.server_port}", pause=0.01)
    qs = scoring.build_questions(["p_success", "progress"])
    assert s.score(["a", "b"], [qs, qs]) == [{"p_success": [1.0, 0.5], "progress": [1.0, 0.5, 1 / 3, 0.25]}] * 2 and calls == ["a", "b", "b"]
    with pytest.raises(Exception, match="400"):
        s.score(["bad"], [qs])
    assert calls.count("bad") == 1
    server.shutdown()


def test_questions_and_keys():
    q = scoring.build_questions(["best_next", "stuck"], ["x" * 700, "b"])
    assert scoring.option_keys(q["best_next"]) == ["option_1", "option_2"] and len(q["best_next"]["criteria"]["option_1"]) == 600 and scoring.option_keys(q["stuck"]) == ["false", "true"]
    assert "criteria" not in scoring.QUESTIONS["best_next"]
    for bad in ((["nope"], None), (["best_next"], ["a"]), (["best_next"], None)):
        with pytest.raises(ValueError):
            scoring.build_questions(*bad)
    assert scoring.answers_to_probs(q, {"stuck": {"true": 0.25}}) == {"stuck": [0.0, 0.25]}


def test_tracked_prefixes_and_monitor(spark, tmp_path):
    from tracklore.streaming import guardian as G

    rows = [(r, s, f"a{s}", f"o{r}{s}") for r in (1, 2) for s in range(7)]
    spark.createDataFrame(rows, "run_id long, step int, action string, observation string").coalesce(1).write.parquet(str(tmp_path / "in"))
    G.use_rocksdb(spark)
    stream = lambda: spark.readStream.schema("run_id long, step int, action string, observation string").parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).option("path", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / name)).collect()

    got = {(r.run_id, r.step): r for r in run(G.track_stream(stream()), "track")}
    assert len(got) == 14 and all(r.prefix_len == s + 1 and [x.action for x in r.steps] == [f"a{k}" for k in range(s + 1)] for (_, s), r in got.items())
    score = lambda d: d.select("run_id", "step", F.when(F.col("run_id") == 1, 0.01).otherwise(0.9).alias("p_success"), F.lit(0.0).alias("stuck"), F.lit(0.0).alias("escalate"))
    done = {(r.run_id, r.step): r.decision for r in run(G.monitor(stream(), score), "monitor")}
    assert done[1, 5] == "continue" and done[1, 6] == "abort" and all(done[2, s] == "continue" for s in range(7))


# ------------------------------------------------------------------------------------------------ small ones

def test_held_out_guard_and_shuffle(spark):
    d = spark.createDataFrame([("a", "train"), ("b", "verified_holdout")], "repo string, split string")
    assert stats.assert_held_out(d, d.where("repo = 'b'"), "repo") == 0
    with pytest.raises(ValueError):
        stats.assert_held_out(d, d.where("repo = 'a'"), "repo")
    names = spark.createDataFrame([(f"x{i}",) for i in range(50)], "id string")
    assert [r.id for r in splits.shuffled(names, "s", "id").collect()] == sorted((f"x{i}" for i in range(50)), key=lambda x: hash01("s", x))


def test_split_and_table_writers(spark, tmp_path):
    d = spark.createDataFrame([("a/b", "train", 1), ("c/d", "dev", 2)], "repo string, split string, n int")
    files.write_by_split(d, str(tmp_path / "by"))
    assert {(r.repo, r.split, r.n) for r in spark.read.parquet(str(tmp_path / "by")).collect()} == {("a/b", "train", 1), ("c/d", "dev", 2)} and (tmp_path / "by" / "split=dev").is_dir()
    files.write_split_table(d.select("repo", "split"), str(tmp_path / "table"), "hash")
    assert [(r.repo, r.split, r.rule) for r in spark.read.json(str(tmp_path / "table")).orderBy("repo").collect()] == [("a/b", "train", "hash"), ("c/d", "dev", "hash")]
    spark.createDataFrame([(1, "x")], "a int, b string").write.json(str(tmp_path / "lines" / "one.jsonl"))
    assert files.scan_parquet(spark, str(tmp_path / "by"), ["n"], limit=1).count() == 1


def test_only_question_and_yes(spark):
    rows = [("p_success", None, ["False", "True"], [0.3, 0.7]), ("p_success", "misleading", ["a"], [1.0]), ("stuck", None, ["a"], [1.0]), ("p_success", "clean", ["yes", "no"], [0.2, 0.8]), ("p_success", "clean", ["a", "b"], [0.4, 0.6])]
    d = spark.createDataFrame(rows, "question string, variant string, keys array<string>, p array<double>")
    assert sorted(r.p for r in simulate.only_question(d).collect()) == [0.2, 0.6, 0.7]


def test_heuristic_scores(spark):
    x = dict.fromkeys(features.FEATURES, 0.0) | {"prefix_len": 4.0, "recent_error_lines": 2.0, "stuck_rule": 1.0, "recent_repeat_actions": 3.0, "last_passed": 5.0, "last_failed": 1.0, "progress_rule": 2.0}
    d = spark.createDataFrame([(tuple(x.values()),)], f"features_by_name struct<{', '.join(f'{k}: double' for k in x)}>")
    assert d.select(*[c.alias(n) for n, c in features.heuristic_scores().items()]).first().asDict() == {"few_steps": -4.0, "few_errors": -2.0, "not_stuck": -6.0, "tests_pass": 8.0}


def test_logits_dispatch_and_given_prefixes(spark):
    from tracklore.functions import arrays
    from tracklore.operators import losses

    d = spark.createDataFrame([("score", [0.2, 0.3, 0.5], 1, [1.0, 2.0, 3.0]), ("noul", [0.2, 0.0, 0.8], 2, None)], "type string, p array<double>, label int, z array<double>")
    got = losses.question_loss(d.withColumn("made", arrays.logits(F.col("p"), F.col("z")))).collect()
    cuts = [-math.log(0.8), -math.log(1 - 0.5)]
    assert got[0].loss == pytest.approx(sum(cuts) / 2 - 0.5 * math.log(0.3)) and got[0].made == [1.0, 2.0, 3.0]
    assert got[1].loss == pytest.approx(-math.log(0.8)) and got[1].made == pytest.approx([math.log(0.2), math.log(1e-9), math.log(0.8)])
    runs = spark.createDataFrame([("a", ["x"] * 8)], "traj_id string, steps array<string>")
    assert [(r.prefix_len, r.n_steps, r.prefix_frac) for r in labels.expand_prefixes(runs, F.array(F.lit(3), F.lit(8))).collect()] == [(3, 8, 0.375), (8, 8, 1.0)]


def test_tiers_of_sets(spark):
    rows = [("a", "t", True, ["x", "y", "z"]), ("b", "t", False, ["x", "q", "r"]), ("c", "t", False, ["m", "n", "z"])]
    d = spark.createDataFrame([(*r, r[3]) for r in rows], "traj_id string, task_id string, outcome boolean, norm array<string>, fam array<string>")
    sets = candidates.candidate_sets(d.select("traj_id", "task_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("prefix_len")), d)
    count = {}
    runs = {r[0]: (r[2], r[3], r[3]) for r in rows}
    for r in runs:
        for n in (1, 2):
            if got := plain_set(runs, r, n, 4, 2, 0.5, "0"):
                count[got[2]] = count.get(got[2], 0) + 1
    assert {r.tier: r.n for r in stats.frequency(sets, "tier").collect()} == count and count


def test_used_and_kept_keys(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "id string, n int")
    keys = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    assert [r.n for r in splits.only(d, keys, "id").collect()] == [1]
    assert sorted(r.n for r in splits.without(d, keys, "id").collect()) == [2, 3, 4]
