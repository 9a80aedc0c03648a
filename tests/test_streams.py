"""Streams with shuffled, late and repeated steps against the batch form; state that is let go; a log that survives a crash."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracklore.operators.scoring import GuardianConfig, guardian
from tracklore.streaming import guardian as G

SCORES = "run_id long, step int, p_success double, stuck double, escalate double, final boolean"
CFG = GuardianConfig(threshold=0.3, min_steps=3, patience=2)


def scores(rng, n_runs, n_steps):
    cell = lambda: rng.choice([None, rng.random()])
    return [(r, s, cell(), cell(), rng.choice([None, 0.1, 0.9]), s == n_steps) for r in range(n_runs) for s in range(1, n_steps + 1)]


def files(spark, rows, path, parts, schema=SCORES):
    """One file a micro-batch."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def batch_form(spark, rows, cfg):
    return sorted((r.run_id, r.step, r.streak, r.decision) for r in guardian(spark.createDataFrame(rows, SCORES), cfg).collect())


def decided(spark, query, log):
    query.awaitTermination()
    return sorted((r.run_id, r.step, r.streak, r.decision) for r in G.read_log(spark, str(log)).collect())


def test_shuffled_and_repeated_steps_are_decided_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = scores(rng, 6, 20)
    sent = rows + rng.sample(rows, 30)  # some come twice
    rng.shuffle(sent)
    G.use_rocksdb(spark)
    out = G.ordered_guard_stream(files(spark, sent, tmp_path / "in", 5), CFG, wait=100, idle_ms=None)
    got = decided(spark, G.log_decisions(out, str(tmp_path / "log"), str(tmp_path / "at"), available_now=True), tmp_path / "log")
    assert got == batch_form(spark, rows, CFG)


def test_a_crash_between_write_and_commit_leaves_each_step_once(spark, tmp_path):
    rng = random.Random(2)
    rows = scores(rng, 5, 12)
    sent = sorted(rows, key=lambda r: r[1])
    G.use_rocksdb(spark)
    stream = files(spark, sent, tmp_path / "in", 4)
    start = lambda then=None: G.log_decisions(G.ordered_guard_stream(stream, CFG, idle_ms=None), str(tmp_path / "log"), str(tmp_path / "at"), then, True)

    def killed(batch, number):
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        start(killed).awaitTermination()
    assert 0 < G.read_log(spark, str(tmp_path / "log")).count() < len(rows)
    seen = []
    got = decided(spark, start(lambda batch, number: seen.append((number, batch.count()))), tmp_path / "log")
    assert got == batch_form(spark, rows, CFG) and min(n for n, _ in seen) == 2


class Cells:
    """State of one key, kept in a dict: what the processors ask of a handle."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()

    def getValueState(self, name, schema, ttlDurationMs=None):
        outer = self

        class Value:
            exists = lambda s: outer.value is not None
            get = lambda s: outer.value

            def update(s, v):
                outer.value = v

            def clear(s):
                outer.value = None

        return Value()

    def getMapState(self, name, key, value, ttlDurationMs=None):
        outer = self

        class Map:
            exists = lambda s: bool(outer.map)
            iterator = lambda s: iter(list(outer.map.items()))
            containsKey = lambda s, k: k in outer.map
            getValue = lambda s, k: outer.map[k]
            removeKey = lambda s, k: outer.map.pop(k)
            updateValue = lambda s, k, v: outer.map.__setitem__(k, v)
            clear = lambda s: outer.map.clear()

        return Map()

    listTimers = lambda self: list(self.timers)
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def feed(processor, steps, now=0):
    import pandas as pd

    rows = pd.DataFrame([(s, 0.1, None, None, f) for s, f in steps], columns=["step", "p_success", "stuck", "escalate", "final"])
    return [tuple(r[1:]) for r in next(processor.handleInputRows((7,), iter([rows]), Now(now))).itertuples(index=False)]


def test_the_buffer_is_bounded_and_idle_runs_leave_the_state():
    cells, processor = Cells(), G._OrderedGuard(CFG, 2, 1000, 1)
    processor.init(cells)
    assert feed(processor, [(1, False), (3, False)]) == [(1, 0, "continue")] and list(cells.map) == [(3,)]
    assert feed(processor, [(5, False), (3, False)]) == [] and sorted(cells.map) == [(3,), (5,)]
    assert [r[0] for r in feed(processor, [(6, False)])] == [3]  # three wait: the oldest goes ahead, step 2 is given up
    assert feed(processor, [(2, False), (3, False)], 50) == [] and cells.timers == {1050}
    assert [r[0] for r in feed(processor, [(4, False)], 60)] == [4, 5, 6] and not cells.map
    assert feed(processor, [(8, False)], 70) == [] and cells.timers == {1070}
    out = next(processor.handleExpiredTimer((7,), Now(1070), None))
    assert out["step"].tolist() == [8] and cells.value is None and not cells.map
    assert [r[0] for r in feed(processor, [(2, True), (1, False)])] == [1, 2] and cells.value[2] and not cells.map
    assert feed(processor, [(3, False), (1, False)]) == [] and not cells.map  # it has ended


def test_an_idle_run_is_let_go(spark, tmp_path):
    """What waits for a step that never comes goes out once the run is idle, and the state store is empty then."""
    G.use_rocksdb(spark)
    rows = [(1, s, 0.1, None, None, False) for s in (1, 2, 4, 5)] + [(2, 1, 0.1, None, None, True)]
    out = G.ordered_guard_stream(files(spark, rows, tmp_path / "in", 1), CFG, idle_ms=1500)
    q = out.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        done = lambda: sorted((r.run_id, r.step) for r in spark.table("idle").collect())
        while time.time() < end and (len(done()) < 5 or not q.lastProgress or sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])):
            time.sleep(0.5)
        assert done() == [(1, 1), (1, 2), (1, 4), (1, 5), (2, 1)]
        assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) == 0
    finally:
        q.stop()


def test_tracked_steps_take_their_place(spark, tmp_path):
    rows = [(1, s, f"a{s}", None) for s in (1, 2, 5, 3, 3, 4, 7, 6, 8)] + [(2, 1, "x", "y")]
    G.use_rocksdb(spark)
    schema = "run_id long, step int, action string, observation string"
    for most in (None, 2):
        path = tmp_path / f"in{most}"
        for r in rows:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(schema).parquet(str(path))
        q = G.track_stream(stream, most).writeStream.format("memory").queryName(f"tracked{most}").option("checkpointLocation", str(tmp_path / f"at{most}")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r.run_id, r.step): r for r in spark.table(f"tracked{most}").collect()}
        assert sorted(got) == [(1, s) for s in range(1, 9)] + [(2, 1)]
        for (run, s), r in got.items():
            if run == 1:
                assert r.prefix_len == s and [x.action for x in r.steps] == [f"a{k}" for k in range(1, s + 1)][-(most or 99) :]


def test_a_late_step_in_the_tracker():
    import pandas as pd

    class Two:
        def __init__(self):
            self.a, self.b = Cells(), Cells()

        def getMapState(self, *a, **k):
            return self.a.getMapState(*a, **k)

        def getValueState(self, *a, **k):
            return self.b.getValueState(*a, **k)

    for most in (None, 2):
        processor = G._Track(most, None)
        processor.init(Two())
        send = lambda *ss: [(r.step, r.prefix_len, [x["action"] for x in r.steps]) for r in next(processor.handleInputRows((1,), iter([pd.DataFrame([(s, f"a{s}", "") for s in ss], columns=["step", "action", "observation"])]), None)).itertuples()]  # noqa: B023, E731
        cut = lambda xs: xs[-most:] if most else xs  # noqa: B023, E731
        assert send(1, 2, 2) == [(1, 1, ["a1"]), (2, 2, ["a1", "a2"])]
        assert send(5) == [(5, 3, cut(["a1", "a2", "a5"]))]
        assert send(9, 5) == [(9, 4, cut(["a1", "a2", "a5", "a9"]))]
        assert send(3) == [(3, 3, cut(["a1", "a2", "a3"]))]
        assert send(10, 11) == [(10, 6, cut(["a1", "a2", "a3", "a5", "a9", "a10"])), (11, 7, cut(["a1", "a2", "a3", "a5", "a9", "a10", "a11"]))]
