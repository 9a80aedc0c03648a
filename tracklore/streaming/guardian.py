"""The guardian and the run tracker on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracklore.operators.scoring import GuardianConfig


def _decide(cfg: GuardianConfig, step: int, streak: int, p, stuck, esc) -> tuple[int, int, str]:
    """The streak of low scores after a step, what is shown of it, and the decision."""
    if step < cfg.min_steps:
        return streak, 0, "continue"
    if pd.notna(esc) and esc >= cfg.escalate:
        return streak, 0, "escalate"
    if pd.notna(p) and p < cfg.threshold:
        return streak + 1, streak + 1, "abort" if streak + 1 >= cfg.patience else "continue"
    return 0, 0, "escalate" if pd.notna(stuck) and stuck >= cfg.stuck else "continue"


class _Guard(StatefulProcessor):
    """State of a run: its streak of low scores and the last step that was decided. Steps of one batch are put in order;
    a step at or before the last one is late and is answered with decision `late`, without touching the state."""

    def __init__(self, cfg: GuardianConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("guard", "streak int, last int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, last = self.state.get() if self.state.exists() else (0, -1)
        steps = pd.concat(list(rows)).sort_values("step")
        out = []
        for s, p, stuck, esc in zip(steps["step"], steps["p_success"], steps["stuck"], steps["escalate"]):
            if s <= last:
                out.append((key[0], int(s), int(streak), "late"))
                continue
            last = int(s)
            streak, shown, decision = _decide(self.cfg, last, streak, p, stuck, esc)
            out.append((key[0], last, int(shown), decision))
        self.state.update((int(streak), int(last)))
        yield pd.DataFrame(out, columns=["run_id", "step", "streak", "decision"])

    def close(self) -> None:
        pass


DECISIONS = "run_id long, step int, streak int, decision string"


class _OrderedGuard(StatefulProcessor):
    """As _Guard, with a buffer of the steps that wait for one before them. What a run keeps: its streak and last decided
    step, the waiting steps in a map by their number, and one timer."""

    def __init__(self, cfg: GuardianConfig, wait: int, idle_ms: int | None, first: int) -> None:
        self.cfg, self.wait, self.idle_ms, self.first = cfg, wait, idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = 4 * self.idle_ms if self.idle_ms else None
        self.state = handle.getValueState("guard", "streak int, last int, ended boolean", ttlDurationMs=ttl)
        self.held = handle.getMapState("held", "step int", "p double, stuck double, escalate double, final boolean", ttlDurationMs=ttl)

    def _release(self, key, waiting: dict[int, tuple], streak: int, last: int, most: int) -> tuple[list[tuple], int, int, bool]:
        """Decides what follows the last step without a gap, and the oldest of what waits while more than `most` do."""
        out, ended = [], False
        for s in sorted(waiting):
            if ended or not (s == last + 1 or len(waiting) > most):
                break
            p, stuck, esc, final = waiting.pop(s)
            streak, shown, decision = _decide(self.cfg, s, streak, p, stuck, esc)
            out.append((key[0], s, shown, decision))
            last, ended = s, bool(final)
        return out, streak, last, ended

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, last, ended = self.state.get() if self.state.exists() else (0, self.first - 1, False)
        known = {int(k[0]): tuple(v) for k, v in self.held.iterator()} if self.held.exists() else {}
        waiting = dict(known)
        for batch in rows:
            for s, p, stuck, esc, final in zip(batch["step"], batch["p_success"], batch["stuck"], batch["escalate"], batch["final"]):
                if not ended and s > last and int(s) not in waiting:
                    clean = [None if pd.isna(x) else float(x) for x in (p, stuck, esc)]
                    waiting[int(s)] = (*clean, bool(final) if pd.notna(final) else False)
        out = []
        if not ended:
            out, streak, last, ended = self._release(key, waiting, streak, last, self.wait)
            self.state.update((int(streak), int(last), ended))
        for s in known:
            if s not in waiting or ended:
                self.held.removeKey((s,))
        for s, cells in waiting.items():
            if s not in known and not ended:
                self.held.updateValue((s,), cells)
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["run_id", "step", "streak", "decision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            streak, last, ended = self.state.get()
            waiting = {int(k[0]): tuple(v) for k, v in self.held.iterator()} if self.held.exists() else {}
            if not ended:
                out = self._release(key, waiting, streak, last, 0)[0]
        self.state.clear()
        self.held.clear()
        yield pd.DataFrame(out, columns=["run_id", "step", "streak", "decision"])

    def close(self) -> None:
        pass


def ordered_guard_stream(steps: DataFrame, cfg: GuardianConfig = GuardianConfig(), wait: int = 64, idle_ms: int | None = 3_600_000, first: int = 1, mode: str = "append") -> DataFrame:
    """(run_id, step, streak, decision), each step once and in the order of its number, for a stream of run_id, step,
    p_success, stuck, escalate and, if it has one, `final`, which says that a run's last step this is.

    A step that comes before its predecessors waits for them while at most `wait` steps of its run do; then the oldest goes ahead and
    what it waited for is given up. Repeated steps, steps at or before the last decided one, and steps of a run that
    has ended are not answered again. A run without steps for `idle_ms` of processing time is let go: what waits is decided in order,
    and its state is removed, as is that of an ended run; a time to live of four times that removes what timers never
    reach. Timers keep a query going, so one that is to end with the data at hand has `idle_ms` None and lets no run go. Needs the
    RocksDB state store (see `use_rocksdb`)."""
    if "final" not in steps.columns:
        steps = steps.withColumn("final", F.lit(False))
    return steps.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_OrderedGuard(cfg, wait, idle_ms, first), outputStructType=DECISIONS, outputMode=mode, timeMode="ProcessingTime" if idle_ms else "None"
    )


def guard_stream(steps: DataFrame, cfg: GuardianConfig = GuardianConfig(), mode: str = "update") -> DataFrame:
    """(run_id, step, streak, decision) for a stream of run_id, step, p_success, stuck, escalate. Needs the RocksDB state
    store (see `use_rocksdb`)."""
    return steps.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_Guard(cfg), outputStructType=DECISIONS, outputMode=mode, timeMode="None"
    )


class _Track(StatefulProcessor):
    """Keeps a run's steps by their number and gives the prefix of each new one, or the last `most` steps of it."""

    def __init__(self, most: int | None, idle_ms: int | None) -> None:
        self.most, self.ttl = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "step int", "action string, observation string", ttlDurationMs=self.ttl)
        self.end = handle.getValueState("end", "n int, last int", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.end.get() if self.end.exists() else (0, None)
        fresh = pd.concat(list(rows)).sort_values("step", kind="stable").drop_duplicates("step")
        late = last is not None and int(fresh["step"].iloc[0]) <= last
        # the whole run is read only where all of it goes out, where a step is late, or where numbers leave gaps
        held = {int(k[0]): tuple(v) for k, v in self.steps.iterator()} if n and (late or not self.most) else {}
        if n and not held:
            for s in range(last, last - self.most, -1):
                if self.steps.containsKey((s,)):
                    held[s] = tuple(self.steps.getValue((s,)))
            if len(held) < min(n, self.most):
                held = {int(k[0]): tuple(v) for k, v in self.steps.iterator()}
        before = n - len(held)  # steps that are known and not read
        out = []
        for s, action, observation in zip(fresh["step"], fresh["action"], fresh["observation"]):
            s = int(s)
            if s in held:
                continue
            held[s] = (action, observation)
            self.steps.updateValue((s,), held[s])
            n, last = n + 1, s if last is None else max(last, s)
            upto = sorted(k for k in held if k <= s)
            shown = upto[-self.most :] if self.most else upto
            out.append((key[0], s, before + len(upto), [{"action": held[k][0], "observation": held[k][1]} for k in shown]))
        self.end.update((n, last))
        yield pd.DataFrame(out, columns=["run_id", "step", "prefix_len", "steps"])

    def close(self) -> None:
        pass


def track_stream(steps: DataFrame, most: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """(run_id, step, prefix_len, steps) for a stream of run_id, step, action, observation: what a scorer gets. With `most`,
    only the last so many steps are read and go out each time, which keeps the work for long runs in proportion to their steps. A
    late step takes its place, and its prefix is what is known up to it; a repeated one is not answered again. With `idle_ms`, a
    step leaves the state so long after it came; like all timers that keeps a query going."""
    return steps.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_Track(most, idle_ms), outputStructType="run_id long, step int, prefix_len int, steps array<struct<action:string,observation:string>>", outputMode="append",
        timeMode="ProcessingTime" if idle_ms else "None",
    )


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def monitor(steps: DataFrame, score, cfg: GuardianConfig = GuardianConfig(), most: int | None = None) -> DataFrame:
    """Append, score, decide: `score` is a function from tracked prefixes (run_id, step, prefix_len, steps) to run_id, step,
    p_success, stuck, escalate."""
    return guard_stream(score(track_stream(steps, most)), cfg, "append")


def log_decisions(decisions: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, available_now: bool = False) -> StreamingQuery:
    """Writes a stream of decisions to a log, and calls `then` (alerts, say) with each batch that is written.

    A batch has a folder of its own, named by its number, which is replaced as a whole: a batch that is run again, after a crash
    between its write and its commit, leaves its rows once. `read_log` gives them back."""
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
            if then:
                then(batch, number)
        finally:
            batch.unpersist()

    out = decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The decisions of a log, without the numbers of their batches."""
    return spark.read.parquet(path).drop("batch")
