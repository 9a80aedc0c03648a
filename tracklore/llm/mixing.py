"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are put in hash order and cut into blocks. The i-th block (from 0) of a source with weight w is
released at floor(i / w) and due at ceil((i + 1) / w); in each slot, of the blocks released, the one with the earliest
deadline goes out. At any time a source is then less than one block away from its share. Weights are exact fractions of
the numbers given, so the deviation is from the target itself and does not grow with the schedule.

The schedule is cut into frames of slots. What has gone out by the end of a frame is computed without its slots, see
`advance`, so the driver takes one step per frame and source; the slots of each frame are then dealt in parallel. Every
row goes out at least once; a source whose weight exceeds its share of the rows starts over (epochs) until the source
that takes longest is through.

Places within a source come from counts per (source, bucket) and a row number within a bucket, so a hot source is
spread over a number of groups that follows its size. A block's slots reach its rows as an array over their bucket, whose
partitions they share; rows of a source with very many epochs are dealt to several tasks by epoch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklore.llm.common import frozen, set_aside, table
from tracklore.session import ready

BUCKET_ROWS = 2_000
#: A bucket with the rows of so many holds an id that repeats.
CROWD = 16
#: Blocks and epochs whose slots travel as one array.
CHUNK_BLOCKS, CHUNK_EPOCHS = 64, 64
#: Frames times sources on the driver; frames get longer beyond.
MOST_COUNTS = 1 << 21
RESULTS = ("slot", "place", "epoch")


def exact(weights: list[float]) -> tuple[list[int], int]:
    """Integers in the ratio of the weights, and their sum: w is parts / whole without any rounding."""
    fractions = [Fraction(w) for w in weights]
    scale = lcm(*(f.denominator for f in fractions))
    parts = [int(f * scale) for f in fractions]
    common = gcd(*parts)
    parts = [p // common for p in parts]
    return parts, sum(parts)


def free_slots(start: int, stop: int, parts: list[int], whole: int) -> list[tuple[int, int]]:
    """(release, slots) for the blocks released after `start` and due after `stop`: how many blocks with that release or a
    later one can go out by `stop` beside those due by then. It does not depend on what has gone out before."""
    due = [p * stop // whole for p in parts]
    times = {r for i, p in zip(due, parts) if i * whole < p * stop and (r := i * whole // p) > start}
    released = [0] * (stop - start)
    for i, p in zip(due, parts):
        for k in range(-(-p * (start + 1) // whole), i):
            released[k * whole // p - start] += 1
    out, left, after = [], stop - start, []
    for r in range(stop - 1, start, -1):  # slots from r on, less what must go of the blocks released from r on
        left = (left if after else 0) + 1 - released[r - start]
        after.append(left)
    for r, left in zip(range(start + 1, stop), reversed(after)):
        out.append(min(left, out[-1] if out else left))
    return [(r, out[r - start - 1]) for r in sorted(times)]


def advance(sent: list[int], start: int, stop: int, parts: list[int], whole: int, free: list[tuple[int, int]]) -> list[int]:
    """Blocks of each source that have gone out by slot `stop`, given those by `start`.

    Blocks due by `stop` must go. Of the others released before it (one a source at most) as many go as slots are left,
    those with the earliest deadlines among the sets that fit: what is released from r on must fit into the slots from r
    on. These sets are a matroid, so the greedy choice leaves the least due at every later time; since some schedule
    exists, one exists from there."""
    must = [max(c, p * stop // whole) for c, p in zip(sent, parts)]
    room = stop - start - sum(must) + sum(sent)
    open_: dict[int, list[tuple[int, int]]] = {}
    for s, (i, p) in enumerate(zip(must, parts)):
        if i * whole < p * stop:
            open_.setdefault(max(start, i * whole // p), []).append((-(-(i + 1) * whole // p), s))
    out = list(must)
    levels = [(start, room), *((r, min(room, n)) for r, n in free), (stop, 0)]
    heap: list[tuple[int, int]] = []
    for (r, n), (_, later) in zip(levels, levels[1:]):
        for x in open_.get(r, ()):
            heapq.heappush(heap, x)
        for _ in range(min(len(heap), n - later)):
            out[heapq.heappop(heap)[1]] += 1
    return out


def frame_slots(sent: list[int], goal: list[int], start: int, stop: int, parts: list[int], whole: int) -> tuple[list[int], list[int]]:
    """(source, block) of each slot from `start` to `stop` by earliest deadline; ties by source. `sent` and `goal` are the
    blocks that have gone out at both ends."""
    released: list[list[tuple[int, int, int]]] = [[] for _ in range(stop - start)]
    for s, (a, z, p) in enumerate(zip(sent, goal, parts)):
        for i in range(a, z):
            released[max(start, i * whole // p) - start].append((min(stop, -(-(i + 1) * whole // p)), s, i))
    waiting: list[tuple[int, int, int]] = []
    sources, blocks = [], []
    for fresh in released:
        for x in fresh:
            heapq.heappush(waiting, x)
        _, s, i = heapq.heappop(waiting)
        sources.append(s)
        blocks.append(i)
    return sources, blocks


def frames(parts: list[int], whole: int, slots: int, frame: int, spark: SparkSession | None = None) -> list[tuple[int, int, list[int], list[int]]]:
    """(start, stop, sent, goal) of the frames of a schedule of `slots` slots; the blocks of a frame are looked at in tasks
    of `spark`."""
    ends = [(a, min(slots, a + frame)) for a in range(0, slots, frame)]
    if spark is None:
        free = [free_slots(a, z, parts, whole) for a, z in ends]
    else:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [free_slots(a, z, parts, whole) for a, z in zip(*(c.to_pylist() for c in b.columns))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.list_(pa.int64())))], ["start", "free"])

        rows = ready(spark).createDataFrame(ends, "start long, stop long").repartition(_tasks(spark, len(ends))).mapInArrow(scan, "start long, free array<array<long>>")
        free = [[tuple(x) for x in r.free] for r in sorted(rows.collect())]
    out, sent = [], [0] * len(parts)
    for (start, stop), own in zip(ends, free):
        goal = advance(sent, start, stop, parts, whole, own)
        out.append((start, stop, sent, goal))
        sent = goal
    return out


def _tasks(spark: SparkSession, n: int) -> int:
    return max(1, min(n, 4 * spark.sparkContext.defaultParallelism))


def default_weights(sizes: dict[str, int], power: float = 0.7) -> dict[str, float]:
    """Temperature weights: size to the given power."""
    return {s: n**power for s, n in sizes.items()}


def schedule(spark: SparkSession, plan: list[tuple[int, int, list[int], list[int]]], parts: list[int], whole: int) -> DataFrame:
    """(k, turn, slot) of all frames: the number of the source, its block counted through all epochs, and its slot."""
    ready(spark)
    rows = spark.createDataFrame(plan, "start long, stop long, sent array<long>, goal array<long>").repartition(_tasks(spark, len(plan)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, sent, goal in zip(*(c.to_pylist() for c in b.columns)):
                k, turn = frame_slots(sent, goal, start, stop, parts, whole)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(turn, pa.int64()), pa.array(np.arange(start, stop))], ["k", "turn", "slot"])

    return rows.mapInArrow(deal, "k int, turn long, slot long")


def mix(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None,
    block_rows: int = 8, frame: int = 1024, seed: int = 7,
) -> DataFrame:
    """`df` plus slot, place (within the slot's block) and epoch; order by slot and place to read the mix.

    Without `weights`, sizes to the power 0.7. Weights must be positive; a source without one raises ValueError, a
    weight without rows is ignored. A null source is a source named ''. Null texts, empty and very long ones are rows
    like any other: texts are not looked at. Rows with equal or null ids keep a defined place up to exchanges among rows
    that are equal in hash and id. An empty table gives an empty result. Other columns pass through, whatever their
    names, but input columns slot, place and epoch give way to the results. Where one id, or none, is on more rows than CROWD buckets
    hold, those rows are dealt over the buckets by their number.

    The driver holds one row per source, as the weights are, and the counts at the ends of frames of `frame` slots or, for
    very long schedules, more.
    """
    df, back = set_aside(df.drop(*RESULTS), (), (id_col, source_col))
    spark = df.sparkSession
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    sizes = {r["s"]: r["n"] for r in df.groupBy(src.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return back(df).withColumns({"slot": F.lit(0).cast("long"), "place": F.lit(0), "epoch": F.lit(0)})
    weights = default_weights(sizes) if weights is None else weights
    if lost := [s for s in sizes if not weights.get(s, 0) > 0]:
        raise ValueError(f"no weight for {lost[:5]}")
    names = sorted(sizes)
    parts, whole = exact([weights[s] for s in names])
    blocks = [ceil(sizes[s] / block_rows) for s in names]
    slots = max(-(-n * whole // p) for n, p in zip(blocks, parts))  # until each block has gone out once
    made = frames(parts, whole, slots, max(frame, 4 * len(names), ceil(slots * len(names) / MOST_COUNTS)), spark)
    sent = made[-1][3]
    n_buckets = [ceil(sizes[s] / BUCKET_ROWS) for s in names]
    n_parts = [ceil(ceil(c / n) / CHUNK_EPOCHS) for c, n in zip(sent, blocks)]
    sources = spark.createDataFrame(list(zip(names, range(len(names)), n_buckets, blocks, n_parts)), "_s string, _k int, _nb long, _blocks long, _ne long")

    # the slots of 64 blocks in 64 epochs, in order of turn: those that are missing are the last
    turns = schedule(spark, made, parts, whole).join(F.broadcast(sources.select(F.col("_k").alias("k"), "_blocks")), "k")
    turns = turns.select(F.col("k").alias("_k"), F.expr(f"(turn % _blocks) div {CHUNK_BLOCKS}").alias("_g"), F.expr(f"(turn div _blocks) div {CHUNK_EPOCHS}").alias("_e"), F.struct("turn", "slot").alias("x"))
    chunks = turns.groupBy("_k", "_g", "_e").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["slot"]).alias("_at"))

    # buckets are ranges of the hash, so bucket order is hash order
    bucket = F.least(F.col("_nb") - 1, F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_nb"))).cast("long")
    in_order = lambda df: df.withColumn("_s", src).join(F.broadcast(sources), "_s").withColumn("_h", F.xxhash64(F.lit(seed), F.col(id_col)))
    rows = in_order(df).withColumn("_b", bucket)
    crowd = CROWD * BUCKET_ROWS
    if not rows.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).isEmpty():
        # ids that are null, or the same, in that many rows have one hash: their rows are told apart by their number in a table that stays as it is
        hot = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select("_h", F.lit(True).alias("_hot"))
        rows = in_order(frozen(df)).withColumn("_i", F.monotonically_increasing_id()).join(F.broadcast(frozen(hot)), "_h", "left")
        rows = rows.withColumn("_h", F.when(F.col("_hot"), F.xxhash64(F.lit(seed), "_h", "_i")).otherwise(F.col("_h"))).drop("_i", "_hot").withColumn("_b", bucket)
    counts = rows.groupBy("_k", "_b", "_ne").agg(F.count(F.lit(1)).alias("_n")).withColumn("_many", F.expr("_b div 1024"))
    before = lambda n, *keys: F.coalesce(F.sum(n).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = counts.groupBy("_k", "_many").agg(F.sum("_n").alias("_t"))
    wide = wide.select("_k", "_many", before("_t", "_k", "_many").alias("_from"))
    starts = counts.join(wide, ["_k", "_many"]).withColumn("_start", F.col("_from") + before("_n", "_k", "_many", "_b"))
    first, last = f"_start div {block_rows * CHUNK_BLOCKS}", f"(_start + _n - 1) div {block_rows * CHUNK_BLOCKS}"
    wanted = starts.withColumn("_e", F.explode(F.expr("sequence(0L, _ne - 1)"))).withColumn("_g", F.explode(F.expr(f"sequence({first}, {last})")))
    held = wanted.join(chunks, ["_k", "_g", "_e"], "left").groupBy("_k", "_b", "_e").agg(
        F.first("_start").alias("_start"), F.min("_g").alias("_g0"), F.transform(F.array_sort(F.collect_list(F.struct("_g", F.coalesce("_at", F.array().cast("array<long>")).alias("_at")))), lambda x: x["_at"]).alias("_held")
    )

    rows = rows.withColumn("_e", F.explode(F.expr("sequence(0L, _ne - 1)")))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_k", "_b", "_e").orderBy("_h", id_col)))
    rows = rows.join(held, ["_k", "_b", "_e"]).withColumn("_at", F.col("_start") + F.col("_rn") - 1)
    rows = rows.withColumns({"_block": F.expr(f"_at div {block_rows}"), "place": F.expr(f"cast(_at % {block_rows} as int)")})
    rows = rows.withColumns({"_own": F.expr(f"element_at(_held, cast(_block div {CHUNK_BLOCKS} - _g0 + 1 as int))"), "_j": F.expr(f"cast(_block % {CHUNK_BLOCKS} as int)"), "_w": F.expr(f"cast(least({CHUNK_BLOCKS}L, _blocks - _block div {CHUNK_BLOCKS} * {CHUNK_BLOCKS}) as int)")})
    rows = rows.withColumn("_m", F.explode(F.expr("CASE WHEN _j < size(_own) THEN sequence(0, (size(_own) - 1 - _j) div _w) END")))
    rows = rows.withColumns({"slot": F.expr("element_at(_own, cast(_j + _m * _w + 1 as int))"), "epoch": F.expr(f"cast(_e * {CHUNK_EPOCHS} + _m as int)")})
    return back(rows.select(*df.columns, *RESULTS))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, over the files and within each; a source below its weight comes again."""
    docs, back = set_aside(docs, RESULTS)
    mixed = mix(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return back(mixed.repartitionByRange(n, "slot").sortWithinPartitions("slot", "place").select(*docs.columns))
