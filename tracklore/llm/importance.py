"""Importance resampling towards a target distribution, over hashed runs of words.

Words are found in the bytes of Arrow's UTF-8 buffers, not in Python strings: a table of 256 entries lower-cases A-Z and
says which bytes belong to words, and words begin and end where that changes. The hashes of all words of a batch advance
together, a byte of each word at a time, through the table of the CRC automaton; a run of two words continues from the
state that its first word has left. Counts of the hashed runs are summed over all rows of both tables; how much likelier
a run's bucket is in the target is its gain, and the rows with the highest perturbed mean gains are drawn (Gumbel top-k,
which samples without replacement).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm.common import bounded_batches, frozen, set_aside, table
from tracklore.llm.word_bytes import START, advance, buffer, spans, step

BUCKETS = 10_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: digits, letters, and whatever is beyond ASCII
INSIDE = np.zeros(256, dtype=bool)
INSIDE[ord("0") : ord("9") + 1] = INSIDE[ord("a") : ord("z") + 1] = INSIDE[0x80:] = True


def hashed_runs(texts: pa.Array, most: int = 2) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for each run length 1 to `most` (row, CRC-32) of every run, rows ascending."""
    data, edge = buffer(texts)
    data = LOWER[data]
    at, size, row = spans(data, edge, INSIDE)
    words = np.bincount(row, minlength=len(texts))
    state = advance(np.full(len(at), START), data, at, size)
    runs = [(row, ~state)]
    begins = np.arange(len(at))
    for n in range(1, most):
        more = begins + n < len(at)
        more[more] = row[begins[more] + n] == row[begins[more]]
        begins, state = begins[more], state[more]
        state = advance(step(state, np.uint32(32)), data, at[begins + n], size[begins + n])
        runs.append((row[begins], ~state))
    return words, runs


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most: int = 2) -> DataFrame:
    """(bucket, n) of all runs of 1 to `most` words of all texts. A task sends one row for each bucket that it has met."""
    bounded_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, crc in hashed_runs(b.column(0), most)[1]:
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    sent = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "bucket int, n long")
    return sent.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most: int = 2) -> np.ndarray:
    """1000 times the smoothed log-odds of each bucket, target over docs, floored. The driver holds `buckets` numbers."""
    seen = [np.zeros(buckets, np.int64) for _ in range(2)]
    for own, df in zip(seen, (docs, target)):
        for r in bucket_counts(df, text_col, buckets, most).collect():
            own[r.bucket] = r.n
    (s, S), (t, T) = ((own.tolist(), int(own.sum())) for own in seen)
    over, under = float(S + buckets), float(T + buckets)
    return np.array([math.floor(1000 * math.log((t[b] + 1.0) * over / ((s[b] + 1.0) * under))) for b in range(buckets)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text_col: str = "text", most: int = 2) -> DataFrame:
    """`docs`, whatever its columns are named, with _words, _features and _weight, the floored mean gain of a text's runs (0 without runs)."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(gain)
    df = docs.select("*", F.col(text_col).cast("string").alias("_text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for b in batches:
            words, runs = hashed_runs(b.column(len(names)), most)
            n, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for row, crc in runs:
                upto = np.concatenate(([0], np.cumsum(gain[crc % np.uint32(len(gain))])))
                ends = np.searchsorted(row, np.arange(len(words) + 1))
                n += np.diff(ends)
                total += np.diff(upto[ends])
            mean = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(words.astype(np.int64)), pa.array(n), pa.array(mean)], [*names, "_words", "_features", "_weight"])

    out = docs.select("*", *[F.lit(0).cast("long").alias(c) for c in ("_words", "_features", "_weight")]).schema
    return df.mapInArrow(weigh, out)


def _score(id_col: str, seed: int):
    """Weight plus Gumbel noise that the seed and the row's id give, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.col("_weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_rank(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, most: int = 2) -> DataFrame:
    """`<id_col>`, n_features, weight, score, rank of every row; rank, from 1, is null for rows that are not drawn.

    `percent` of the rows with at least `least_words` words are drawn, the highest scores; of equal scores the smaller id,
    ids that are null last (their noise is that of an empty id); rows equal in both follow their place in the table, so
    repeated rows are drawn one by one. Null text counts as empty, and a text without words has weight 0. Very long texts and
    words are read whole, in linear time. An empty table gives an empty result; an empty target gives gains by the smoothing
    alone. Extra columns are ignored, whatever their names.

    Ranks need no task that sees all rows: the narrow rows are dealt by ranges of the order and kept so, and a row's rank is
    the rows of earlier ranges (one number for each) plus its place in its own."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    gain = gains(docs, target.select(F.col(text_col).alias("_t")), "_t", buckets, most)
    rows = weights(docs, gain, "_t", most).select("_id", "_words", "_features", "_weight", _score("_id", seed).alias("_score"))
    rows = frozen(rows).select("*", (F.col("_words") >= least_words).alias("_may"), F.monotonically_increasing_id().alias("_at"))
    order = [F.desc("_may"), F.desc("_score"), F.asc_nulls_last("_id"), F.asc("_at")]
    dealt = frozen(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)  # partition and place within it
    sizes = sorted(dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_may").alias("may")).collect())
    before = [0, *accumulate(r.n for r in sizes)]
    drawn = percent * sum(r.may for r in sizes) // 100
    starts = F.broadcast(docs.sparkSession.createDataFrame([(r.part, b) for r, b in zip(sizes, before)], "_part long, _before long"))
    place = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    out = dealt.join(starts, part == F.col("_part"))
    return out.select(F.col("_id").alias(id_col), F.col("_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.when(place <= drawn, place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The drawn rows of `importance_rank`, with all columns of `docs` under their own names and importance_rank beside them.
    Rows with the same id are drawn together if any of them is; rows without an id are not drawn."""
    kept, restore = set_aside(docs, ("importance_rank",), (id_col, text_col))
    ranks = importance_rank(docs, target, id_col, text_col, **how).where(F.col("rank").isNotNull() & F.col(id_col).isNotNull())
    ranks = ranks.groupBy(F.col(id_col).alias("_drawn")).agg(F.min("rank").alias("importance_rank"))
    return restore(kept.join(ranks, F.col(id_col) == F.col("_drawn")).drop("_drawn"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
c AS (SELECT side, id, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM c)),
b AS (SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(4 * length(x)), lambda i: (('0x' || substr(x, 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)::INT) & 1),
  lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) % 10000 AS bucket FROM u),
k AS (SELECT side, id, bucket, n FROM c JOIN b USING (f)),
g AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM k GROUP BY bucket),
z AS (SELECT sum(s) AS S_, sum(t) AS T_ FROM g),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (S_ + 10000)::DOUBLE / ((s + 1)::DOUBLE * (T_ + 10000)::DOUBLE)))::BIGINT AS gain FROM g, z),
m AS (SELECT id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM k JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
r AS (SELECT id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
  ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (id) WHERE side = 0),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY words >= 20 DESC, score DESC, id) AS place, 25 * count(*) FILTER (words >= 20) OVER () // 100 AS drawn FROM q)
SELECT id AS doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= drawn THEN place END AS rank FROM p
"""
