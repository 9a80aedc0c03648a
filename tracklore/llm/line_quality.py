"""Quality rules: cross-document line frequency on top of base word rules.

Lines are normalised (words lower-cased, single spaces) and hashed together with their host. Per host, the number of
documents that hold a line is counted; a line in more than max(min_docs, share of the host's documents) is boilerplate
and is removed everywhere but in the host's first document that has it (smallest id). A document is rejected if the base
rules fail or if too few of its words are left. `line_quality` gives the figures, `clean_documents` the texts.

One Python pass over the texts gives features and line hashes, frozen once; the counts shuffle (hash, 1) pairs after
partial aggregation, so a hot host or line costs one row per map task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracklore.llm.common import BLANK, WORD, bounded_batches, frozen, salted_join, set_aside, table

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Above so many boilerplate lines they are joined by a shuffle instead of a broadcast.
BROADCAST_LINES = 200_000


def line_key(host: str | None, words: list[str]) -> int:
    return xxhash.xxh64_intdigest((host or "") + "\0" + " ".join(words).lower()) - (1 << 63)


def features(text: str | None, host: str | None) -> tuple[list[int], list[int], list[int]]:
    """Base figures of a text; hashes of its distinct lines with a word; words in all occurrences of each."""
    text = text or ""
    lines: dict[str, list[int]] = {}
    words: list[str] = []
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if own:
            dup += line in seen
            seen.add(line)
            words += own
            slot = lines.setdefault(" ".join(own).lower(), [0])
            slot[0] += len(own)
    hashes = [line_key(host, [x]) for x in lines]
    figures = [len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeated_words(words)]
    return figures, hashes, [x[0] for x in lines.values()]


def repeated_words(words: list[str], n: int = 5) -> int:
    """Words that lie in a window of n words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple[str, ...], int] = {}
    hit = bytearray(len(words))
    mark = b"\1" * n
    for i, x in enumerate(windows):
        j = first.setdefault(x, i)
        if j != i:
            hit[i : i + n] = mark
            hit[j : j + n] = mark
    return hit.count(1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid, ids, marks, texts, hosts = b.columns
        out = [features(t, h) for t, h in zip(texts.to_pylist(), hosts.to_pylist())]
        cols = list(zip(*(x[0] for x in out))) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [rid, ids, marks, pa.array([xxhash.xxh64_intdigest(h or "") - (1 << 63) for h in hosts.to_pylist()], pa.int64())]
            + [pa.array(c, pa.int64()) for c in cols]
            + [pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.int32()))],
            ["rid", "id", "mark", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "keys", "counts"],
        )


@F.arrow_udf(StringType())
def _without(texts: pa.Array, hosts: pa.Array, cuts: pa.Array) -> pa.Array:
    """Texts without the lines whose keys are in `cuts`; null where that is null."""
    out = []
    for text, host, cut in zip(texts.to_pylist(), hosts.to_pylist(), cuts.to_pylist()):
        keys = set(cut or ())
        out.append(None if text is None else "\n".join(x for x in text.split("\n") if not ((own := _WORD.findall(x)) and line_key(host, own) in keys)))
    return pa.array(out, pa.string())


def _mark(text_col: str, host_col: str) -> Column:
    """Hash of what, beside the id, the verdict on a row depends on. Nulls have marks of their own."""
    host = F.col(host_col).cast("string")
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col), host.isNull(), host)


def _judged(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_docs: int = 20, share: float = 0.01, least_words: int = 10, left_words: int = 10, left_share: float = 0.3,
) -> DataFrame:
    """id, mark, the figures and verdict of each row, and cut: the keys of the lines to remove, null if there are none."""
    bounded_batches(df.sparkSession)
    ids = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), _mark(text_col, host_col).alias("mark"), F.col(text_col).alias("t"), F.col(host_col).cast("string").alias("h"))
    docs = frozen(ids.mapInArrow(_scan, f"rid long, id long, mark long, host long, {FEATURES}, keys array<long>, counts array<int>"))
    lines = docs.select("rid", "id", "host", F.explode(F.arrays_zip("keys", "counts")).alias("l")).select("rid", "id", "host", F.col("l.keys").alias("key"), F.col("l.counts").alias("words"))
    hosts = docs.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    common = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("owner"), F.max("host").alias("host")).where(F.col("n") > min_docs)
    common = frozen(common.join(hosts, "host").where(F.col("n") > F.col("host_docs") * share).select("key", "owner"))
    if common.count() <= BROADCAST_LINES:
        hits = lines.join(F.broadcast(common), "key")
    else:
        hits = salted_join(lines, common, ["key"], F.col("rid"))
    gone = hits.where(~F.col("id").eqNullSafe(F.col("owner"))).groupBy("rid").agg(F.sum("words").alias("gone"), F.collect_set("key").alias("cut"))
    out = docs.drop("keys", "counts", "host").join(gone, "rid", "left").withColumn("n_left_words", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select(
        "id", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left_words",
        (~F.col("base_failed") & (F.col("n_left_words") >= F.greatest(F.lit(float(left_words)), left_share * F.col("n_words")))).alias("kept"), "cut",
    )


def line_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """One row per input row: `<id_col>`, the base figures, base_failed, n_left_words, kept; `limits` as in _judged.

    Null text has no words, fails the base rules and is not kept, as does an empty one; a null host is one host of its
    own. Rows with a null id count as documents but never own a boilerplate line. Repeated rows count as documents each.
    Two lines of one host whose 64-bit hashes collide count as one line. Very long texts are read whole, in time linear in
    their words; a task holds a batch of them. An empty table gives an empty result. Extra columns are ignored, whatever
    their names.
    """
    return _judged(df, id_col, text_col, host_col, **limits).drop("mark", "cut").withColumnRenamed("id", id_col)


def clean_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """The rows of `df` that line_quality keeps, without their boilerplate lines: their texts have n_left_words words.

    Each row has the verdict on its own id, text and host: one without an id stays if it is good, and a rejected row goes
    even if another with its id stays. Other columns pass through, whatever their names."""
    df, back = set_aside(df, (), (id_col, text_col, host_col))
    verdicts = _judged(df, id_col, text_col, host_col, **limits).where("kept").groupBy(F.coalesce("id", F.lit(0)).alias("_id"), F.col("id").isNull().alias("_none"), F.col("mark").alias("_mark")).agg(F.first("cut").alias("_cut"))
    own = F.col(id_col).cast("long")
    out = df.withColumns({"_id": F.coalesce(own, F.lit(0)), "_none": own.isNull(), "_mark": _mark(text_col, host_col)}).join(verdicts, ["_id", "_none", "_mark"])
    hit = F.col("_cut").isNotNull()
    text = F.when(hit, _without(F.when(hit, F.col(text_col)), F.col(host_col).cast("string"), F.col("_cut"))).otherwise(F.col(text_col))
    return back(out.select(*[text.alias(c) if c == text_col else c for c in df.columns]))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their hosts' boilerplate lines."""
    return clean_documents(docs)


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, host, row_number() OVER () AS rn, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
      FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE len(lw) > 0 GROUP BY ALL) GROUP BY doc_id),
nl AS (SELECT doc_id, host, lower(array_to_string(lw, ' ')) AS norm, sum(len(lw)) AS words FROM l WHERE len(lw) > 0 GROUP BY ALL),
hd AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
freq AS (SELECT host, norm, count(*) AS n, min(doc_id) AS owner FROM nl GROUP BY ALL),
bad AS (SELECT host, norm, owner FROM freq JOIN hd USING (host) WHERE n > 20 AND n > host_docs * 0.01),
gone AS (SELECT doc_id, sum(words) AS gone FROM nl JOIN bad USING (host, norm) WHERE doc_id <> owner GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(words) - coalesce(gone, 0) AS BIGINT) AS n_left_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_left_words >= greatest(10, 0.3 * n_words) AS kept FROM b
"""
