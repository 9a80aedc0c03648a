"""Exact dedup by deterministic block naming.

Each normalised text is cut into fixed-size byte blocks. Equal blocks, compared byte by byte in sorted order, get one
integer name; then the names of adjacent blocks are paired and the pairs named, until one name identifies the whole
text. Names never collide, since a name stands for one block or one ordered pair of names.

Texts travel through one shuffle. A block with more than HOT_SHARE of all blocks is dealt to as many tasks as its share
asks for; the names that it gets there (fewer than 5 / HOT_SHARE rows, whatever the input) are unified by a broadcast join.
Names that many rows share are joined in parts in the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklore.llm.common import BLANK, HOT_SHARE, frozen, hot_join, hot_keys, table


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192) -> DataFrame:
    """One row per input row: `<id_col>`, keep_id, group_size, kept, text_sha256, n_blocks.

    Null text counts as empty; empty texts form one group like any other. Of equal texts the row with the smallest id
    stays; rows with a null id stay only if no row of their group has an id. Repeated rows (same id and text) are all
    marked kept if their id is the group's smallest. Very long texts are cut into blocks like any other; a task holds the
    one it reads. An empty table gives an empty result; extra columns are ignored, whatever their names.
    """
    norm = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANK, " ").alias("t"))
    raw = norm.select("rid", "id", F.unhex(F.sha2("t", 256)).alias("sha"), F.encode("t", "UTF-8").alias("b"), F.length("t").alias("chars"))
    blocks = raw.select(
        "rid", "id", "sha", F.greatest(F.lit(1), F.ceil(F.octet_length("b") / F.lit(block_bytes))).cast("int").alias("n"), "b"
    ).select(
        "rid", "id", "sha", "n",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"),
    ).withColumn("h", F.xxhash64("block"))

    hot = _hot(blocks)
    if hot:
        parts = F.broadcast(df.sparkSession.createDataFrame(hot, "h long, parts int"))
        blocks = blocks.join(parts, "h", "left").withColumns({"hot": F.col("parts").isNotNull(), "salt": F.coalesce(F.pmod(F.xxhash64("rid"), "parts"), F.lit(0))})
    else:
        blocks = blocks.withColumns({"hot": F.lit(False), "salt": F.lit(0).cast("long")})
    w = Window.partitionBy("h", "salt").orderBy("block")
    named = (
        blocks.withColumn("first", ~F.col("block").eqNullSafe(F.lag("block").over(w)))
        .withColumn("mid", F.monotonically_increasing_id())
        .withColumn("name", F.max(F.when(F.col("first"), F.col("mid"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .select("rid", "id", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "n", "pos", "name", F.when(F.col("hot") & F.col("first"), F.col("block")).alias("hot_block"))
    )
    named = frozen(named)
    if hot:
        twins = named.where(F.col("hot_block").isNotNull()).select("hot_block", "name")
        canon = twins.groupBy("hot_block").agg(F.min("name").alias("canon"))
        named = named.join(F.broadcast(twins.join(canon, "hot_block").select("name", "canon")), "name", "left").withColumn("name", F.coalesce("canon", "name"))
    cur = named.select("rid", "id", "sha", "n", "pos", "name")

    single = cur.where("n = 1")
    many = cur.where("n > 1")
    longest = many.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest))):
        many = _pair_up(many)
    ids = frozen(single.unionByName(many).select("rid", "id", "sha", "n", "name"))
    groups = ids.groupBy("n", "name").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumnRenamed("n", "size")
    out = hot_join(ids, groups, "name", hot_keys(ids, "name"), F.xxhash64("rid"), F.col("n") == F.col("size"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), F.col("n").alias("n_blocks"),
    )


def _hot(blocks: DataFrame) -> list[tuple[int, int]]:
    """(hash, parts) of blocks that make up over HOT_SHARE of all: fewer than 1 / HOT_SHARE of them at any input size."""
    counts = frozen(blocks.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 64"))
    least = max(64.0, HOT_SHARE * (blocks.where("pos = 0").agg(F.sum("n")).first()[0] if not counts.isEmpty() else 0))
    return [(r.h, math.ceil(4 * r.k / least)) for r in counts.where(F.col("k") > least).collect()]


def _pair_up(names: DataFrame) -> DataFrame:
    """One naming round: adjacent names of a text become one; a last name without a partner is paired with -1."""
    even = F.col("pos") % 2 == 0
    pairs = names.groupBy("rid", "id", "n", F.expr("pos div 2").cast("int").alias("p")).agg(
        F.max("sha").alias("sha"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
    )
    pairs = frozen(pairs)
    fresh = frozen(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).select("a", "b", F.monotonically_increasing_id().alias("name")))
    fresh = fresh.withColumnRenamed("b", "other")
    return hot_join(pairs, fresh, "a", hot_keys(pairs, "a"), F.xxhash64("rid"), F.col("b") == F.col("other")).select("rid", "id", "sha", "n", F.col("p").alias("pos"), "name")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256,
       CAST(greatest(1, ceil(strlen(t) / 8192.0)) AS INTEGER) AS n_blocks
FROM t
"""
