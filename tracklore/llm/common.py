"""What the operators of this subpackage share: table access, frozen intermediate results, salted joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.session import ready, shared_folder

#: The white space of the contracts: space, tab, newline, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frozen(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read from there: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    here.getFileSystem(spark._jsc.hadoopConfiguration()).delete(here, True)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner", n: int = 16) -> DataFrame:
    """Equi-join of a possibly skewed `left` with a `right` of one row per key: right is repeated `n` times so that
    a hot key of left spreads over `n` tasks. Right must be narrow."""
    lhs = left.withColumn("_salt", F.pmod(salt, F.lit(n)).cast("int"))
    rhs = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return lhs.join(rhs, [*on, "_salt"], how).drop("_salt")


#: Keys with more than this share of all rows are hot: fewer than 1 / HOT_SHARE of them, whatever the input.
HOT_SHARE = 0.002


def hot_keys(rows: DataFrame, key: str) -> list[tuple[int, int]]:
    """(key, parts) of the keys that have more than HOT_SHARE of the rows, and at least 64 of them: in how many parts to
    deal them, so that a part has a quarter of that share at most. The parts of all keys are under 5 / HOT_SHARE."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    least = max(64.0, HOT_SHARE * rows.count())
    return [(r[0], r[1]) for r in counts.where(F.col("_n") > least).select(key, F.ceil(F.col("_n") * (4 / least)).cast("int")).collect()]


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: list[tuple[int, int]], salt: Column, on: Column | None = None, how: str = "inner") -> DataFrame:
    """Equi-join on `key`, a long, that deals the rows of hot keys by `salt` and repeats their rows of `right` for each
    part. `on` is a further condition; columns of the two sides but for the key have different names."""
    other = right.withColumnRenamed(key, "_right")
    same = F.col(key) == F.col("_right")
    if hot:
        parts = F.broadcast(left.sparkSession.createDataFrame(hot, "_hot long, _parts int"))
        left = left.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.coalesce(F.pmod(salt, "_parts"), F.lit(0))).drop("_hot", "_parts")
        other = other.join(parts, F.col("_right") == F.col("_hot"), "left").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
        same = same & (F.col("_salt") == F.col("_turn"))
    return left.join(other, same if on is None else same & on, how).drop("_right", "_salt", "_turn")


def set_aside(df: DataFrame, results: tuple[str, ...], keep: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with other names for columns that start with an underscore or are named like a result, whatever their case,
    but for those in `keep`, and a function that gives them their names back. Without such columns both change nothing."""
    own = {c: f"aside{i}" for i, c in enumerate(df.columns) if c not in keep and (c.startswith("_") or c.lower() in results)}
    if not own:
        return df, lambda out: out
    return df.withColumnsRenamed(own), lambda out: out.withColumnsRenamed({v: k for k, v in own.items()})


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Arrow batches to Python by bytes as well as rows, so that very long texts do not add up in a worker."""
    ready(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
