"""The trajectory table: types, row constraints, quarantine, and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOMAINS = ("swe", "terminal", "web", "gui", "tool", "other")

STEP = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("observation", T.StringType()),
    T.StructField("thought", T.StringType()),
    T.StructField("extra", T.StringType()),  # JSON text
])
TRAJECTORY = T.StructType([
    T.StructField("traj_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("scaffold", T.StringType()),
    T.StructField("policy_model", T.StringType()),
    T.StructField("repo_or_site", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("steps", T.ArrayType(STEP)),
    T.StructField("outcome", T.BooleanType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])


def violations(df: DataFrame, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """Adds violations: the row constraints that a trajectory breaks, in a fixed order."""
    rules = [
        ("task is blank", ~F.coalesce(F.col("task"), F.lit("")).rlike(r"(?U)\S")),
        ("no steps", F.coalesce(F.size("steps"), F.lit(0)) <= 0),
        ("unknown domain", ~F.coalesce(F.col("domain").isin(*domains), F.lit(False))),
        ("no outcome", F.col("outcome").isNull()),
        ("no task id", F.col("task_id").isNull()),
    ]
    return df.withColumn("violations", F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull()))


def split_valid(df: DataFrame, domains: tuple[str, ...] = DOMAINS) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    marked = violations(df, domains)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def without_thoughts(df: DataFrame) -> DataFrame:
    return df.withColumn("steps", F.transform("steps", lambda s: s.withField("thought", F.lit(None).cast("string"))))


#: Fixed value: the sentence of the misleading view.
FAKE_CONFIDENCE = "Great, this works! The fix is complete and all tests pass now."


def with_fake_confidence(df: DataFrame) -> DataFrame:
    """The last step's thought says that all is well, whatever happened."""
    last = F.element_at("steps", -1).withField("thought", F.lit(FAKE_CONFIDENCE))
    return df.withColumn("steps", F.concat(F.slice("steps", 1, F.size("steps") - 1), F.array(last)))


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Trajectories from JSON lines."""
    return spark.read.schema(TRAJECTORY).option("mode", "FAILFAST").json(path)


def write_trajectories(df: DataFrame, path: str) -> int:
    """Writes JSON lines; the number of rows comes from the same job."""
    from pyspark.sql import Observation

    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.json(path)
    return seen.get["n"]
