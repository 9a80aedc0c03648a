"""Raw files in, records and tables out."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_parquet(spark: SparkSession, path: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """The given columns only, with shard (file name without its end) and row_index (place in the file)."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    df = df.select(*columns, F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("shard"), F.col("_metadata.row_index").alias("row_index"))
    return df.limit(limit) if limit else df


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """JSON lines below a folder, with the name of the file that each row is from."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    df = df.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("shard"))
    return df.limit(limit) if limit else df


SCORED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("group", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("type", T.StringType()), T.StructField("variant", T.StringType()),
    T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("label", T.IntegerType()), T.StructField("p", T.ArrayType(T.DoubleType())),
    T.StructField("logits", T.ArrayType(T.DoubleType())),
])


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored rows from a JSON list or from an object whose `rows` holds it."""
    wrapped = spark.read.schema(T.StructType([*SCORED.fields, T.StructField("rows", T.ArrayType(SCORED))])).json(path, multiLine=True)
    bare = wrapped.where("rows IS NULL").select(*SCORED.names)
    return bare.unionByName(wrapped.where("rows IS NOT NULL").select(F.inline("rows")).select(*SCORED.names))


def write_by_split(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder for each split."""
    df.write.partitionBy("split").format(kind).save(path)


def write_split_table(table: DataFrame, path: str, rule: str) -> None:
    """repo and split, in order of repo, with the rule that made them."""
    table.orderBy("repo").withColumn("rule", F.lit(rule)).write.json(path)


def report_markdown(title: str, stats: DataFrame, most_rows: int = 200) -> str:
    """A small table of statistics as Markdown; raises for more than `most_rows`."""
    rows = stats.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows are no report")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else str(v)
    head = ["| " + " | ".join(stats.columns) + " |", "|" + "---|" * len(stats.columns)]
    return "\n".join([f"# {title}", "", *head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the place of `path`, written beside it and moved there in one step."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    here = hadoop.Path(path)
    fs = here.getFileSystem(conf)
    here, beside = (p.makeQualified(fs.getUri(), fs.getWorkingDirectory()) for p in (here, hadoop.Path(f"{path}.{uuid.uuid4().hex}")))
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    replace = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    replace[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(here.toUri(), conf).rename(beside, here, replace)


def publish(df: DataFrame, path: str) -> str:
    """A new version of the table at `path`: written whole to a folder of its own, then named by the file LATEST, which is
    replaced in one step. Readers see the old version or the new one; a writer that dies leaves the old one."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/{version}")
    write_text(df.sparkSession, f"{path}/LATEST", version)
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version that LATEST names."""
    version = spark.read.text(f"{path}/LATEST").first()[0]
    return spark.read.parquet(f"{path}/{version}")
