"""A corpus from raw documents: quality rules, line dedup, near-dedup, mixing, token ids.

Each stage reads what its predecessor wrote as Parquet, works on all of it, and returns the columns of `documents`;
the last adds token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracklore.llm import line_dedup, line_quality, mixing, sentence_pieces, simhash
from tracklore.llm.common import drop_folder, shared_folder, table

STAGES = [
    ("quality_rules", line_quality.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("sentence_pieces", sentence_pieces.stage),
]

#: SimHash components and the automaton's segmentation are not SQL; a test holds all stages in turn against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`. What is between them is kept in the shared folder until the next stage is written; the
    result reads what the last but one wrote, which stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
