"""Sessions and what Python workers need."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Python workers find this package where the driver has it, also if it was started from another folder."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir. Without that setting a session on one machine
    has a folder of its own; on a cluster nothing else is known to be shared, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    return folder


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session on this machine for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)
