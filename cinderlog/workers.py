"""Where Python workers find the package, and where intermediate tables lie."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def workers_find_package(spark: SparkSession) -> None:
    """Workers on this machine import the package from where the driver did.

    On a cluster, install it on the executors or hand it over with --py-files.
    """
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH", "")) if x)


def new_folder(spark: SparkSession) -> str:
    """A new name under the folder in spark.checkpoint.dir, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/cinderlog-work"
    return f"{base.rstrip('/')}/cinderlog-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder and reread."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
