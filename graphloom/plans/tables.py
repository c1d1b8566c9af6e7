"""Intermediate tables in the cluster's shared folder, so that long loops keep a short lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name under the folder that all executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/graphloom-tables"
    return f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_ready(df: DataFrame) -> DataFrame:
    """df, after Python workers have been told where the driver has this package (a cluster that has it installed finds the same)."""
    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return df
