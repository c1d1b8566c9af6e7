"""The index as Parquet tables, partitioned by what queries prune on. A new version is written beside the old one; a pointer file says which counts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import EDGES, NODES

META = "indexed_at timestamp, version string, node_count long, edge_count long, error_count long"


def _as(df: DataFrame, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names)).to(df.sparkSession.createDataFrame([], schema).schema)


def save(nodes: DataFrame, edges: DataFrame, path: str, errors: DataFrame | None = None) -> None:
    """Writes a version and then the pointer to it, so that readers see the old index or the new one."""
    spark, version = nodes.sparkSession, uuid.uuid4().hex
    _as(nodes, NODES).write.partitionBy("language").parquet(f"{path}/{version}/nodes")
    _as(edges, EDGES).write.partitionBy("relation").parquet(f"{path}/{version}/edges")
    if errors is not None:
        errors.write.parquet(f"{path}/{version}/errors")
    read = spark.read.parquet
    counts = [read(f"{path}/{version}/{t}").count() if t != "errors" or errors is not None else 0 for t in ("nodes", "edges", "errors")]
    spark.range(1).select(F.current_timestamp().alias("indexed_at"), F.lit(version).alias("version"), *(F.lit(n).cast("long").alias(c) for n, c in zip(counts, ("node_count", "edge_count", "error_count")))).write.mode("append").json(f"{path}/meta")


def info(spark: SparkSession, path: str) -> DataFrame | None:
    """One row: when the current version was written and how much it holds; None where there is none. Reads no node or edge."""
    try:
        meta = spark.read.schema(META).json(f"{path}/meta")
    except AnalysisException:
        return None
    return meta.filter("version is not null").orderBy(F.desc("indexed_at")).limit(1)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of the current version. None where there is no snapshot or it cannot be read: the caller builds one."""
    try:
        row = (meta := info(spark, path)) and meta.first()
        if not row:
            return None
        return spark.read.schema(NODES).parquet(f"{path}/{row['version']}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/{row['version']}/edges")
    except AnalysisException:
        return None
