"""Building the index: whole trees, single files, commits; and swapping it in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import language_of
from graphloom.operators.embedding import embed, upsert_vectors
from graphloom.plans.tables import kept
from graphloom.sources import extract, files, snapshot, vcs
from graphloom.streaming.watch import replace_files


def build(spark: SparkSession, root: str, path: str | None = None, max_kb: int = 500, languages: tuple[str, ...] = (), patterns: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of a source tree; written as a snapshot if a path is given. A file that cannot be parsed is a row of errors."""
    nodes, edges, errors = extract.extract(files.scan(spark, root, patterns, max_kb, languages))
    if path:
        snapshot.save(nodes, edges, path, errors)
        nodes, edges = snapshot.load(spark, path)
    return nodes, edges, errors


def counters(nodes: DataFrame, edges: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: files with symbols, nodes, edges, errors."""
    a = nodes.agg(F.count_distinct("file").alias("files"), F.count("*").alias("nodes"))
    b, c = edges.agg(F.count("*").alias("edges")), errors.agg(F.count("*").alias("errors"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def refresh(spark: SparkSession, root: str, path: str, changed: DataFrame) -> DataFrame:
    """Replaces the rows of changed files (path, change) in the snapshot; returns for each of them what went and what came.

    Deleted files and files that are ignored or gone only lose their rows. Edges carry their file, so a file's imports go with it.
    """
    have = snapshot.load(spark, path)
    if have is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    nodes, edges = have
    names = [r["path"] for r in changed.filter("change <> 'deleted'").select("path").distinct().collect()]  # files of one batch of changes
    found = files.scan(spark, root).filter(F.col("path").isin(names)) if names else spark.createDataFrame([], "path string, language string, size_bytes long, content binary")
    new_nodes, new_edges, errors = extract.extract(found)
    top = nodes.agg(F.max("seq").alias("a")).first()["a"] or 0
    top = max(top, edges.agg(F.max("edge_id").alias("a")).first()["a"] or 0) + 1  # new rows come after all others
    new_nodes, new_edges = new_nodes.withColumn("seq", F.col("seq") + top), new_edges.withColumn("edge_id", F.col("edge_id") + top)
    affected = changed.select(F.col("path").alias("file")).distinct()
    told = lambda rows, name: rows.join(affected, "file", "left_semi").groupBy("file").agg(F.count("*").alias(name))
    metrics = affected.join(told(nodes, "removed"), "file", "left").join(told(new_nodes, "added"), "file", "left").join(errors.select(F.col("path").alias("file"), "error"), "file", "left").fillna(0, ["removed", "added"])
    metrics = kept(metrics)
    columns = lambda new, old: new.select(*old.columns)
    snapshot.save(replace_files(nodes, columns(new_nodes, nodes), affected), replace_files(edges, columns(new_edges, edges), affected), path, errors)
    return metrics


def of_files(spark: SparkSession, root: str, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of some files only."""
    rows = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{p}" for p in paths])
    path = F.regexp_extract("path", re.escape(root.rstrip("/").split("://")[-1]) + "/(.*)$", 1)
    return extract.extract(rows.select(path.alias("path"), language_of(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), "content"))


def commits(spark: SparkSession, root: str, limit: int = 5000, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, vectors of their messages), keyed by revision; given older vectors, new ones come over them."""
    rows = vcs.log(spark, root, limit=limit)
    text = F.concat_ws(" ", "message", F.array_join(F.slice("files_changed", 1, 20), " "))
    new = embed(rows.select(F.col("revision").alias("id"), text.alias("text"), "message", "author", "date"), "text")
    return rows, new if vectors is None else upsert_vectors(vectors, new)
