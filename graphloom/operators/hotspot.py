"""Hotspots: how many callers times how much churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lookup import filtered


def caller_counts(calls: DataFrame) -> DataFrame:
    """calls: source, callee. Distinct callers of each callee name."""
    return calls.groupBy(F.lower("callee").alias("k")).agg(F.count_distinct("source").alias("callers"))


def hotspots(nodes: DataFrame, calls: DataFrame, churn: DataFrame, top_n: int = 20, node_type: str = "", language: str = "", file_filter: str = "") -> DataFrame:
    """log2(1 + callers) * log2(1 + churn), a churn of 0 counting as 1; comments are left out. churn: file, churn."""
    rows = filtered(nodes.filter("type <> 'comment'"), language, node_type, file_filter).withColumn("k", F.lower("name")).join(caller_counts(calls), "k", "left").join(churn, "file", "left")
    callers, times = F.coalesce("callers", F.lit(0)), F.coalesce("churn", F.lit(0))
    score = F.round(F.log2(1 + callers) * F.log2(1 + F.greatest(times, F.lit(1))), 6)
    rows = rows.select("seq", "name", "file", callers.alias("callers"), times.alias("churn"), score.alias("score"))
    return rows.orderBy(F.desc("score"), F.desc("callers"), "seq").limit(top_n)


def ranked(rows: DataFrame) -> DataFrame:
    """The rows of `hotspots` with their place, from 1. They are top_n rows by then."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("callers"), "seq")))


def viz_hotspots(nodes: DataFrame, calls: DataFrame, churn: DataFrame, top_n: int = 20, pool: int = 50) -> DataFrame:
    return ranked(hotspots(nodes, calls, churn, pool)).filter(F.col("rank") <= min(max(top_n, 1), pool))


def file_churn(changes: DataFrame, days: int) -> DataFrame:
    """changes: file, ts. Changes of each file in the days up to the last change of all."""
    last = changes.agg(F.max("ts").alias("last"))
    recent = changes.crossJoin(F.broadcast(last)).filter(F.col("ts") > F.col("last") - F.expr(f"interval {days} days"))  # last is one row
    return recent.groupBy("file").agg(F.count("*").alias("churn"))
