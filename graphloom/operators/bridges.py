"""Bridges: endpoints that one language offers and another calls, matched by path pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import path_segments, paths_match
from graphloom.operators.callgraph import last_per_key


def resolve(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """Both: id, seq, language, path. The last endpoint of each normalised path counts; equal paths 1.0, wildcards 0.8.

    Paths match only if they have as many segments and, of the first three, those that are literal on both sides are equal. So a
    path gives its segments there as they are, or open where the other side may be open, with which is which: pairs whose first
    literals differ never meet.
    """

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.withColumn("segments", path_segments(F.col("path"))).withColumn("norm", F.array_join("segments", "/"))
        rows = last_per_key(rows, "norm")
        return rows.select(*(F.col(c).alias(f"{side}_{c}") for c in ("id", "language", "norm", "segments")))

    def views(rows: DataFrame, side: str) -> DataFrame:
        """A row for each guess of where the other side is open (`*`), with the key that both sides then share."""
        at = F.col(f"{side}_segments")
        rows = rows.withColumn("size", F.size(at))
        for i in range(3):
            own = F.coalesce(F.try_element_at(at, F.lit(i + 1)), F.lit(""))
            guess = lambda there, own=own: F.struct(F.lit(there).alias("other"), (own == "*").alias("mine"), (F.lit("*") if there else own).alias("word"))
            rows = rows.withColumn(f"k{i}", F.explode(F.array(guess(False), guess(True))))
        mine, other = ("mine", "other") if side == "c" else ("other", "mine")
        key = F.concat_ws("/", "size", *(F.concat(F.col(f"k{i}")[mine].cast("string"), F.col(f"k{i}")[other].cast("string"), F.col(f"k{i}")["word"]) for i in range(3)))
        return rows.withColumn("key", key).drop("k0", "k1", "k2", "size")

    c, p = keyed(consumers, "c"), keyed(providers, "p")
    other = F.col("c_language") != F.col("p_language")
    exact = c.join(p, c.c_norm == p.p_norm).filter(other).withColumn("confidence", F.lit(1.0))
    star = F.contains("c_norm", F.lit("*")) | F.contains("p_norm", F.lit("*"))
    wild = views(c, "c").join(views(p, "p"), "key").filter((F.col("c_norm") != F.col("p_norm")) & star & other & paths_match(F.col("c_segments"), F.col("p_segments"))).withColumn("confidence", F.lit(0.8))
    return exact.select("c_id", "p_id", "confidence").unionByName(wild.select("c_id", "p_id", "confidence"))


def sides(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(consumers, providers) among the endpoints: those that a networks_to bridge edge points to, those that a definition offers."""
    ends = nodes.filter("type = 'endpoint'").select("id", "seq", "language", F.col("name").alias("path"))
    called = edges.filter("relation = 'networks_to' and is_bridge").select(F.col("target").alias("id")).distinct()
    offered = edges.filter("relation = 'defines'").select(F.col("target").alias("id")).distinct()
    return ends.join(called, "id", "left_semi"), ends.join(offered, "id", "left_semi")


def find_bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return resolve(*sides(nodes, edges))
