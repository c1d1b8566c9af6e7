"""Range and as-of joins per file: the symbol around a comment, comments above a function, blame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lines of a bin. Spans and points of a file meet by bin, so a long file costs no product of all its spans and points.
BIN = 256


def _bins(spans: DataFrame, lo, hi) -> DataFrame:
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))))


def enclosing(points: DataFrame, spans: DataFrame, gap: int) -> DataFrame:
    """For each point (file, pid, at) the smallest span (file, sid, lo, hi) around it, else the last that ended at most gap before."""
    met = points.withColumn("bin", F.floor(F.col("at") / BIN)).join(_bins(spans, F.col("lo"), F.col("hi") + gap), ["file", "bin"])
    inside = met.filter((F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi") + gap))
    within = F.col("at") <= F.col("hi")
    best = inside.groupBy("pid").agg(F.min(F.when(within, F.struct((F.col("hi") - F.col("lo")).alias("span"), "sid"))).alias("around"), F.max(F.when(~within, F.struct("hi", (-F.col("sid")).alias("s"), "sid"))).alias("before"))
    return points.select("pid").join(best.select("pid", F.coalesce("around.sid", "before.sid").alias("sid")), "pid", "left")


def attached(spans: DataFrame, points: DataFrame, above: int = 5) -> DataFrame:
    """(sid, pid): points inside a span or at most `above` before it."""
    met = points.withColumn("bin", F.floor(F.col("at") / BIN)).join(_bins(spans, F.col("lo") - above, F.col("hi")), ["file", "bin"])
    return met.filter((F.col("at") >= F.col("lo") - above) & (F.col("at") <= F.col("hi"))).select("sid", "pid")


def forward_fill(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
