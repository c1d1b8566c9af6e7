"""Watch mode: changes of files become replacements of their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.tables import python_ready

SUFFIXES = ("php", "js", "jsx", "mjs", "py", "pyi", "ts", "tsx", "go", "cs")


def replace_files(rows: DataFrame, new: DataFrame, affected: DataFrame) -> DataFrame:
    """rows without those of affected files (column file), and the new rows; a deleted file is affected and has no new rows."""
    return rows.join(affected.select("file").distinct(), "file", "left_anti").unionByName(new)


def watched(changes: DataFrame) -> DataFrame:
    return changes.filter(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*SUFFIXES))


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """Debounce: events of a key less than a gap apart become one row. Runs on tables and, with a watermark `late`, on streams."""
    if events.isStreaming:
        events = events.withWatermark(ts, late or gap)
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def _debounced(gap_ms: int):
    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # quiet for long enough
            change, ts = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "change": [change], "ts": [ts]})
            return
        last = state.get if state.exists else (None, None)
        for frame in frames:
            row = frame.loc[frame.ts.idxmax()]
            if last[1] is None or row.ts >= last[1]:
                last = (row.change, row.ts)
        state.update(last)
        state.setTimeoutDuration(gap_ms)

    return run


def watch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "2 seconds", every: str | None = None) -> StreamingQuery:
    """Runs `apply` on the last change of paths (path, change, ts); the checkpoint makes batches replayable.

    With `every`, a trigger's interval, the feed goes on: a path is handed on once nothing has come for it during `gap`, whether or
    not other paths change. Without it the feed is read to its end and each batch's last changes are handed on at once.
    """
    rows = watched(changes)
    if every:
        gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
        kind = "path string, change string, ts timestamp"
        rows = python_ready(rows).groupBy("path").applyInPandasWithState(_debounced(gap_ms), kind, "change string, ts timestamp", "append", "ProcessingTimeTimeout")

    def each(batch: DataFrame, number: int) -> None:
        apply(batch.groupBy("path").agg(F.max_by("change", "ts").alias("change"), F.max("ts").alias("ts")), number)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def keep_index(changes: DataFrame, root: str, path: str, checkpoint: str, told: Callable[[DataFrame], None] | None = None, gap: str = "2 seconds", every: str | None = None) -> StreamingQuery:
    """Watches changes below root and replaces the files' rows in the snapshot; `told` gets what each file lost and gained, and errors."""
    from graphloom.sources import index  # it uses this module

    def apply(batch: DataFrame, number: int) -> None:
        metrics = index.refresh(batch.sparkSession, root, path, batch)
        if told:
            told(metrics)

    return watch(changes, apply, checkpoint, gap, every)


def state(nodes: DataFrame) -> DataFrame:
    """(file, ids): which nodes each file has."""
    return nodes.groupBy("file").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def pruned_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges that neither start nor end at a node that is gone (id)."""
    return edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
