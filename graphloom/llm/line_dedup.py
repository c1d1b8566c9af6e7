"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys, one row each, in the cluster's shared folder: dealt into buckets by the key and sorted, so that
joins between runs, and of a batch with a run, are merges that move no row of a run. Each batch of documents is merge-anti-joined
with the runs: keys that no run holds are added as fresh, for the others a run only adds to their counts. So a key is fresh in one
run exactly. When a level holds `fanout` runs, they are merged into one run of the next level, so a key is rewritten once a level.

The texts are read once for their lines, which are kept as a narrow table, and once more to leave lines out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.textkit import LOWER, RID, ROW, SPACED, Lines, arrow_task, code_points, delete, equal_in_text, exchanges_freed, hot_join, numbered, pieces, row_text, scratch, span_digest, stored, strings

_KEY = ["h1", "h2"]


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for piece in pieces(batch.column("text"), SPACED):
                lines, low = Lines(piece, piece.buf), LOWER[piece.buf]
                at = np.flatnonzero(code_points(low, lines.core_start, lines.core_end) >= min_chars)
                doc = lines.doc[at]
                one, two = span_digest(low, lines.core_start[at], lines.core_end[at])
                order, again = equal_in_text(doc, one)
                first = np.empty_like(again)
                first[order] = ~again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(rid[piece.rows][doc]), batch.column("id").slice(piece.rows.start, len(piece)).take(pa.array(doc)), pa.array((at - lines.first[doc]).astype(np.int32)), pa.array(first)],
                    names=["h1", "h2", "rid", "id", "line", "first"],
                )

    return arrow_task(run)


def line_keys(docs: DataFrame, text: str, id_col: str, min_chars: int) -> DataFrame:
    """One row per line whose key has min_chars code points: h1, h2, rid, id, line (from 0), first (its first time in the text)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = numbered(docs).select(F.col(RID).alias("rid"), F.col(ROW).getField(id_col).alias("id"), F.col(ROW).getField(text).alias("text"))
    return rows.mapInArrow(_keys(min_chars), f"h1 long, h2 long, rid long, id {kind}, line int, first boolean")


class LineRuns:
    """The levelled runs: tables (h1, h2, n_docs, n_lines, last_doc, fresh), bucketed and sorted by the key.

    The tables are in the session's catalog as long as the runs are open; `close` (or leaving a `with`) takes them off and deletes them.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout, self.path = spark, fanout, scratch(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.written, self.merges = f"graphloom_run_{uuid.uuid4().hex}", 0, 0
        self.levels: list[list[str]] = [[]]

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for table in self.spark.sql(f"SHOW TABLES LIKE '{self.name}*'").collect():
            self.spark.sql(f"DROP TABLE {table.tableName}")
        self.levels = [[]]
        delete(self.spark, self.path)

    def _write(self, rows: DataFrame, level: int) -> None:
        self.written += 1
        name = f"{self.name}_{self.written}"
        with exchanges_freed(self.spark):
            rows.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).format("parquet").option("path", f"{self.path}/{name}").saveAsTable(name)
        self._level(level).append(name)

    def _level(self, level: int) -> list[str]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def merged(self, a: str, b: str) -> DataFrame:
        """The rows of two runs, one for each key: a merge join of sorted buckets."""
        other = self.spark.table(b).select(*_KEY, *(F.col(c).alias(f"{c}_b") for c in ("n_docs", "n_lines", "last_doc", "fresh")))
        both = self.spark.table(a).join(other.hint("merge"), _KEY, "full")
        add = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_b", F.lit(0))).alias(c)
        return both.select(*_KEY, add("n_docs"), add("n_lines"), F.greatest("last_doc", "last_doc_b").alias("last_doc"), (F.coalesce("fresh", F.lit(False)) | F.coalesce("fresh_b", F.lit(False))).alias("fresh"))

    def _merge(self, names: list[str], level: int) -> None:
        """Two runs at a time, so that both sides of each merge lie in their buckets."""
        while len(names) > 1:
            a, b, *rest = names
            self._write(self.merged(a, b), level)
            self.merges += 1
            for n in (a, b):
                self.spark.sql(f"DROP TABLE {n}")
            delete(self.spark, f"{self.path}/{a}", f"{self.path}/{b}")
            names = [self.levels[level].pop(), *rest]
        self._level(level).extend(names)

    def held(self) -> list[DataFrame]:
        """The keys of each run that are fresh there."""
        return [self.spark.table(n).filter("fresh").select(*_KEY) for level in self.levels for n in level]

    def new_lines(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run holds."""
        return reduce(lambda rows, run: rows.join(run.hint("merge"), _KEY, "left_anti"), self.held(), keys)

    def add(self, keys: DataFrame) -> None:
        """Adds the keys of one batch (rows of line_keys) as a run and compacts the levels that are full."""
        counted = keys.groupBy(*_KEY).agg(F.count_if("first").alias("n_docs"), F.count("*").alias("n_lines"), F.max("id").alias("last_doc"))
        run = self.new_lines(counted).withColumn("fresh", F.lit(True))
        for known in self.held():  # a key is fresh in one run only, so these have no key in common
            run = run.unionByName(counted.join(known.hint("merge"), _KEY, "left_semi").withColumn("fresh", F.lit(False)))
        self._write(run, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._merge(full, level + 1)
            level += 1

    def total(self) -> DataFrame:
        """One row for each key of all runs, which are merged into one."""
        names = [n for level in self.levels for n in level]
        self.levels = [[] for _ in self.levels]
        self._merge(names, len(self.levels))
        return self.spark.table(self.levels[-1][0])


def _kept(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column("drops")
            counts = pc.fill_null(pc.list_value_length(drops), 0).to_numpy()
            values, stop = drops.flatten().to_numpy(), np.cumsum(counts)
            for piece in pieces(row_text(batch, text), SPACED):
                lo, hi = piece.rows.start, piece.rows.stop
                raw = piece.buf.tobytes()
                texts = [raw[a:b] for a, b in zip(piece.at[:-1].tolist(), piece.at[1:].tolist())]
                n_lines = [t.count(b"\n") + 1 for t in texts]
                for i in np.flatnonzero(counts[lo:hi]).tolist():
                    gone = set(values[stop[lo + i] - counts[lo + i] : stop[lo + i]].tolist())
                    texts[i] = b"\n".join([x for k, x in enumerate(texts[i].split(b"\n")) if k not in gone])
                yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(lo, hi - lo), pa.array(n_lines, pa.int64()), pa.array(counts[lo:hi].astype(np.int64)), strings(texts)], names=[ROW, "n_lines", "n_dropped", "kept_text"])

    return arrow_task(run)


def shared_lines(runs: LineRuns, lines: DataFrame, min_docs: int) -> DataFrame:
    """(rid, drops): numbers of the lines that min_docs documents share, but for the last document.

    A line in a third of all documents is one key: the lines of such keys stay where they are.
    """
    shared = stored(runs.total().filter(F.col("n_docs") >= min_docs).select(*_KEY, "n_lines", "last_doc"), "shared")
    found = hot_join(lines, shared, _KEY, "n_lines", lines.count())
    return found.filter(~F.col("id").eqNullSafe(F.col("last_doc"))).groupBy("rid").agg(F.collect_list("line").alias("drops"))


def drop_shared_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_docs: int = 5, min_chars: int = 40, batches: int = 4) -> DataFrame:
    """docs as column ROW (a struct of all its columns) with n_lines, n_dropped and kept_text.

    A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased. Keys of min_chars code points or
    more that min_docs documents or more hold lose all their lines, except in the document with the largest id that holds
    them. The other lines stay as they are, joined by \\n.

    A null or empty text is one empty line and stays empty. Rows are documents: a repeated row counts again, and all rows with
    the largest id keep their lines. A null id is the smallest; if all holders have null ids, they keep their lines. An empty
    table gives an empty table. Other columns and clashing names only travel inside ROW.

    The documents come in `batches` batches of neighbouring rows, each adding a run; the number only sets how much is
    sorted at once, and the result does not depend on it.
    """
    spark = docs.sparkSession
    lines = stored(line_keys(docs, text, id_col, min_chars).withColumn("batch", F.pmod(F.xxhash64(F.shiftright("rid", 14)), F.lit(batches)).cast("int")), "lines")
    with LineRuns(spark) as runs:
        for k in range(batches):
            runs.add(lines.filter(F.col("batch") == k))
        drops = stored(shared_lines(runs, lines, min_docs), "drops")
    out = numbered(docs).join(drops.withColumnRenamed("rid", RID).hint("shuffle_hash"), RID, "left").select(ROW, "drops")
    return out.mapInArrow(_kept(text), f"{ROW} {docs.schema.simpleString()}, n_lines long, n_dropped long, kept_text string")
