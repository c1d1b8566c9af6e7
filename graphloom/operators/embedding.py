"""Embeddings without a network: hashed token counts, and tables of vectors that are upserted and deleted by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import point_id, search_tokens

BATCH = 500


def embedding_text() -> Column:
    """What of a node is embedded: type and name, then summary, parameters and return type where there are any."""
    more = lambda c, lead, value: F.when(F.coalesce(c, F.lit(False)), F.concat(F.lit(lead), value)).otherwise("")
    parameters = F.array_join("parameters", ", ")
    return F.concat(F.col("type"), F.lit(" "), F.col("name"), more(F.col("summary") != "", " - ", F.col("summary")), more(parameters != "", " params: ", parameters), more(F.col("return_type") != "", " returns: ", F.col("return_type")))


def hashed(text: Column, dims: int = 64) -> Column:
    """A vector of unit length: tokens counted into dims places by a hash, with a sign from another. Null if there is no token."""
    tokens = search_tokens(F.coalesce(text, F.lit("")))
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(dims))
    sign = lambda t: F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    at = F.transform(tokens, lambda t: F.struct(place(t).alias("p"), sign(t).alias("s")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(at, lambda x: x["p"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: (x / norm).cast("float")))


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], np.ndarray] | None = None, dims: int = 64) -> DataFrame:
    """rows with embedding. model: texts to vectors, called with BATCH texts at a time; by default hashed token counts, which stay in the JVM."""
    if model is None:
        return rows.withColumn("embedding", hashed(F.col(text), dims))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = []
            for lo in range(0, len(batch), BATCH):
                out += [np.asarray(v, np.float32).tolist() for v in model(batch.iloc[lo : lo + BATCH].fillna("").tolist())]
            yield pd.Series(out, index=batch.index)

    return rows.withColumn("embedding", run(F.col(text)))


def code_vectors(nodes: DataFrame, model=None) -> DataFrame:
    """(point, id, embedding, and what search filters by) of all nodes but comments."""
    rows = nodes.filter("type <> 'comment'").withColumn("__text", embedding_text())
    return embed(rows, "__text", model).select(point_id(F.col("id")).alias("point"), "id", "type", "name", "file", "language", "summary", "embedding")


def upsert_vectors(have: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new in place of what has the same key."""
    return have.join(new.select(key), key, "left_anti").unionByName(new)


def delete_file(vectors: DataFrame, file: str) -> tuple[DataFrame, int]:
    """vectors without those of a file, and how many there were."""
    return vectors.filter(F.col("file") != file), vectors.filter(F.col("file") == file).count()


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with batch: batches of about `size` rows by the MD5 of the key, so that no task numbers all rows.

    There are as many batches as sizes fit into the table, rounded up to a power of two.
    """
    many = 1 << (rows.count() // max(1, size)).bit_length()
    return rows.withColumn("batch", F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % many)


def collection_name(project: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "_", project.lower()).strip("_")


class Collections:
    """Tables of vectors in the session's catalog, named by project."""

    def __init__(self, spark, project: str):
        self.spark, self.prefix = spark, collection_name(project)

    def name(self, kind: str) -> str:
        return f"{self.prefix}_{kind}"

    def create(self, kind: str, rows: DataFrame, path: str | None = None) -> DataFrame:
        writer = rows.write.mode("overwrite").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(self.name(kind))
        return self.spark.table(self.name(kind))

    def drop(self, kind: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(kind)}")

    def stats(self) -> dict[str, int]:
        """Rows of each collection of the project."""
        return {t.tableName.removeprefix(f"{self.prefix}_"): self.spark.table(t.tableName).count() for t in self.spark.sql(f"SHOW TABLES LIKE '{self.prefix}_*'").collect()}
