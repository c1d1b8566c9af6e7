"""BM25+, exact nearest neighbours, rank fusion and maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import cosine, search_tokens
from graphloom.plans.tables import kept, python_ready

K1, B, DELTA = 1.5, 0.75, 1.0


def _equals(token: str):
    return lambda x: x == token


def token_counts(docs: DataFrame, terms: list[str], *keep: str) -> DataFrame:
    """id, len and tf0, tf1, ... of the terms; every text is split into tokens once."""
    rows = docs.select("id", *keep, F.explode(F.array(search_tokens(F.col("text")))).alias("__tokens"))  # the explode keeps the split from being copied into each use
    return rows.select("id", *keep, F.size("__tokens").alias("len"), *(F.size(F.filter("__tokens", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)))


def bm25_plus(docs: DataFrame, query: list[str], limit: int, language: str = "", node_type: str = "") -> DataFrame:
    """docs: id, text (and language, type where they are asked for: statistics are those of the filtered documents). Counts are kept, so texts are read once."""
    asked = {t: query.count(t) for t in query}
    for column, value in (("language", language), ("type", node_type)):
        docs = docs.filter(F.col(column) == value) if value else docs
    base = kept(token_counts(docs, list(asked)))
    stats = base.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))))
    score = F.lit(0.0)
    for i, times in enumerate(asked.values()):
        tf = F.col(f"tf{i}")
        gain = DELTA + tf * (K1 + 1) / (K1 * (1 - B + B * F.col("len") / F.col("avg_len")) + tf)
        score = score + F.when(F.col(f"df{i}") > 0, times * F.log((F.col("n") + 1) / F.col(f"df{i}")) * gain).otherwise(0.0)
    scored = base.crossJoin(F.broadcast(stats)).select("id", F.round(score, 6).alias("score"))  # stats is one row
    return scored.filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def bm25_text():
    """The text of a node that BM25 reads: type, name, summary, parameters, return type, as far as there are any."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws(" ", "type", "name", some(F.col("summary")), some(F.array_join("parameters", " ")), some(F.col("return_type")))


def nearest(vectors: DataFrame, query: list[float], limit: int, language: str = "", node_type: str = "") -> DataFrame:
    """vectors: id, embedding (and language, type). Exact, by cosine, among those of the language and type."""
    for column, value in (("language", language), ("type", node_type)):
        vectors = vectors.filter(F.col(column) == value) if value else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", F.round(cosine(F.col("embedding"), q), 5).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def fuse(lists: list[DataFrame], limit: int, k: int = 60, each: int = 1000) -> DataFrame:
    """Reciprocal rank fusion of lists (id, score): sum of 1 / (k + rank) over the best `each` of every list, which one task ranks."""
    ranked = None
    for rows in lists:
        best = rows.orderBy(F.desc("score"), "id").limit(each)
        part = best.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 8).alias("rrf")).orderBy(F.desc("rrf"), "id").limit(limit)


def hybrid(docs: DataFrame, vectors: DataFrame | None, query: list[str], embedding: list[float] | None, limit: int = 20, language: str = "", node_type: str = "") -> DataFrame:
    """(id, rrf, score): BM25+ and vectors fused, with the score that a hit had in the vectors, else in BM25+. Without vectors BM25+ alone, rrf null."""
    sparse = bm25_plus(docs, query, 4 * limit, language, node_type)
    if vectors is None or embedding is None:
        return sparse.orderBy(F.desc("score"), "id").limit(limit).select("id", F.lit(None).cast("double").alias("rrf"), "score")
    dense = nearest(vectors, embedding, 4 * limit, language, node_type)
    lists = kept(sparse.withColumn("n", F.lit(0)).unionByName(dense.withColumn("n", F.lit(1))))  # 8 * limit rows
    best = fuse([lists.filter(F.col("n") == i).select("id", "score") for i in (0, 1)], limit)
    return best.join(lists.groupBy("id").agg(F.max_by("score", "n").alias("score")), "id").orderBy(F.desc("rrf"), "id").select("id", "rrf", "score")


def search_commits(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """(revision, message, author, date, score) of the commits whose text is nearest. vectors: index.commits."""
    best = nearest(vectors.filter("embedding is not null"), query, limit)  # `limit` rows
    return vectors.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id").select(F.col("id").alias("revision"), "message", "author", "date", "score")


def mmr(vectors: DataFrame, query: list[float], limit: int = 10, weight: float = 0.6) -> DataFrame:
    """(pos, id): greedy choice from a pool of at most max(4 * limit, 40) nearest vectors."""
    pool = max(4 * limit, 40)
    top = nearest(vectors, query, pool).join(vectors, "id").select("id", "score", "embedding").coalesce(1)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["score", "id"], ascending=[False, True])
        if not len(rows):
            return
        x = np.stack(rows.embedding.to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near, taken, closest = x @ x.T, [0], None
        while len(taken) < min(limit, len(rows)):
            closest = near[taken[-1]] if closest is None else np.maximum(closest, near[taken[-1]])
            gain = weight * rows.score.to_numpy() - (1 - weight) * closest
            gain[taken] = -np.inf
            taken.append(int(gain.argmax()))
        yield pd.DataFrame({"pos": range(len(taken)), "id": rows.id.to_numpy()[taken]})

    return python_ready(top).mapInPandas(choose, f"pos int, id {vectors.schema['id'].dataType.simpleString()}")
