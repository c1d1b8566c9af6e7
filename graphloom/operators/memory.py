"""Notes with a key, tags and an expiry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.retrieval import nearest


def upsert(entries: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """The last entry of each key with the time of its first: two aggregates, no window over a hot key."""
    return entries.groupBy(key).agg(F.min(at).alias("created_at"), F.max(at).alias("updated_at"), *(F.max_by(v, at).alias(v) for v in values))


def live(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired; an expiry that cannot be read keeps them."""
    return entries.filter(F.coalesce(F.try_to_timestamp(F.col("expires_at").cast("string")) >= now, F.lit(True)))


def tagged(entries: DataFrame, tag: str) -> DataFrame:
    return entries.filter(F.array_contains("tags", tag))


def forget(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys, "key", "left_anti")


def staleness(entries: DataFrame, now: Column, ts: str, days: int = 30) -> DataFrame:
    age = F.floor((F.unix_seconds(now) - F.unix_seconds(F.col(ts).cast("timestamp"))) / 86400).cast("bigint")
    return entries.withColumn("age_days", age).withColumn("stale", F.col("age_days") > days)


def store(entries: DataFrame, key: str, content: str, tags: list[str], now: dt.datetime, ttl_days: int | None = None, source_files: list[str] = ()) -> DataFrame:
    """entries with a note; one of the same key is overwritten but keeps the time it was made. schema.MEMORY."""
    spark = entries.sparkSession
    until = now + dt.timedelta(days=ttl_days) if ttl_days else None
    note = spark.createDataFrame([(key, content, list(tags), list(source_files), now, now, until)], entries.schema)
    made = entries.filter(F.col("key") == key).select("key", F.col("created_at").alias("__made"))
    note = note.join(made, "key", "left").withColumn("created_at", F.coalesce("__made", "created_at")).drop("__made").select(*entries.columns)
    return entries.filter(F.col("key") != key).unionByName(note)


def forget_live(entries: DataFrame, key: str, now: Column) -> tuple[DataFrame, bool]:
    """entries without a note, and whether there was a live one; an expired note cannot be forgotten."""
    found = not live(entries.filter(F.col("key") == key), now).isEmpty()
    return (entries.filter(F.col("key") != key) if found else entries), found


def listing(entries: DataFrame, now: Column, tag: str = "", limit: int = 200) -> DataFrame:
    """Live notes, last updated first, with age_days, stale, days_left (to the expiry, if any) and expired."""
    rows = live(tagged(entries, tag) if tag else entries, now)
    return flagged(rows.orderBy(F.desc("updated_at"), "key").limit(limit), now)


def flagged(entries: DataFrame, now: Column) -> DataFrame:
    until = F.try_to_timestamp(F.col("expires_at").cast("string"))
    left = F.floor((F.unix_seconds(until) - F.unix_seconds(now)) / 86400).cast("bigint")
    return staleness(entries, now, "updated_at").withColumn("days_left", left).withColumn("expired", F.coalesce(until < now, F.lit(False)))


def search(entries: DataFrame, now: Column, key: str = "", query: list[float] | None = None, tag: str = "", limit: int = 5) -> DataFrame:
    """Live notes: the one of a key (whatever its tags), else the nearest to a query among those of a tag, else those of the tag."""
    rows = live(entries, now)
    if key:
        return rows.filter(F.col("key") == key).withColumn("score", F.lit(1.0))
    rows = tagged(rows, tag) if tag else rows
    if query is None:
        return rows.orderBy(F.desc("updated_at"), "key").limit(limit).withColumn("score", F.lit(0.0))
    best = nearest(rows.select(F.col("key").alias("id"), "embedding"), query, limit)
    return rows.join(F.broadcast(best.withColumnRenamed("id", "key")), "key").orderBy(F.desc("score"), "key")  # `limit` rows
