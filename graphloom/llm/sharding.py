"""Sharding by extendible hashing.

The directory is indexed by the first bits of a key's hash. A bucket that is too large splits on one more bit; all others stay as
they are, so shards differ in depth. The sizes of all prefixes of some bits at once come from one histogram of prefixes,
and only the rows of buckets that are still too large go on to the next bits. A bucket whose rows all have one key has no bits left
that part them: it goes on splitting on the bits of a second hash, of the row's number. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkit import RID, ROW, numbered, stored

BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; a null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int, step: int = 6) -> list[tuple[int, DataFrame]]:
    """Shards of the hashes of each group. sizes: g (group), h, b (bytes), n (documents), one row a hash of a group. For each number of
    bits d a table (g, p, depth, prefix, shard_bytes, shard_docs, keys): hashes of g whose first d bits are p are in the shard of
    the first `depth` bits `prefix`, which holds `keys` different hashes."""
    total = sizes.groupBy("g").agg(F.sum("b").alias("b")).agg(F.max("b")).first()[0] or 0
    done, width, out, pending = 0, max(1, math.ceil(math.log2(max(total, 1) / limit)) + 2 if total > limit else 1), [], sizes
    while done < BITS:
        width = min(width, BITS - done)
        bits = done + width
        hist = stored(pending.groupBy("g", F.shiftright("h", BITS - bits).alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.count("*").alias("keys")), "histogram")
        nodes = hist.withColumn("k", F.explode(F.sequence(F.lit(0 if done == 0 else 1), F.lit(width)))).withColumn("q", F.expr(f"shiftright(p, {width} - k)"))
        fits = nodes.groupBy("g", "k", "q").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.sum("keys").alias("keys")).filter((F.col("shard_bytes") <= limit) | (F.col("keys") == 1) | ((F.col("k") == width) & F.lit(bits == BITS)))
        found = nodes.select("g", "p", "k", "q").join(fits, ["g", "k", "q"]).groupBy("g", "p").agg(F.min(F.struct("k", "q", "shard_bytes", "shard_docs", "keys")).alias("s"))
        leaves = stored(found.select("g", "p", (F.col("s.k") + done).cast("int").alias("depth"), F.col("s.q").alias("prefix"), "s.shard_bytes", "s.shard_docs", "s.keys"), "leaves")
        out.append((bits, leaves))
        left = hist.join(leaves.select("g", "p"), ["g", "p"], "left_anti").select("g", "p")
        if left.isEmpty():
            break
        pending = stored(pending.withColumn("p", F.shiftright("h", BITS - bits)).join(left, ["g", "p"], "left_semi").drop("p"), "pending")
        done, width = bits, step
    return out


def _leaf(rows: DataFrame, found: list[tuple[int, DataFrame]], group: str, hashed: str, to: str) -> DataFrame:
    """rows with `to`, the leaf of their hash in their group's directory, or null."""
    names = []
    for i, (bits, leaves) in enumerate(found):
        p, s = f"__p{to}{i}", f"__s{to}{i}"
        leaves = leaves.select(F.col("g").alias(group), F.col("p").alias(p), F.struct("depth", "prefix", "shard_bytes", "shard_docs").alias(s))
        rows = rows.withColumn(p, F.shiftright(hashed, BITS - bits)).join(leaves, [group, p], "left").drop(p)
        names.append(s)
    return rows.withColumn(to, F.coalesce(*names) if names else F.lit(None).cast("struct<depth:int,prefix:bigint,shard_bytes:bigint,shard_docs:bigint>")).drop(*names)


def assign_shards(docs: DataFrame, limit: int, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with n_bytes, shard, depth, prefix, shard_bytes, shard_docs, oversize.

    A shard's texts have `limit` bytes at most, unless it is one row that has more: that shard is marked oversize. Rows of one key
    are in one shard, unless they alone exceed the limit. shard: `s` and the first bits of the key's hash; where one key's rows are
    split, a dot and the first bits of the row's hash follow. depth: how many bits; prefix: those of the key as a number.

    Null and empty texts have no bytes; a null key is a key, repeated rows are rows. An empty table gives an empty table. Columns
    of keep with the name of a result are refused. To write the shards: `.write.partitionBy("shard")`.
    """
    names = {"n_bytes", "shard", "depth", "prefix", "shard_bytes", "shard_docs", "oversize"}
    if names & set(keep):
        raise ValueError(f"columns that clash with results: {sorted(names & set(keep))}")
    cell = F.col(ROW).getField
    rows = numbered(docs).select(*(cell(c).alias(c) for c in keep), F.coalesce(F.octet_length(cell(text)), F.lit(0)).cast("long").alias("n_bytes"), key_hash(cell(key)).alias("__h"), F.lit(0).cast("long").alias("__g"), F.shiftrightunsigned(F.xxhash64(RID), 4).alias("__r"))
    sizes = stored(rows.groupBy(F.col("__g").alias("g"), F.col("__h").alias("h")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "sizes")
    found = directory(sizes, limit)
    hot = sizes.filter(F.col("b") > limit).select(F.col("h").alias("__h"))  # each holds more than a shard: no more than all bytes / limit
    split = []
    if not hot.isEmpty():
        within = rows.join(F.broadcast(hot), "__h", "left_semi")
        split = directory(stored(within.groupBy(F.col("__h").alias("g"), F.col("__r").alias("h")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "rows"), limit)
    rows = _leaf(_leaf(rows, found, "__g", "__h", "__s"), split, "__h", "__r", "__t")
    bits = lambda s: F.when(F.col(f"{s}.depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(f"{s}.prefix"), F.col(f"{s}.depth"), F.lit("0")))
    name = F.concat(F.lit("s"), bits("__s"), F.when(F.col("__t").isNotNull(), F.concat(F.lit("."), bits("__t"))).otherwise(""))
    size, many = F.coalesce("__t.shard_bytes", "__s.shard_bytes"), F.coalesce("__t.shard_docs", "__s.shard_docs")
    depth = F.col("__s.depth") + F.coalesce("__t.depth", F.lit(0))
    return rows.select(*keep, "n_bytes", name.alias("shard"), depth.alias("depth"), "__s.prefix", size.alias("shard_bytes"), many.alias("shard_docs"), (size > limit).alias("oversize"))
