"""Near-duplicate components by an exact n-gram Jaccard join over size-banded tiles with bitmap signatures.

1. Exact copies of a text collapse into one. Shingles that repeat often are marked in a Bloom filter and come last in the global
   order of shingles (any one order is exact; a false mark is harmless). At most HEAVY shingles are marked, the most frequent.
2. Each text emits the first n - ceil(t n) + ceil(n / 10) shingles of its set. Two sets that reach the threshold share at least
   ceil(n / 10) of them for the smaller set's n, so texts with fewer shared ones drop out: texts that only share a passage.
3. The rest meet in tiles, one per shared shingle. Inside a tile sets are ordered by size and a set is held against its band of
   sizes only (n_j <= n_i / t); bit counts of hashed bitmaps bound the overlap from above before sorted arrays are intersected.
   Each text first goes, with its set, to the tile of its smallest shared shingle, where links are exact. This is done again under
   other orders, which other members of a group share, until a round finds no link, HOMES times at most: a text goes to one tile a
   round, so the rows of a round are no more than the texts, and large groups of near copies are one component before step 4.
4. Then all tiles are gone through for pairs across components, in the end for every pair; if the last round of step 3 still found
   links, first for the likeliest few of each two components. There a tile is a shingle and a band of sizes, in which a set meets
   those of its own band and of the one below. Tiles of the same members are one tile that counts as many times, so
   shingles that the same texts share cost a pair one row. A pair's shared emitted shingles are counted over its tiles: each
   emitted one that it does not share lowers the bound, also where very long sets fill the bitmaps. Only pairs that both bounds
   leave are verified on the sets. Members of one component are never paired, so a large group costs no pairs; tiles beyond BLOCK
   members are cut into pairs of blocks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.llm.substring_dedup import repeats
from graphloom.llm.textkit import FLUSH_ROWS, RID, ROW, SPACED, Held, Piece, arrow_task, delete, exchanges_freed, hot_join, mix, numbered, pieces, ragged, row_text, scratch, stored, window_hash

BLOCK = 4096
BLOCK_SHINGLES = 1 << 20  # of the sets that meet at once in a home tile
FREQUENT = 64
HEAVY = 1 << 22
HOMES = 6  # rounds in which a text goes to one tile with its set
WORDS64 = 32  # of a bitmap
WIDEST = 4 * WORDS64  # of the bitmap of a long set; wider ones would cost long texts the square of their length
PAIRS = 1 << 15  # whose bitmaps are compared at a time, fewer if they are wide
NEAR = 2  # partners of a text in another component and tile, in the first round
BEST = 8  # pairs of two components that the first round verifies


def _sets(piece: Piece, k: int, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order within each text, the text of each, and the size of each set."""
    words, n = piece.words(), piece.n_words
    at = np.flatnonzero(np.arange(len(words)) + k <= piece.last())
    hashes, docs = [window_hash(words, k)[at]], [piece.doc[at]]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            hashes.append(window_hash(words, size)[piece.first[short]])
            docs.append(short)
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, doc) if heavy is None else (h, _marked(heavy, h), doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, doc, np.bincount(doc, minlength=len(piece))


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    last = np.uint64(len(bits) * 64 - 1)
    test = lambda i: (bits[(i & last) >> np.uint64(6)] >> (i & np.uint64(63))) & np.uint64(1) > 0
    return test(h) & test(h >> np.uint64(32))


def _frequent(text: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            h, n = np.unique(held.take()[0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        held = Held(np.uint64)
        for batch in batches:
            for piece in pieces(row_text(batch, text), SPACED, lower=True):
                if held.add(_sets(piece, k)[0]):
                    yield counted()
        yield counted()

    return arrow_task(run)


def _marks(often: DataFrame) -> np.ndarray:
    """A Bloom filter of the most frequent shingles (h, n), HEAVY at most: 16 to 32 bits for each of them."""
    sizes = {r["k"]: r["count"] for r in often.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}  # 64 rows at most
    least, count = 64, 0
    while least > math.log2(FREQUENT) and count + sizes.get(least - 1, 0) <= HEAVY:
        least -= 1
        count += sizes.get(least, 0)
    bits = max(16, (16 * max(1, count) - 1).bit_length())
    last = (1 << bits) - 1
    place = F.explode(F.array(F.col("h").bitwiseAND(F.lit(last)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(last))))
    often = often.filter(F.col("n") >= max(FREQUENT, 2.0**least)).select(place.alias("i"))
    masks = often.select(F.shiftright("i", 6).alias("w"), F.expr("shiftleft(1L, cast(i & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros((last + 1) // 64, np.uint64)
    for r in masks.toLocalIterator():  # 2 * HEAVY rows at most
        out[r["w"]] = np.uint64(r["m"] & (2**64 - 1))
    return out


def _ceil(a: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-a * num // den)


def _postings(text: str, k: int, percent: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keyed() -> pa.RecordBatch:
            h, rid, n, meta = held.take()
            own = mix(rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(h), dtype=np.uint64))
            known, first = repeats(np.where(meta, own, h))
            key = np.where(first & ~meta, h, own)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.where(key == h, np.uint64(0), h).view(np.int64)), pa.array(rid), pa.array(n.astype(np.int32)), pa.array(known & ~meta), pa.array(meta)], names=["key", "other", "rid", "n", "known", "meta"])

        held = Held(np.uint64, np.int64, np.int64, bool)
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for piece in pieces(row_text(batch, text), SPACED, lower=True):
                h, doc, n = _sets(piece, k, heavy.value)
                rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                take = rank < (n - _ceil(n, percent, 100) + _ceil(n, 1, 10))[doc]
                own = rid[piece.rows]
                held.add(np.zeros(len(piece), np.uint64), own, n, np.ones(len(piece), bool))
                if held.add(h[take], own[doc[take]], n[doc[take]], np.zeros(int(take.sum()), bool)):
                    yield keyed()
        yield keyed()

    return arrow_task(run)


def _set_rows(text: str, k: int, bitmaps: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(row_text(batch, text), SPACED, lower=True):
                h, doc, n = _sets(piece, k)
                stop = np.cumsum(n)
                each = [h[b - c : b] for c, b in zip(n.tolist(), stop.tolist())]
                data = [_bitmap(x, _width(len(x))).tobytes() if bitmaps else x.tobytes() for x in each]
                rest = [c for c in batch.schema.names if c != ROW]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(piece.rows.start, len(piece)) for c in rest), pa.array(n.astype(np.int32)), pa.array(data, pa.binary())], names=[*rest, "n", "data"])

    return arrow_task(run)


def _bitmap(h: np.ndarray, words: int = WORDS64) -> np.ndarray:
    bits = np.zeros(words * 64, np.uint8)
    bits[(mix(h) % np.uint64(words * 64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _width(n: int) -> int:
    """Words of the bitmap of a set of n: a bit for each element, so that it is not filled, WIDEST at most."""
    return min(WIDEST, max(WORDS64, (1 << n.bit_length()) // 64))


def _folded(data: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of `words` or more words as rows of `words`: a wide one, folded, is the narrow one of the same set."""
    rows = [x if len(x) == 8 * words else np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, words)).tobytes() for x in data]
    return np.frombuffer(b"".join(rows), np.uint64).reshape(-1, words)


def _reaches(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def _bound(bits: np.ndarray, i: int, js: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The most that sets i and j can have in common: each bit that only one has is an element that the other lacks."""
    both = np.bitwise_count(bits[js] & bits[i]).sum(1, dtype=np.int64)
    count = np.bitwise_count(bits[i]).sum(dtype=np.int64)
    return np.minimum(n[i] - (count - both), n[js] - (np.bitwise_count(bits[js]).sum(1, dtype=np.int64) - both))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of rows whose first `keys` columns are equal; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _exact_tile(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            if table.num_rows < 2:
                continue
            n = table.column("n").to_numpy().astype(np.int64)
            order = np.argsort(n, kind="stable")
            n, rid = n[order], table.column("rid").to_numpy()[order]
            data = table.column("data").to_pylist()
            sets = [np.frombuffer(data[i], np.uint64) for i in order.tolist()]
            bits = np.stack([_bitmap(s) for s in sets])
            part = table.column("part").to_numpy()[order].copy()
            stop = np.searchsorted(n, n * 100 // percent, "right")
            links = []
            for i in range(len(n)):
                js = np.arange(i + 1, stop[i])
                js = js[part[js] != part[i]]
                if not len(js):
                    continue
                most = _bound(bits, i, js, n)
                fits = _reaches(most, n[i], n[js], percent)
                for j in js[fits][np.argsort(-most[fits], kind="stable")].tolist():
                    if part[j] != part[i] and _reaches(np.intersect1d(sets[i], sets[j], True).size, n[i], n[j], percent):
                        part[part == part[j]] = part[i]
                        links.append((rid[i], rid[j]))
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return arrow_task(run)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows whose first `keys` columns are equal, some at a time, with the number of each row's group; the rows come sorted by them."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if held is not None:
            table = held if table is None else pa.concat_tables([held, table]).combine_chunks()
        if table is None:
            return
        cols = [table.column(i).to_numpy() for i in range(keys)]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        cut = table.num_rows if batch is None else int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut), np.concatenate([[0], np.cumsum(new[: cut - 1])])


def _likely_pairs(percent: int, most_each: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _runs(batches, 4):
            if "weight" not in table.column_names:  # each tile counts once
                table = table.append_column("weight", pa.array(np.ones(table.num_rows, np.int64)))
            data, table = table.column("data").to_pylist(), table.drop_columns("data")
            # The bitmaps of a tile are as wide as its narrowest.
            width = np.array([len(x) // 8 for x in data])
            width = np.minimum.reduceat(width, np.flatnonzero(np.diff(group, prepend=-1)))[group]
            for words in np.unique(width).tolist():
                rows = np.flatnonzero(width == words)
                yield from _pairs_of(table.take(rows), group[rows], _folded([data[x] for x in rows.tolist()], words), percent, most_each)

    return arrow_task(run)


def _pairs_of(table: pa.Table, group: np.ndarray, bits: np.ndarray, percent: int, most_each: int | None) -> Iterator[pa.RecordBatch]:
    n = table.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((n, group))
    n, group, bits = n[order], group[order], bits[order]
    rid, part, own, one, other, visits, weight = (table.column(c).to_numpy()[order] for c in ("rid", "part", "own", "i", "j", "visits", "weight"))
    lack = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
    stop = np.searchsorted((group << 32) + n, (group << 32) + n * 100 // percent, "right")
    counts = stop - np.arange(len(n)) - 1
    until = np.cumsum(counts)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(until, until[lo] - counts[lo] + PAIRS * WORDS64 // bits.shape[1], "right")))
        i, j = np.repeat(np.arange(lo, hi), counts[lo:hi]), ragged(counts[lo:hi], np.arange(lo, hi) + 1)
        lo = hi
        apart = (part[i] != part[j]) & ((one[i] == other[i]) | (own[i] != own[j])) & ~((visits[i] > 0) & (visits[j] > 0))
        i, j = i[apart], j[apart]
        # Each bit that only one has is an element that the other lacks.
        both = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        most = both + np.minimum(lack[i], lack[j])
        fits = _reaches(most, n[i], n[j], percent)
        i, j, most = i[fits], j[fits], most[fits]
        if most_each is not None and len(i):
            by = np.lexsort((-most, part[j], i))
            i, j, most = i[by], j[by], most[by]
            start = np.ones(len(i), bool)
            start[1:] = (i[1:] != i[:-1]) | (part[j][1:] != part[j][:-1])
            near = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) < most_each
            i, j, most = i[near], j[near], most[near]
        if len(i):
            swap = rid[i] > rid[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rid[i], rid[j], part[i], part[j], n[i], n[j], most, weight[i])], names=[*PAIR_COLUMNS, "weight"])


PAIR_COLUMNS = ["a", "b", "part_a", "part_b", "n_a", "n_b", "most"]


def _emitted(n: str, percent: int) -> str:
    """SQL for the number of shingles that a set of n emits."""
    return f"{n} - ({n} * {percent} + 99) div 100 + ({n} + 9) div 10"


def _promising(pairs: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs (a, b) that can reach the threshold by bitmaps and shared emitted shingles, or the best of each two components.

    The set whose emitted shingles end first in the order lacks none of its shared ones among the other's, so what it emitted and
    does not share is not in the other set. Which one ends first is not known here; the larger bound of the two holds anyway.
    """
    each = pairs.groupBy("a", "b").agg(F.sum("weight").alias("k"), F.min("most").alias("most"), *(F.first(c).alias(c) for c in PAIR_COLUMNS[2:-1]))
    each = each.withColumn("most", F.expr(f"least(most, greatest(n_a - ({_emitted('n_a', percent)}) + k, n_b - ({_emitted('n_b', percent)}) + k))"))
    each = each.filter(F.expr(f"100 * most >= {percent} * (n_a + n_b - most)"))
    if best is None:
        return each.select("a", "b")
    top = F.max(F.struct(F.expr("most / (n_a + n_b - most)"), "k", "a", "b")).alias("t")
    return each.groupBy(F.least("part_a", "part_b"), F.greatest("part_a", "part_b"), F.pmod(F.xxhash64("a"), F.lit(best))).agg(top).select("t.a", "t.b")


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            ok = []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                ok.append(bool(_reaches(np.intersect1d(s, t, True).size, len(s), len(t), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow_task(run)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that a task holds at a time become links of each node to the smallest node that they reach."""

    def star() -> pa.RecordBatch:
        u, v = held.take()
        nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, least = where[: len(u)], where[len(u) :], np.arange(len(nodes))
        while True:
            low = np.minimum(least[a], least[b])
            new = least.copy()
            for ends in (a, b, least[a], least[b]):
                np.minimum.at(new, ends, low)
            new = new[new]
            if (new == least).all():
                break
            least = new
        out = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[least[out]])], names=["u", "v"])

    held = Held(np.int64, np.int64)
    for batch in batches:
        if held.add(*(batch.column(c).to_numpy() for c in ("u", "v"))):
            yield star()
    yield star()


def components(links: DataFrame) -> DataFrame:
    """(rid, part) for every end of a link (a, b); part is the smallest rid that links reach.

    Links are dealt into parts of FLUSH_ROWS; each part becomes stars. Then large-star and small-star steps alternate until all
    links are stars; one part alone already is. All of it stays distributed, and each round is stored.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "links")
    parts = max(1, math.ceil(edges.count() / FLUSH_ROWS))
    edges = stored(edges.repartition(parts).mapInArrow(arrow_task(_stars), "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    seen = None
    while parts > 1:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    return edges.select(F.col("u").alias("rid"), F.col("v").alias("part")).union(edges.select("v", "v").distinct())


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (rid, part) after links (a, b) too."""
    return components(parts.select(F.col("rid").alias("a"), F.col("part").alias("b")).union(links))


class Bucketed:
    """A table in the shared folder, dealt into buckets by key: joins on the key leave its rows where they are. Gone after the `with`."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key, self.spark = df, key, df.sparkSession
        self.name = f"graphloom_{uuid.uuid4().hex}"
        self.path = f"{scratch(self.spark)}/{self.name}"

    def __enter__(self) -> DataFrame:
        with exchanges_freed(self.spark):
            self.df.write.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.key).format("parquet").option("path", self.path).saveAsTable(self.name)
        return self.spark.table(self.name)

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def _tiles(marked: DataFrame, percent: int) -> DataFrame:
    """marked (h, rid, n, part) as members of tiles (h, band).

    Sets that can link differ by a factor of 100 / percent at most, so by one band at most: a set is a member of its own band's tile
    and a visitor in the tile above. The width is a little more than the factor, so that rounding cannot part two bands.
    """
    width = max(math.log(100 / percent), 0.01) * 1.000001
    band = F.floor(F.log("n") / width).cast("long")
    return marked.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).select("h", (band + F.col("v")).alias("band"), "rid", "part", F.col("v").cast("long").alias("visits"), F.lit(1).cast("long").alias("weight"))


def _marked_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, "rid", "left").withColumn("part", F.coalesce("part", "rid"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The members of tiles that hold sets of several components, with the number of the tile's blocks.

    Of the tiles of a band that have the same members (by two independent 64-bit hashes and their number) one stays, with the
    weight of all.
    """
    same = [F.bit_xor(F.xxhash64(F.lit(k), "rid", "visits")).alias(f"s{k}") for k in range(2)]
    mixed = rows.groupBy("h", "band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("visits").alias("own"), F.count("*").alias("c"), F.max("weight").alias("weight"), *same)
    one = mixed.filter("lo < hi and own = 0").groupBy("band", "c", "s0", "s1").agg(F.min("h").alias("h"), F.sum("weight").alias("weight"))
    return rows.drop("weight").join(one.select("h", "band", "weight", F.ceil(F.col("c") / BLOCK).alias("blocks")), ["h", "band"])


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 75) -> DataFrame:
    """docs as column ROW with n_shingles, component_id (smallest id that links reach) and keeper (true in one row of each component).

    A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`. The set of a text: its distinct `shingle`-word shingles; with fewer words the whole
    sequence as one. Two rows link when 100 * intersection >= percent * union. Exact: no link between different texts is lost.

    Null and empty texts and texts without words have an empty set and link with nothing, so each is a component of its own. Repeated
    rows link with each other. Null ids count for component_id only if a component has no other; the keeper is the row with the
    smallest id, null ids last, then the first row. An empty table gives an empty table. Other columns and clashing names
    only travel inside ROW.
    """
    spark = docs.sparkSession
    base = numbered(docs).withColumnRenamed(RID, "rid")
    copy = F.unhex(F.md5(F.coalesce(F.col(ROW).getField(text), F.lit("")).cast("binary")))
    keyed = base.select("rid", F.col(ROW).getField(id_col).alias("id"), copy.alias("copy"))
    # One row for each different text: its first row, how many there are, their smallest id and which of them would be kept.
    texts = stored(keyed.groupBy("copy").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"), F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("best")), "texts")
    heads = base.select("rid", F.struct(F.col(ROW).getField(text).alias(text)).alias(ROW)).join(texts.select("rid").hint("shuffle_hash"), "rid")
    with Bucketed(heads, "rid") as heads:
        parts, sizes = _components(heads, base, text, shingle, percent)
    # A text without shingles links with nothing, not even with its copies: each row of it is a component of its own.
    told = texts.join(sizes, "rid").join(parts, "rid", "left").withColumn("part", F.coalesce("part", "rid"))
    told = stored(told.select("copy", "copies", "n_shingles", "part", "id", "best"), "told")
    first = stored(told.groupBy("part").agg(F.min("id").alias("component_id"), F.min("best")["rid"].alias("kept"), F.count("*").alias("weight")), "first")
    n_texts = told.count()
    whole = stored(hot_join(told.select("copy", "copies", "n_shingles", "part"), first, "part", "weight", n_texts).select("copy", "copies", "n_shingles", "component_id", "kept"), "whole")
    rows = base.select("rid", F.col(ROW), copy.alias("copy"))
    total = texts.agg(F.sum("copies")).first()[0] or 0
    out = hot_join(rows, whole, "copy", "copies", total)
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col(ROW).getField(id_col)).otherwise(F.col("component_id"))
    return out.select(ROW, "n_shingles", component.alias("component_id"), (alone | (F.col("rid") == F.col("kept"))).alias("keeper"))


def _components(heads: DataFrame, base: DataFrame, text: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rid, part) of the texts that have links, and (rid, n_shingles) of all. heads: rid and ROW, one row for each different text."""
    local = base.select(ROW).mapInArrow(_frequent(text, shingle), "h long, n long")
    heavy = heads.sparkSession.sparkContext.broadcast(_marks(stored(local.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT), "often")))

    posted = heads.select("rid", ROW).mapInArrow(_postings(text, shingle, percent, heavy), "key long, other long, rid long, n int, known boolean, meta boolean")
    shared = posted.withColumn("c", F.count("*").over(Window.partitionBy("key"))).filter("meta or known or c > 1")
    shared = stored(shared.select(F.when(F.col("other") == 0, F.col("key")).otherwise(F.col("other")).alias("h"), "rid", "n", "meta"), "shared")
    sizes, tiles = shared.filter("meta").select("rid", F.col("n").cast("long").alias("n_shingles")), shared.filter("not meta").select("h", "rid", "n")

    least = F.ceil(F.ceil(F.col("n") * percent / 100) / 10)
    homes = F.array(*(F.min(F.xxhash64(F.lit(k), "h")) for k in range(HOMES))).alias("homes")
    likely = stored(tiles.groupBy("rid").agg(F.count("*").alias("c"), F.first("n").alias("n"), homes).filter(F.col("c") >= least).select("rid", "homes", "n"), "likely")
    parts = likely.select("rid", F.col("rid").alias("part"))
    for k in range(HOMES):
        at = _marked_parts(likely.select("rid", "n", F.col("homes")[k].alias("home")), parts)
        # A bitmap and what goes with it take the room of some 64 shingles.
        blocks = at.groupBy("home").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.sum(F.col("n") + 64) / BLOCK_SHINGLES).alias("blocks")).filter("lo < hi")
        at = at.join(blocks.select("home", "blocks"), "home").select("rid", "part", "home", F.pmod(F.xxhash64(F.lit(k), "rid"), "blocks").alias("block"))
        placed = heads.join(at.hint("shuffle_hash"), "rid").select("home", "block", "rid", "part", ROW).mapInArrow(_set_rows(text, shingle, False), "home long, block long, rid long, part long, n int, data binary")
        links = stored(placed.repartition("home", "block").sortWithinPartitions("home", "block").mapInArrow(_exact_tile(percent), "a long, b long"), "links")
        settled = links.isEmpty()
        if settled:
            break
        parts = _joined(parts, links)

    with Bucketed(tiles.join(likely.select("rid"), "rid", "left_semi").repartition(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid"), "rid") as tiles:
        members = stored(_mixed(_tiles(_marked_parts(tiles, parts), percent)), "members")
    rounds = ((None, None),) if settled else ((NEAR, BEST), (None, None))
    for k, (most_each, best) in enumerate(rounds):
        if k:  # components have only grown, so tiles of one component need no second look
            members = stored(_mixed(_marked_parts(members.drop("part", "blocks"), parts)), "members")
        if members.isEmpty():
            return parts, sizes
        bitmaps = heads.join(members.select("rid").distinct().hint("shuffle_hash"), "rid").select("rid", ROW).mapInArrow(_set_rows(text, shingle, True), "rid long, n int, data binary")
        own = members.join(bitmaps, "rid").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")))
        cut = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("h", "band", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "rid", "part", "own", "visits", "n", "data", "weight")
        keys = ("h", "band", "i", "j")
        pairs = cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_likely_pairs(percent, most_each), ", ".join(f"{c} long" for c in (*PAIR_COLUMNS, "weight")))
        pairs = stored(_promising(pairs, percent, best), "pairs")
        ends = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
        sets = heads.join(ends.hint("shuffle_hash"), "rid").select("rid", ROW).mapInArrow(_set_rows(text, shingle, False), "rid long, n int, data binary")
        both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("data").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("data").alias("y")), "b")
        parts = _joined(parts, stored(both.select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long"), "links"))
    return parts, sizes
