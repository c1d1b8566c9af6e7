"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window is a set of short shingles with their places. For a window to occur in a document all its shingles must, so
it is enough to look up the rarest one (the prefix of length one that containment 1.0 leaves). Rarity is counted over all documents.
A hit at word p of a shingle at place o of a window of L words can only be the window at p - o: that must lie within the
text (positional and length bounds), and then the words themselves are compared.

The benchmark is the stated query set, held against all rows in blocks of at most block_words words (a longer item is cut into parts
that overlap by a window), so the arrays that tasks get are bounded whatever the benchmark's and its items' size. One block, the
usual case, needs no shuffle of texts at all; of more blocks only the rows with hits are kept, and meet their documents once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkit import ALNUM, RID, ROW, Piece, arrow_task, numbered, pieces, ragged, row_text, stored, whole_rows, window_hash

_SHINGLE = 5


def _lists(values: np.ndarray, groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values by group, and where each of n groups begins (and the end)."""
    order = np.argsort(groups, kind="stable")
    return values[order], np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=n))])


class Block:
    """The windows of some items' words, as arrays.

    text, at: words of each window joined by a space; size: their number; owner, owned: items of each window, by index into items;
    of each shingle of each window its length (kind), hash, window and place there.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes], np.ndarray]], window: int):
        found: dict[bytes, int] = {}
        sizes, pairs, shingles = [], [], []
        self.items = sorted({i for i, _, _ in items if i is not None})
        index = {x: k for k, x in enumerate(self.items)}
        for item, words, hashes in items:
            size = min(window, len(words))
            k = min(_SHINGLE, size)
            shingle = window_hash(hashes, k)
            for i in range(len(words) - size + 1):
                key = b" ".join(words[i : i + size])
                number = found.setdefault(key, len(found))
                if number == len(sizes):
                    sizes.append(size)
                    shingles.append((k, number, shingle[i : i + size - k + 1]))
                if item is not None:
                    pairs.append((number, index[item]))
        self.text = b"".join(found)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        self.size = np.array(sizes, np.int32)
        both = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
        self.owner, self.owned = _lists(both[:, 1], both[:, 0], len(found))
        many = np.array([len(h) for _, _, h in shingles], np.int64)
        self.kind = np.repeat(np.array([k for k, _, _ in shingles], np.int64), many)
        self.of = np.repeat(np.array([w for _, w, _ in shingles], np.int64), many)
        self.place = ragged(many, np.zeros(len(many), np.int64))
        self.hash = np.concatenate([h for _, _, h in shingles]) if shingles else np.zeros(0, np.uint64)
        self.wanted = {k: np.unique(self.hash[self.kind == k]) for k in np.unique(self.kind).tolist()}
        self.probe: dict[int, tuple[np.ndarray, ...]] = {}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Sets `probe`: by shingle length the hashes to look up, and the windows of which each is the rarest shingle, with its place.

        counts: how often each of `wanted` occurs. Of the shingles, only those looked up are kept.
        """
        seen = np.zeros(len(self.hash), np.int64)
        for k, wanted in self.wanted.items():
            own = self.kind == k
            seen[own] = counts[k][np.searchsorted(wanted, self.hash[own])]
        order = np.lexsort((self.place, self.hash, seen, self.of))
        first = order[np.unique(self.of[order], return_index=True)[1]]
        for k in self.wanted:
            mine = first[self.kind[first] == k]
            wanted, which = np.unique(self.hash[mine], return_inverse=True)
            by, begins = _lists(np.arange(len(mine)), which, len(wanted))
            self.probe[k] = wanted, begins, self.of[mine][by], self.place[mine][by]
        self.kind = self.of = self.place = self.hash = np.zeros(0, np.int64)
        self.wanted = {}

    def hits(self, piece: Piece) -> Iterator[tuple[int, int, int, int]]:
        """(text, first word, word after the last, window) of each occurrence of a window in a piece's texts."""
        words, last, doc, raw = piece.words(), piece.last(), piece.doc, piece.buf.tobytes()
        for k, (wanted, begins, of, place) in self.probe.items():
            at, which = _found(piece, words, k, wanted)
            many = begins[which + 1] - begins[which]
            each, at = ragged(many, begins[which]), np.repeat(at, many)
            begin, stop = at - place[each], at - place[each] + self.size[of[each]]
            fits = (begin >= piece.first[doc[at]]) & (stop <= last[at])
            for a, b, d, w in zip(*(x[fits].tolist() for x in (begin, stop, doc[at], of[each]))):
                if b" ".join([raw[x:y] for x, y in zip(piece.start[a:b].tolist(), piece.end[a:b].tolist())]) == self.text[self.at[w] : self.at[w + 1]]:
                    yield d, a - int(piece.first[d]), b - int(piece.first[d]), w


def _found(piece: Piece, words: np.ndarray, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles of `wanted` begin, and which ones."""
    hashes = window_hash(words, k)
    if not len(hashes) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    at = np.flatnonzero(wanted[place] == hashes)
    at = at[at + k <= piece.last()[at]]
    return at, place[at]


def _count(text: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        for batch in batches:
            for piece in pieces(row_text(batch, text), ALNUM, lower=True):
                words = piece.words()
                for k, wanted in shared.value.items():
                    sums[k] += np.bincount(_found(piece, words, k, wanted)[1], minlength=len(wanted))
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["k", "i", "n"])

    return arrow_task(run)


def _occurrences(block: Block, piece: Piece) -> tuple[list[list[int]], list[set[str]]]:
    spans: list[list[int]] = [[] for _ in range(len(piece))]
    items: list[set[str]] = [set() for _ in range(len(piece))]
    for d, a, b, w in block.hits(piece):
        spans[d] += (a, b)
        items[d].update(block.items[o] for o in block.owner[block.owned[w] : block.owned[w + 1]].tolist())
    return spans, items


def _covered(n_words: int, spans: list[int]) -> int:
    if not spans:
        return 0
    mark = np.zeros(n_words, bool)
    for a, b in zip(spans[::2], spans[1::2]):
        mark[a:b] = True
    return int(mark.sum())


def _told(rows: pa.Array, piece: Piece, spans: list[list[int]], items: list) -> pa.RecordBatch:
    hit = [_covered(int(n), s) for n, s in zip(piece.n_words, spans)]
    return pa.RecordBatch.from_arrays([rows, pa.array(piece.n_words.astype(np.int64)), pa.array(hit, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[ROW, "n_words", "n_hit", "spans", "items"])


def _scan(text: str, shared):
    """Texts with what one block, the only one, finds in them; shared is None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(row_text(batch, text), ALNUM, lower=True):
                spans, items = _occurrences(shared.value, piece) if shared else ([[]] * len(piece), [()] * len(piece))
                yield _told(batch.column(ROW).slice(piece.rows.start, len(piece)), piece, spans, items)

    return arrow_task(run)


def _hits(text: str, shared):
    """The rows with hits only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(RID).to_numpy()
            for piece in pieces(row_text(batch, text), ALNUM, lower=True):
                spans, items = _occurrences(shared.value, piece)
                at = [i for i, s in enumerate(spans) if s]
                yield pa.RecordBatch.from_arrays([pa.array(rid[piece.rows][at], pa.int64()), pa.array([spans[i] for i in at], pa.list_(pa.int32())), pa.array([sorted(items[i]) for i in at], pa.list_(pa.string()))], names=["rid", "spans", "items"])

    return arrow_task(run)


def _joined(text: str):
    """Texts with what all blocks have found in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = ([x or [] for x in pc.fill_null(batch.column(c), []).to_pylist()] for c in ("spans", "items"))
            for piece in pieces(row_text(batch, text), ALNUM, lower=True):
                yield _told(batch.column(ROW).slice(piece.rows.start, len(piece)), piece, spans[piece.rows], items[piece.rows])

    return arrow_task(run)


def _blocks(benchmark: DataFrame, text: str, item: str, window: int, most: int) -> Iterator[Block]:
    """The items in blocks of at most `most` words (a window at least)."""
    part, room = [], max(most, window)
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null").toLocalIterator():
        piece = next(pieces(pa.array([row["t"]]), ALNUM, lower=True))
        raw, hashes = piece.buf.tobytes(), piece.words()
        begin, n = 0, len(hashes)
        while begin < n:
            stop = min(n, begin + max(room, window))
            words = [raw[a:b] for a, b in zip(piece.start[begin:stop].tolist(), piece.end[begin:stop].tolist())]
            if len(words) > room and part:
                yield Block(part, window)
                part, room = [], max(most, window)
                continue
            part.append((row["i"], words, hashes[begin:stop]))
            room -= len(words)
            if stop == n:
                break
            begin = stop - window + 1
        if room <= 0:
            yield Block(part, window)
            part, room = [], max(most, window)
    if part:
        yield Block(part, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = 10, block_words: int = 1 << 18) -> DataFrame:
    """docs as column ROW with n_words, n_hit, spans (first word and word after the last of each occurrence) and items.

    Both sides: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A benchmark window is `window` consecutive words of an
    item; an item of fewer words, but not none, is one window. A document word within an occurrence of a window is hit; items
    are the ids (as strings, sorted, each once) of which a window occurs.

    Null and empty texts have no words and no hits; items without words have no windows. An item without an id marks words but
    is not listed. Repeated documents are judged alike; repeated items count once. Empty tables are fine on either side. Other
    columns, null ids and clashing names only travel inside ROW.
    """
    spark, kind = docs.sparkSession, docs.schema.simpleString()
    out = f"{ROW} {kind}, n_words long, n_hit long, spans array<int>, items array<string>"
    base = whole_rows(docs)

    def ready(block: Block):
        wanted = spark.sparkContext.broadcast(block.wanted)
        counts = {k: np.zeros(len(v), np.int64) for k, v in block.wanted.items()}
        for r in base.mapInArrow(_count(text, wanted), "k int, i int, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toLocalIterator():  # a row for each shingle of the block at most
            counts[r["k"]][r["i"]] = r["n"]
        block.choose(counts)
        return spark.sparkContext.broadcast(block)

    blocks = _blocks(benchmark, item_text, item_id, window, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return base.mapInArrow(_scan(text, ready(first) if first else None), out)
    rows, found = numbered(docs), None
    for block in (b for part in ([first, second], blocks) for b in part):
        hits = stored(rows.mapInArrow(_hits(text, ready(block)), "rid long, spans array<int>, items array<string>"), "hits")
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy(F.col("rid").alias(RID)).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return rows.join(found.hint("shuffle_hash"), RID, "left").select(ROW, "spans", "items").mapInArrow(_joined(text), out)
