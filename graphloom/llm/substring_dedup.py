"""Removal of word passages that occur more than once, found through difference-cover anchors.

D is a difference cover modulo P: for any positions i and j there is a shift s < P with (i + s) mod P and (j + s) mod P both
in D. So two equal windows of `window` words share a pair of anchors of `window - P + 1` words that begin s words into both,
and hashing anchors at cover positions only (5 of 21 positions here) finds every equal pair. A repeated anchor is then
extended to the windows around it, and the windows are compared by a 128-bit hash.

Nothing pairs up the members of a group. Rows that repeat among those that a task gathers are marked there, and only one of them
goes to the shuffle, so the most frequent anchor reaches the task of its key once for each such gathering. Exact copies of a text
are collapsed before any hashing: one of them stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.textkit import RID, ROW, Held, arrow_task, kept_texts, mix, numbered, pieces, ragged, row_text, stored, strings, window_hash

#: Perfect difference sets (every difference modulo the period occurs once).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

def repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with these keys: which have an equal among them, and which is the first of its key."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    twin = same.copy()
    twin[:-1] |= same[1:]
    known, first = np.empty_like(twin), np.empty_like(twin)
    known[order], first[order] = twin, ~same
    return known, first


def _emit(keys: list[np.ndarray], rid: np.ndarray, pos: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Rows with keys, row number, position and `known`; a known row that is not the first of its key gets a key of its own."""
    twin, first = repeats(*keys)
    own = mix(rid.astype(np.uint64) ^ (pos.astype(np.uint64) << np.uint64(40)))
    keys = [np.where(first, k, own).view(np.int64) for k in keys]
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(rid), pa.array(pos.astype(np.int32)), pa.array(known | twin)], names=[*(f"h{i + 1}" for i in range(len(keys))), "rid", "pos", "known"])


def _anchors(text: str, window: int, period: int):
    cover, k = np.array(COVERS[period]), window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(np.uint64, np.int64, np.int64)
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for piece in pieces(row_text(batch, text)):
                long = np.flatnonzero(piece.n_words >= window)
                n = piece.n_words[long] - k + 1
                rounds = -(-n // period)
                doc = np.repeat(long, rounds * len(cover))
                local = (ragged(rounds, np.zeros(len(long), np.int64))[:, None] * period + cover).ravel()
                fits = local < np.repeat(n, rounds * len(cover))
                doc, local = doc[fits], local[fits]
                if held.add(window_hash(piece.words(), k)[piece.first[doc] + local], rid[piece.rows][doc], local):
                    key, *rest = held.take()
                    yield _emit([key], *rest, np.zeros(len(key), bool))
        key, *rest = held.take()
        yield _emit([key], *rest, np.zeros(len(key), bool))

    return arrow_task(run)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and their number per row of a list column without null lists inside the values."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten().to_numpy(), counts


def _candidates(text: str, window: int, period: int):
    k = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(np.uint64, np.uint64, np.int64, np.int64, bool)
        for batch in batches:
            rid, copies = batch.column("rid").to_numpy(), batch.column("copies").to_numpy()
            anchors, counts = _lists(batch.column("anchors"))
            stop = np.cumsum(counts)
            for piece in pieces(row_text(batch, text)):
                lo, hi = piece.rows.start, piece.rows.stop
                doc = np.repeat(np.arange(len(piece)), counts[lo:hi])
                anchor = piece.first[doc] + anchors[stop[lo] - counts[lo] : stop[hi - 1]]
                # Windows that hold the anchor begin up to period - 1 words before it.
                edge = np.zeros(len(piece.start) + 1, np.int32)
                np.add.at(edge, np.maximum(anchor - (window - k), piece.first[doc]), 1)
                np.add.at(edge, anchor + 1, -1)
                begin = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (np.arange(len(piece.start)) + window <= piece.last()))
                doc = piece.doc[begin]
                # Two hashes that have nothing in common, from the bytes of the words on.
                if held.add(window_hash(piece.words(1), window, 1)[begin], window_hash(piece.words(2), window, 2)[begin], rid[piece.rows][doc], begin - piece.first[doc], copies[piece.rows][doc] > 1):
                    one, two, *rest = held.take()
                    yield _emit([one, two], *rest)
        one, two, *rest = held.take()
        yield _emit([one, two], *rest)

    return arrow_task(run)


def _removals(text: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied = pc.fill_null(batch.column("copies"), 2).to_numpy() > 1
            starts, counts = _lists(batch.column("starts"))
            stop = np.cumsum(counts)
            for piece in pieces(row_text(batch, text)):
                lo, hi = piece.rows.start, piece.rows.stop
                doc = np.repeat(np.arange(len(piece)), counts[lo:hi])
                begin = piece.first[doc] + starts[stop[lo] - counts[lo] : stop[hi - 1]]
                edge = np.zeros(len(piece.start) + 1, np.int32)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + window, -1)
                drop = np.cumsum(edge[:-1]) > 0
                drop |= np.repeat(copied[piece.rows] & (piece.n_words >= window), piece.n_words)
                removed = np.bincount(piece.doc[drop], minlength=len(piece))
                yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(lo, hi - lo), pa.array(piece.n_words.astype(np.int64)), pa.array(removed.astype(np.int64)), strings(kept_texts(piece, ~drop))], names=[ROW, "n_words", "n_removed", "kept_text"])

    return arrow_task(run)


def remove_repeated_passages(docs: DataFrame, text: str = "text", window: int = 35, period: int = 21) -> DataFrame:
    """docs as column ROW (a struct of all its columns) with n_words, n_removed and kept_text.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if a window of `window` words that covers it also starts anywhere else, in
    the same text or another; all windows are judged on the input. The kept words are joined by one space.

    Null and empty texts have no words and an empty kept text. Texts of fewer than `window` words stay whole. Rows that repeat
    are documents of their own, so exact repeats of a row lose all their words if they have `window` of them. An empty table
    gives an empty table. Other columns, null ids and clashing names only travel inside ROW.
    """
    if period not in COVERS or window <= period:
        raise ValueError(f"period must be one of {sorted(COVERS)} and below the window")
    base = numbered(docs).withColumnRenamed(RID, "rid")
    copy = F.unhex(F.md5(F.coalesce(F.col(ROW).getField(text), F.lit("")).cast("binary")))
    # One row for each different text, that of its first copy. What is said of it holds for all of them: their windows all repeat.
    texts = stored(base.select("rid", copy.alias("copy")).groupBy("copy").agg(F.count("*").alias("copies"), F.min("rid").alias("rid")).select("rid", "copies"), "texts")
    # Every use of the texts takes the same columns of base by the same key, so their exchange is written once and used again.
    heads = base.join(texts.select("rid").hint("shuffle_hash"), "rid")
    anchors = heads.select("rid", ROW).mapInArrow(_anchors(text, window, period), "h1 long, rid long, pos int, known boolean")
    shared = anchors.withColumn("n", F.count("*").over(Window.partitionBy("h1"))).filter("known or n > 1")
    shared = shared.groupBy("rid").agg(F.collect_list("pos").alias("anchors"))
    found = base.join(texts.join(shared, "rid").hint("shuffle_hash"), "rid").select("rid", ROW, "copies", "anchors")
    windows = found.mapInArrow(_candidates(text, window, period), "h1 long, h2 long, rid long, pos int, known boolean")
    repeated = windows.withColumn("n", F.count("*").over(Window.partitionBy("h1", "h2"))).filter("known or n > 1")
    repeated = repeated.groupBy("rid").agg(F.collect_list("pos").alias("starts"))
    # A row that has none here is a further copy of a text.
    last = base.join(texts.join(repeated, "rid", "left").hint("shuffle_hash"), "rid", "left").select(ROW, "copies", "starts")
    return last.mapInArrow(_removals(text, window), f"{ROW} {docs.schema.simpleString()}, n_words long, n_removed long, kept_text string")
