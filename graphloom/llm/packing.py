"""Mixture-controlled packing: deficit round-robin over source queues.

1. Documents are tokenized where they are read and kept as ids, so that all lengths are known exactly.
2. They are dealt so that the mixture does not depend on how the table is written or sorted: each gets a random place among the texts
   of its source, by a hash of its row's number, and the places of all sources are laid out along one line at the pace of the
   mixture, until a source ends. A partition takes an equal stretch of that line, in its order.
3. A partition holds a queue for every source. A window of max_tokens credits each source with its share of the window; the source
   with the largest deficit is served from the head of its queue, at most one quantum at a visit, and pays for it. Deficits, also
   negative ones, carry over to the next window and to the next partition: a partition packs all it has, so what a source is
   owed when it begins is its share of all tokens in the partitions before, less its own tokens there. These sums are
   one row for each partition and source, and come to a partition as its first rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.textkit import BASES, FULL, LOWER, RID, ROW, Piece, arrow_task, numbered, pieces, ragged, row_text, stored, worker_slot

#: Tokens that wait in a task's queues before windows are filled; more of them keep windows closer to the target.
LOOKAHEAD = 1 << 18
QUANTUM = 2048
CACHE_WORDS = 400_000  # units, looked at between pieces
#: By byte: marks that may follow a word's letters, ASCII letters, second bytes of the Latin letters that begin with C3.
MARK, LETTER, LATIN = (np.isin(np.arange(256), list(chars)) for chars in (b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~", ascii_letters.encode(), {*range(0x80, 0xC0)} - {0x97, 0xB7}))


class Units:
    """Ids of short byte strings, found by arrays: an open-addressing table of numbers into dense arrays of keys and ids.

    A string of up to 16 bytes is its own key (its first and its last 8 bytes, and its length), so equal keys are equal strings.
    """

    def __init__(self, slots: int = 1 << 18):
        self.owner = np.full(slots, -1, np.int32)
        self.n = self.n_ids = 0
        self.key1, self.key2, self.length = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)
        self.at, self.count, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    @staticmethod
    def mixed(key1: np.ndarray, key2: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (key1 * np.uint64(BASES[0])) ^ ((key2 + length) * np.uint64(BASES[1]))
        h ^= h >> np.uint64(29)
        h *= np.uint64(BASES[2])
        return h ^ (h >> np.uint64(32))

    def find(self, h: np.ndarray, key1: np.ndarray, key2: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is unknown."""
        last = len(self.owner) - 1
        found, slot, todo = np.full(len(h), -1, np.int64), (h & np.uint64(last)).astype(np.int64), np.arange(len(h))
        while len(todo):
            at = self.owner[slot]
            right = (self.key1[at] == key1[todo]) & (self.key2[at] == key2[todo]) & (self.length[at] == length[todo]) & (at >= 0)
            found[todo[right]] = at[right]
            onward = ~right & (at >= 0)
            todo, slot = todo[onward], (slot[onward] + 1) & last
        return found

    def _place(self, numbers: np.ndarray, h: np.ndarray) -> None:
        last = len(self.owner) - 1
        slot = (h & np.uint64(last)).astype(np.int64)
        while len(numbers):
            free = self.owner[slot] < 0
            self.owner[slot[free]] = numbers[free]
            lost = self.owner[slot] != numbers
            numbers, slot = numbers[lost], (slot[lost] + 1) & last

    def add(self, h: np.ndarray, key1: np.ndarray, key2: np.ndarray, length: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Takes in new strings with their ids, one after another; returns their numbers. Strings without a key (h is None) stay out of the table."""
        k, total = len(count), self.n + len(count)
        for name, size in (("key1", total), ("key2", total), ("length", total), ("at", total), ("count", total), ("ids", self.n_ids + len(ids))):
            have = getattr(self, name)
            if len(have) < size:
                setattr(self, name, np.concatenate([have, np.zeros(max(size, 2 * len(have)) - len(have), have.dtype)]))
        new = slice(self.n, total)
        self.count[new], self.at[new] = count, self.n_ids + np.cumsum(count) - count
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        numbers = np.arange(self.n, total)
        self.n, self.n_ids = total, self.n_ids + len(ids)
        if h is None:
            return numbers
        self.key1[new], self.key2[new], self.length[new] = key1, key2, length
        if 2 * self.n > len(self.owner):
            size = len(self.owner)
            while size < 4 * self.n:
                size *= 2
            held = np.sort(self.owner[self.owner >= 0]).astype(np.int64)
            self.owner = np.full(size, -1, np.int32)
            self._place(held, self.mixed(self.key1[held], self.key2[held], self.length[held].astype(np.uint64)))
        self._place(numbers, h)
        return numbers


class WordTokenizer:
    """Ids of whole texts, by words.

    For a tokenizer that splits at white space and looks at no word's neighbours (checked at the start), the ids of a text are
    those of its words one after another. A word of Latin letters before some marks is two units, the lower-case letters and
    the marks; any other word is one unit. Each unit is encoded once and kept, and the units of a piece are looked up by arrays.
    Letters need the tokenizer's model only: lower-casing and normalising change nothing in them, and the split leaves them
    whole (also checked). What follows the letters is one piece of the split whatever marks it has, but for the apostrophe.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.units = Units()
        self.long: dict[bytes, int] = {}
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: How the model writes the UTF-8 bytes of Latin letters.
        self.shown = {b: byte_level.pre_tokenize_str(c.lower())[0][0][i] for c in map(chr, range(0xC0, 0x100)) if c.isalpha() for i, b in enumerate(c.lower().encode())}
        probe = "One two, THREE  don't\n\té x1 ### a.b"
        self.by_words = self._ids([probe])[0] == sum(self._ids(probe.split()), []) and all(self._ids(["Ab" + m])[0] == self._ids(["ab"])[0] + self._ids([m])[0] for m in (",", ".###", "!!", "_-", "***|"))
        plain = ["ab", "thousands", "été", "größen", "añadió", "x"]
        self.by_model = self.by_words and [self._stem(w.encode()) for w in plain] == self._ids([w.upper() if "ß" not in w else w for w in plain])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stem(self, stem: bytes) -> list[int]:
        shown = stem.decode() if stem.isascii() else stem.decode("latin-1").translate(self.shown)
        return [t.id for t in self.model.tokenize(shown)]

    def _learn(self, units: list[bytes], stem: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each unit, and all ids."""
        whole = iter(self._ids([u.decode() for u, s in zip(units, stem) if not (s and self.by_model)]))
        found = [self._stem(u) if s and self.by_model else next(whole) for u, s in zip(units, stem)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)

    def _spans(self, piece: Piece) -> tuple[np.ndarray, ...]:
        """Bytes with lower-case letters in words that are letters before marks; start, end, whether it is letters for each unit; first unit of each text."""
        raw, start, end = piece.buf, piece.start, piece.end
        letter, low = LETTER[raw], LOWER[raw]
        wide = np.flatnonzero(raw[:-1] == 0xC3)
        wide = wide[LATIN[raw[wide + 1]]]
        letter[wide] = letter[wide + 1] = True
        low[wide[raw[wide + 1] <= 0x9E] + 1] += 0x20
        middle, todo = end.copy(), np.flatnonzero(MARK[raw[end - 1]])
        for _ in range(8):  # a word with more marks is one unit
            middle[todo] -= 1
            todo = todo[middle[todo] > start[todo]]
            todo = todo[MARK[raw[middle[todo] - 1]]]
        other = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(~letter, out=other[1:])
        plain = other[middle] == other[start]
        odd = np.flatnonzero(~plain)
        middle[odd] = end[odd]
        at = ragged(end[odd] - start[odd], start[odd])
        low[at] = raw[at]
        starts, ends = np.stack([start, middle], 1).ravel(), np.stack([middle, end], 1).ravel()
        full = ends > starts
        letters = np.stack([plain, np.zeros_like(plain)], 1).ravel()
        return low, starts[full], ends[full], letters[full], np.concatenate([[0], np.cumsum(full)])[2 * piece.first]

    def _numbers(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The number of each unit, after unknown ones have been learned."""
        raw = low.tobytes()
        size = end - start
        out = np.empty(len(start), np.int64)
        short = np.flatnonzero(size <= 16)
        s, e, n = start[short], end[short], size[short]
        eight = np.lib.stride_tricks.as_strided(np.frombuffer(raw + bytes(8), np.uint8), (len(raw) + 1, 8), (1, 1))
        key1 = eight[s].view("<u8")[:, 0].astype(np.uint64) & FULL[np.minimum(n, 8)]
        key2 = np.where(n > 8, eight[np.maximum(e - 8, 0)].view("<u8")[:, 0], 0).astype(np.uint64)
        n = n.astype(np.uint64)
        h = Units.mixed(key1, key2, n)
        found = self.units.find(h, key1, key2, n)
        new = np.flatnonzero(found < 0)
        if len(new):
            new = new[np.argsort(h[new], kind="stable")]
            head = np.ones(len(new), bool)
            head[1:] = (key1[new[1:]] != key1[new[:-1]]) | (key2[new[1:]] != key2[new[:-1]]) | (n[new[1:]] != n[new[:-1]])
            first = new[head]
            learned = self._learn([raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())], letters[short[first]].tolist())
            found[new] = self.units.add(h[first], key1[first], key2[first], n[first], *learned)[np.cumsum(head) - 1]
        out[short] = found
        rest = np.flatnonzero(size > 16)
        if len(rest):
            words = [raw[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist())]
            unknown = {w: k for w, k in zip(words, letters[rest].tolist()) if w not in self.long}
            self.long |= zip(unknown, self.units.add(None, None, None, None, *self._learn(list(unknown), list(unknown.values()))).tolist())
            out[rest] = [self.long[w] for w in words]
        return out

    def encode(self, piece: Piece) -> Iterator[bytes]:
        """Ids of each text of a piece that is neither lower-cased nor cut at anything but white space."""
        if not self.by_words:
            raw = piece.buf.tobytes()
            for ids in self._ids([raw[a:b].decode() for a, b in zip(piece.at[:-1].tolist(), piece.at[1:].tolist())]):
                yield np.array(ids, "<u4").tobytes()
            return
        if self.units.n > CACHE_WORDS:
            self.units, self.long = Units(), {}
        *spans, first = self._spans(piece)
        number = self._numbers(*spans)
        count = self.units.count[number]
        ids = self.units.ids[ragged(count, self.units.at[number])].astype("<u4").tobytes()
        until = (np.concatenate([[0], np.cumsum(count)])[first] * 4).tolist()
        for a, b in zip(until[:-1], until[1:]):
            yield ids[a:b]


class Packer:
    """Windows of one partition. Sources have a number each, with their share, what they are owed and a queue."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id, self.waiting = size, first_id, 0
        self.numbers: dict = {}
        self.share, self.owed, self.queues = np.zeros(0), np.zeros(0), []
        self.full = np.zeros(0, bool)  # queues that are not empty

    def credit(self, source, share: float, owed: float) -> None:
        self.numbers[source] = len(self.queues)
        self.queues.append(deque())
        self.share, self.owed, self.full = np.append(self.share, share), np.append(self.owed, owed), np.append(self.full, False)

    def put(self, source, doc, ids: bytes) -> None:
        k = self.numbers[source]
        self.queues[k].append([doc, ids, 0])
        self.full[k] = True
        self.waiting += len(ids) // 4

    def window(self, size: int) -> Iterator[tuple]:
        """Fills one sequence of `size` tokens; the queues must hold as many."""
        self.owed += self.share * size
        room, last, pieces = size, None, []
        while room:
            k = int(np.where(self.full, self.owed, -np.inf).argmax())
            item = self.queues[k][0]
            n = min(room, QUANTUM, len(item[1]) // 4 - item[2])
            if last is item:
                pieces[-1][2] += n
            else:
                pieces.append([item, item[2], n, size - room])
                last = item
            item[2] += n
            room -= n
            self.owed[k] -= n
            if item[2] * 4 == len(item[1]):
                self.queues[k].popleft()
                self.full[k] = bool(self.queues[k])
        self.waiting -= size
        for item, start, n, offset in pieces:
            doc, ids, _ = item
            yield doc, start, n, zlib.crc32(ids[start * 4 : (start + n) * 4]), len(ids) // 4, self.next_id, offset
        self.next_id += 1

    def fill(self, leave: int) -> Iterator[tuple]:
        while self.waiting >= max(leave, self.size):
            yield from self.window(self.size)
        if not leave:  # the rest goes into sequences whose lengths are powers of two: none needs padding
            while self.waiting:
                yield from self.window(1 << (self.waiting.bit_length() - 1))


def _encode(text: str, path: str, end_id: int):
    """Documents without their text but with their ids, of two bytes each where all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = worker_slot(path, lambda: WordTokenizer(path)), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            bare = _without(batch.column(ROW), text)
            for piece in pieces(row_text(batch, text)):
                each = [np.frombuffer(ids + end, "<u4") for ids in tokenizer.encode(piece)]
                data = [(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in each]
                lo = piece.rows.start
                yield pa.RecordBatch.from_arrays([bare.slice(lo, len(piece)), batch.column("source").slice(lo, len(piece)), batch.column(RID).slice(lo, len(piece)), pa.array([len(x) for x in each], pa.int64()), pa.array(data, pa.binary())], names=[ROW, "source", RID, "n", "ids"])

    return arrow_task(run, keep=path)


def _pack(size: int):
    """The rows of a partition come in this order: what its sources are owed, then its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, number = None, None, 0
        held: dict[int, tuple[pa.Array, int]] = {}  # the row of each document that waits

        def told(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            rows = list(found)
            if not rows:
                return
            arrays: dict[int, int] = {}
            kept: list[pa.Array] = []
            take, begin = [], 0
            for r in rows:
                array, i = held[r[0]]
                if id(array) not in arrays:
                    arrays[id(array)] = begin
                    kept.append(array)
                    begin += len(array)
                take.append(arrays[id(array)] + i)
            for r in rows:
                if r[1] + r[2] == r[4]:
                    held.pop(r[0], None)
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(kept).take(pa.array(take)), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[ROW, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            parts, owed, share, sources, counts, data = (batch.column(c).to_pylist() for c in ("part", "owed", "share", "source", "n", "ids"))
            rows = batch.column(ROW)
            for i, p in enumerate(parts):
                if p != part:
                    if packer:
                        yield from told(packer.fill(0))
                    packer, part = Packer(size, p << 40), p
                if data[i] is None:
                    packer.credit(sources[i], share[i], owed[i])
                    continue
                ids = data[i] if len(data[i]) == 4 * counts[i] else np.frombuffer(data[i], "<u2").astype("<u4").tobytes()
                packer.put(sources[i], number, ids)
                held[number] = rows, i
                number += 1
                if packer.waiting >= 2 * LOOKAHEAD:
                    yield from told(packer.fill(LOOKAHEAD))
        if packer:
            yield from told(packer.fill(0))

    return arrow_task(run)


def _without(rows: pa.StructArray, text: str) -> pa.StructArray:
    kept = [f for f in rows.type if f.name != text]
    return pa.StructArray.from_arrays([pa.compute.struct_field(rows, f.name) for f in kept], fields=kept) if kept else rows


_REST = object()


def _placed(rows: DataFrame, share: dict | None) -> DataFrame:
    """rows (source, n) with at: where on the line of all texts, in [0, 1), a document is read.

    share: target share of each source, None for the shares that the sources have.
    """
    u = F.xxhash64(RID).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    if not share:
        return rows.withColumn("at", u)
    known = F.lit(False)
    for s in share:
        known = known | F.col("source").eqNullSafe(F.lit(s))
    by = F.when(known, F.struct("source"))
    total = {r["s"]["source"] if r["s"] else _REST: r["n"] for r in rows.groupBy(by.alias("s")).agg(F.sum("n").alias("n")).collect()}  # a row for each source of the mixture, and one
    ends = {s: total[s] / w for s, w in share.items() if w > 0 and total.get(s)}
    last = max(ends.values(), default=0.0)
    clock = F.lit(last) + u  # sources without a share come after the others
    for s, end in ends.items():
        clock = F.when(F.col("source").eqNullSafe(F.lit(s)), u * F.lit(end)).otherwise(clock)
    within = lambda a, b: F.least(F.greatest(F.col("clock") - F.lit(a), F.lit(0.0)), F.lit(b - a))
    read, begin = within(last, last + 1) * F.lit(float(sum(n for s, n in total.items() if s not in ends))), 0.0
    for end in sorted(set(ends.values())):  # tokens that all sources have been read by then
        read, begin = read + within(begin, end) * F.lit(sum(share[s] for s, e in ends.items() if e >= end)), end
    return rows.withColumn("clock", clock).withColumn("at", read / F.lit(float(max(1, sum(total.values()))))).drop("clock")


def _owed(rows: DataFrame, share: dict | None) -> DataFrame:
    """(part, source, owed, share): what each source of a partition is owed when that begins. rows: part, source, n."""
    sums = rows.groupBy("part", "source").agg(F.sum("n").alias("n"))
    whole = rows.groupBy("part").agg(F.sum("n").alias("all"))  # a row a partition
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = whole.select("part", before(Window.orderBy("part"), "all").alias("before"), F.sum("all").over(Window.partitionBy()).alias("total"))
    if share:
        part_of = F.lit(0.0)
        for s, w in share.items():
            part_of = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(part_of)
    else:
        part_of = F.sum("n").over(Window.partitionBy("source")) / F.col("total")
    own = sums.join(whole.hint("shuffle_hash"), "part")
    own = own.withColumn("share", part_of).withColumn("own", before(Window.partitionBy("source").orderBy("part"), "n"))
    return own.select("part", "source", (F.col("share") * F.col("before") - F.col("own")).alias("owed"), "share")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", source: str = "source", max_tokens: int = 4096, end_id: int = 2, mixture: dict | None = None) -> DataFrame:
    """Pieces of documents in sequences: ROW (the document's other columns), start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer file without special tokens, then end_id. Each id is in exactly one piece. Sequences
    have max_tokens ids, and each task ends with some whose lengths are powers of two, so no sequence needs padding. mixture:
    target share of the tokens for each value of source (others come last); by default each source's share of all bytes.

    A null or empty text is one end_id. A null source is a source. Repeated rows are packed as often as they occur. An empty
    table gives an empty table. Other columns, null ids and clashing names only travel inside ROW.

    A sequence id is the partition's number and a counter, so a task that runs again gives the same rows.
    """
    base = numbered(docs)
    parts = max(1, base._jdf.queryExecution().toRdd().getNumPartitions())
    by = F.col(ROW).getField(source) if source in docs.columns else F.lit(None).cast("string")
    kind = docs.schema[source].dataType.simpleString() if source in docs.columns else "string"
    row = "struct<" + (", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema if f.name != text) or f"`{text}`: string") + ">"
    encoded = stored(base.withColumn("source", by).mapInArrow(_encode(text, tokenizer, end_id), f"{ROW} {row}, source {kind}, {RID} long, n long, ids binary"), "ids")
    share = {s: w / sum(mixture.values()) for s, w in mixture.items()} if mixture else None
    part = F.least(F.floor(F.col("at") * parts), F.lit(parts - 1)).cast("int")
    placed = _placed(encoded, share).withColumn("part", part)
    owed = _owed(placed, share).select("part", F.lit(-1.0).alias("at"), F.lit(None).cast("long").alias(RID), "source", "owed", "share", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast(row).alias(ROW))
    none = F.lit(None).cast("double")
    rows = placed.select("part", "at", RID, "source", none.alias("owed"), none.alias("share"), "n", "ids", ROW).unionByName(owed)
    # The order is that of a sort, else that in which blocks are fetched would show.
    dealt = rows.repartitionById(parts, "part").sortWithinPartitions("part", "at", RID, F.hash("source"), "source")
    numbers = ", ".join(f"{c} long" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    return dealt.drop("at", RID).mapInArrow(_pack(max_tokens), f"{ROW} {row}, {numbers}")
