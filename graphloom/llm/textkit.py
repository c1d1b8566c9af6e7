"""Shared pieces of the text operators: vectorised words and hashes, stable row numbers, scratch folders.

Texts travel as Arrow batches of a few MB. A batch is cut into pieces of half a MB so that the numpy arrays of one piece stay small
whatever the batch size; a text longer than a piece is a piece of its own, so texts are never cut. Words and windows are hashed by
chains of a bijective mixer, not by a polynomial, so no repetitive text makes two of them equal by algebra.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import blake2b
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RID = "__rid"
ROW = "__row"
PIECE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
FLUSH_ROWS = 1 << 18  # rows that a task gathers before it passes them on
LONG_WORD = 64  # bytes beyond which a word is hashed by itself


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of a word `[^\x20\x09-\x0D]+`: a UTF-8 continuation byte is never a separator, so bytes are as good as characters.
SPACED = ~_mask((0x20, 0x20), (0x09, 0x0D))
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = _mask((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers, one for each independent hash.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xDA942042E4DD58B5)
#: Masks of the first n bytes of eight.
FULL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _eights(buf: np.ndarray) -> np.ndarray:
    """Row i: the bytes i to i + 7 of buf, zeros beyond its end."""
    return np.lib.stride_tricks.as_strided(np.concatenate([buf, np.zeros(8, np.uint8)]), (len(buf) + 1, 8), (1, 1))


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every span: eight bytes at a time go through the mixer; long spans by blake2b."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(BASES[which]))
    long = np.flatnonzero(size > LONG_WORD)
    todo, eight, times = np.flatnonzero(size <= LONG_WORD), _eights(buf), np.uint64(BASES[which])
    at, left = starts[todo], size[todo]
    while len(todo):
        block = eight[at].view("<u8")[:, 0] & FULL[np.minimum(left, 8)]
        out[todo] = mix((out[todo] ^ block) * times)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in long.tolist():
        out[i] = int.from_bytes(blake2b(buf[starts[i] : ends[i]].data, digest_size=8, salt=bytes([which])).digest(), "little")
    return out


def _joined(x: np.ndarray, y: np.ndarray, which: int) -> np.ndarray:
    return mix((x * np.uint64(BASES[which])) ^ (y >> np.uint64(23)) ^ (y << np.uint64(41)))


def window_hash(values: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """A 64-bit hash of values[i : i + k] for every i, by halves: a step over the whole array for each bit of k."""
    out, done, power, size = None, 0, values, 1
    while True:
        if k & size:
            out, done = (power, size) if out is None else (_joined(power[: max(0, len(out) - size)], out[size:], which), done + size)
        if done == k:
            return out[: max(0, len(values) - k + 1)]
        power = _joined(power[: max(0, len(power) - size)], power[size:], which)
        size *= 2


def span_digest(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of blake2b of the bytes of every span, as two arrays."""
    raw = memoryview(np.ascontiguousarray(buf))
    both = np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Piece:
    """Some texts of a batch as one byte array.

    rows: the slice of the batch; at: where each text begins (and the end); start, end: byte span of each word;
    first: index of the first word of each text (and the number of words); doc: text of each word.
    """

    def __init__(self, buf: np.ndarray, at: np.ndarray, rows: slice, letters: np.ndarray, lower: bool):
        self.rows, self.at = rows, at
        self.buf = LOWER[buf] if lower else buf
        self.inside = inside = letters[self.buf]
        turn = np.empty(len(inside) + 1, bool)  # where a word begins or ends
        turn[1:-1] = inside[1:] != inside[:-1]
        turn[0], turn[-1] = inside[:1].any(), inside[-1:].any()
        edges = np.flatnonzero(turn)
        # Two texts may meet inside a run of word bytes: there one word ends and the next begins.
        meet = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(inside))]
        meet = np.unique(meet[inside[meet - 1] & inside[meet]]) if len(meet) else meet
        if len(meet):
            edges = np.sort(np.concatenate([edges, meet, meet]))
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, at)
        self.n_words = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def words(self, which: int = 0) -> np.ndarray:
        return word_hash(self.buf, self.start, self.end, which)

    def last(self) -> np.ndarray:
        """For each word, the index after the last word of its text."""
        return np.repeat(self.first[1:], self.n_words)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def pieces(column: pa.Array, letters: np.ndarray = SPACED, lower: bool = False, most: int = PIECE_BYTES) -> Iterator[Piece]:
    buf, at = flat(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield Piece(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], slice(lo, hi), letters, lower)
        lo = hi


def ragged(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift


def strings(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string()) if parts else pa.array([], pa.string())


def kept_texts(piece: Piece, keep: np.ndarray) -> list[bytes]:
    """For each text its kept words joined by one space."""
    if not len(piece.start):
        return [b""] * len(piece)
    starts, ends, doc = piece.start[keep], piece.end[keep], piece.doc[keep]
    n = len(piece.buf)
    lead = np.ones(len(starts), bool)
    lead[1:] = doc[1:] != doc[:-1]
    edge = np.zeros(n + 1, np.int8)
    edge[starts - ~lead] += 1
    edge[ends] -= 1  # spans do not overlap, so no index comes twice in either
    take = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # Two kept neighbours meet at one separator: it is a byte of the second one's span.
    out = np.where(piece.inside, piece.buf, 32)[take].astype(np.uint8)
    per_doc = np.bincount(doc, weights=(ends - starts + ~lead), minlength=len(piece)).astype(np.int64)
    stop = np.cumsum(per_doc)
    raw = out.tobytes()
    return [raw[b - k : b] for k, b in zip(per_doc.tolist(), stop.tolist())]


# --- Spark side -------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared folder of the cluster (spark.checkpoint.dir); a local one only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/graphloom-checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


@contextmanager
def exchanges_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, the exchange files of a write go once the write is done: what follows reads the written table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_made: list[str] = []


def stored_at(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """df written as Parquet into the shared folder and read back (short lineage that any executor can read again), and its path."""
    path = f"{scratch(df.sparkSession)}/{name}"
    _made.append(path)
    with exchanges_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    return stored_at(df, name)[0]


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tables_dropped(spark: SparkSession) -> Iterator[list[str]]:
    """The tables that are stored within it go at its end, but for those whose path is then in the list."""
    first, kept = len(_made), []
    try:
        yield kept
    finally:
        mine = _made[first:]
        del _made[first:]
        _made.extend(p for p in mine if p in kept)
        delete(spark, *(p for p in mine if p not in kept))


def hot_join(rows: DataFrame, told: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """rows joined with told, which has one row for each key and says in `weight` how many of the `total` rows have it.

    Keys with more than a 10,000th of all rows are 10,000 at most: they are broadcast and their rows stay where they are. The rows
    of the other keys go to the task of their key.
    """
    limit = max(1000, total // 10_000)
    hot, rest = told.filter(F.col(weight) > limit), told.filter(F.col(weight) <= limit)
    if hot.isEmpty():
        return rows.join(told.hint("shuffle_hash"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(rest.hint("shuffle_hash"), key))


def heap_returned(spark: SparkSession) -> None:
    """Each executor collects its garbage, so that the heap which grew in earlier jobs goes back to the system.

    A JVM keeps the pages of its largest heap until a full collection, beside the Python workers of later jobs. Tasks are offered to
    one executor after another, so as many tasks as executors reach each idle one once; one that is busy may be left out.
    """
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # it lists the driver too
    spark.range(0, executors, 1, executors).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


_ABOVE = {"Project", "Filter", "SubqueryAlias", "View"}


def _is_scan(plan) -> bool:
    """Whether a plan is one Parquet scan with selections on top: its rows then have a file and a place in it."""
    if not plan.deterministic():
        return False
    while plan.nodeName() in _ABOVE:
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation" and "HadoopFsRelation" in plan.relation().getClass().getName() and plan.relation().fileFormat().toString() == "Parquet"


def _ready(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, and get batches and an allocator that keep them small."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for key, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_MMAP_THRESHOLD_", str(16 << 20)), ("MALLOC_TRIM_THRESHOLD_", str(32 << 20))):
        env.setdefault(key, value)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def whole_rows(docs: DataFrame) -> DataFrame:
    """One column ROW with all columns of docs, so that extra columns cannot clash with the operators' own."""
    _ready(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def numbered(docs: DataFrame) -> DataFrame:
    """whole_rows with RID, a number for each row that stays the same however a later job splits the input.

    Rows are told apart by their file and their place in it, so repeated or null ids are rows like any other. A file's number is
    its rank among the files' names, 2 ** 40 rows apart; the list of names (a row a file) is broadcast. What is not a file scan
    (joins, aggregates, rows of the driver) is stored first. The files must not change while an operator runs.
    """
    spark = docs.sparkSession
    if not _is_scan(docs._jdf.queryExecution().analyzed()):
        docs = stored(docs, "input")
    about = docs.metadataColumn("_metadata")
    place = docs.select(about.getField("file_path").alias("__file"), about.getField("row_index").alias("__index"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))
    _ready(spark)
    names = sorted(r[0] for r in place.select("__file").distinct().collect())  # a row a file
    # Never null, and Spark is told so: else a filter of some joins would keep their exchanges from being used again by others.
    if len(names) <= 1:
        return place.select(ROW, F.coalesce("__index", F.lit(-1)).cast("long").alias(RID))
    files = spark.createDataFrame(pa.table({"__n": range(len(names)), "__file": names}))  # Arrow tables get to executors without Python
    return place.join(F.broadcast(files), "__file").select(ROW, F.coalesce(F.shiftleft("__n", 40) + F.col("__index"), F.lit(-1)).cast("long").alias(RID))


_libc = ctypes.CDLL(None)
_slot: dict = {}


def worker_slot(key, make: Callable):
    """What a reused Python worker keeps from task to task: one object, made anew when another key is asked for."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
    return _slot[key]


def task_begins(keep) -> None:
    if keep not in _slot:
        _slot.clear()


def task_ends() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def arrow_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep=None):
    """run for mapInArrow, which frees what it no longer needs: workers live on and would hold it through later stages."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_begins(keep)
        try:
            yield from run(batches)
        finally:
            task_ends()

    return freed


class Held:
    """Columns of rows that a task gathers until there are enough of them to pass on."""

    def __init__(self, *kinds):
        self.kinds, self.rows, self.parts = kinds, 0, [[] for _ in kinds]

    def add(self, *columns: np.ndarray) -> bool:
        """Whether there are enough."""
        for part, column in zip(self.parts, columns):
            part.append(column)
        self.rows += len(columns[0])
        return self.rows >= FLUSH_ROWS

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(self.parts, self.kinds)]
        self.__init__(*self.kinds)
        return out


def row_text(batch: pa.RecordBatch, text: str) -> pa.Array:
    return pc.struct_field(batch.column(ROW), text)


class Lines:
    """The \\n-split lines of a piece's texts; every text has one line at least.

    start, end: byte spans; doc: text of each line; first: index of the first line of each text.
    """

    def __init__(self, piece: Piece, raw: np.ndarray):
        breaks = np.flatnonzero(raw == 10)
        owner = np.searchsorted(piece.at, breaks, "right") - 1
        self.n_lines = np.bincount(owner, minlength=len(piece)) + 1
        self.first = np.concatenate([[0], np.cumsum(self.n_lines)])
        n = int(self.first[-1])
        self.start, self.end = np.empty(n, np.int64), np.empty(n, np.int64)
        head = np.zeros(n, bool)
        head[self.first[:-1]] = True
        tail = np.zeros(n, bool)
        tail[self.first[1:] - 1] = True
        self.start[head], self.start[~head] = piece.at[:-1], breaks + 1
        self.end[tail], self.end[~tail] = piece.at[1:], breaks
        self.doc = np.repeat(np.arange(len(piece)), self.n_lines)
        lo, hi = np.searchsorted(piece.start, self.start), np.searchsorted(piece.start, self.end)
        self.full = hi > lo
        #: Span between the outermost words: the line without `[\x20\x09-\x0D]` at both ends.
        self.core_start, self.core_end = self.start.copy(), self.start.copy()
        self.core_start[self.full], self.core_end[self.full] = piece.start[lo[self.full]], piece.end[hi[self.full] - 1]


def code_points(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.int32 if len(buf) < 1 << 31 else np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
    return (total[ends] - total[starts]).astype(np.int64)


def per_text(mask_or_weights: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=mask_or_weights, minlength=n).astype(np.int64)


def per_span(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of mask are set between at[i] and at[i + 1]."""
    total = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[at]).astype(np.int64)


def equal_in_text(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with 64-bit hashes: an order in which equal rows of a text are neighbours, and whether each equals the one before it there."""
    both = keys ^ mix(doc.astype(np.uint64))
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(doc), bool)
    if len(doc) > 1:
        same[1:] = (both[order][1:] == both[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return order, same


def long_lists(counts: np.ndarray, values: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))
