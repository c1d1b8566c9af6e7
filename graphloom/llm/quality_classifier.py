"""A quality classifier with supervised subword embeddings, trained by numpy stochastic gradient descent.

A text's features are its words and their character n-grams (bytes, 3 to 5 with word ends), hashed into BUCKETS, and one for a word that
follows itself. Each bucket has a learned vector; a text's vector is the average over its features, and a softmax layer gives
the class. As the average is linear, scoring needs only each bucket's contribution to the difference of the two outputs,
one number, so tasks get an array of BUCKETS floats. Scores are calibrated on training texts that were held back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkit import BASES, ROW, SPACED, Piece, arrow_task, mix, pieces, row_text, whole_rows

BUCKETS = 1 << 17
SAME_WORD = 0  # bucket of a word that follows itself
SIZES = (3, 4, 5)
_EDGE = np.uint64(257)


def _features(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a piece's texts and the text of each."""
    if not len(piece.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, doc = piece.words(), piece.doc
    out, owners = [words], [doc]
    # Words with one edge mark before and one after, side by side.
    size = piece.end - piece.start
    block = size + 2
    first = np.cumsum(block) - block
    marked = np.full(int(block.sum()), _EDGE, np.uint64)
    inner = np.ones(len(marked), bool)
    inner[first] = inner[first + block - 1] = False
    marked[inner] = piece.buf[piece.inside]
    owner = np.repeat(doc, block)
    left = np.repeat(first + block, block) - np.arange(len(marked))  # bytes up to the word's end
    gram = np.zeros(len(marked), np.uint64)
    for n in range(1, max(SIZES) + 1):
        step = marked[n - 1 :]
        gram = gram[: len(step)] * np.uint64(BASES[0]) + step + np.uint64(n)
        if n in SIZES:
            ok = left[: len(step)] >= n
            out.append(gram[ok] + np.uint64(n << 40))
            owners.append(owner[: len(step)][ok])
    buckets = (mix(np.concatenate(out)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    again = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1])) + 1
    return np.concatenate([buckets, np.full(len(again), SAME_WORD)]), np.concatenate([*owners, doc[again]])


class Classifier:
    """weight: contribution of each bucket; slope and offset: calibration."""

    def __init__(self, weight: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.weight, self.slope, self.offset = weight, slope, offset

    def raw(self, piece: Piece) -> np.ndarray:
        bucket, doc = _features(piece)
        n = len(piece)
        return np.bincount(doc, weights=self.weight[bucket], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)

    def score(self, piece: Piece) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(piece) + self.offset, -30, 30)))


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    bucket, _ = _features(next(pieces(pa.array([text]), SPACED, most=len(text) * 4 + 8)))
    ids, n = np.unique(bucket, return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def fit(texts: list[str], labels: list[int], dim: int = 12, epochs: int = 8, rate: float = 0.5, seed: int = 5) -> Classifier:
    """Plain SGD, one text at a time; one text in five only calibrates."""
    if len(set(labels)) < 2:
        return Classifier(np.zeros(BUCKETS, np.float32), 0.0, 3.0 if 1 in labels or not labels else -3.0)
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output = np.zeros((2, dim), np.float32)
    output[0, 0], output[1, 0] = -0.1, 0.1
    bags, y = [_bag(t or "") for t in texts], np.array(labels)
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    balance = np.where(y == 1, 0.5 / max(1e-9, y[train].mean()), 0.5 / max(1e-9, 1 - y[train].mean()))
    steps, total = 0, epochs * len(train)
    for _ in range(epochs):
        for i in r.permutation(train):
            step = np.float32(rate * (1 - steps / total) * balance[i])
            steps += 1
            ids, w = bags[i]
            if not len(ids):
                continue
            hidden = w @ vectors[ids]
            z = output @ hidden
            p = np.exp(z - z.max())
            gap = p / p.sum()
            gap[y[i]] -= 1
            back = gap @ output
            output -= step * np.outer(gap, hidden)
            # The gradient of a bucket is its share of the text; the factor keeps it from vanishing in long texts.
            vectors[ids] -= (step * np.sqrt(len(ids)) * w)[:, None] * back
    model = Classifier((vectors @ (output[1] - output[0])).astype(np.float32))
    use = np.flatnonzero(held) if held.any() else train
    x = np.array([float(w @ model.weight[ids]) if len(ids) else 0.0 for ids, w in (bags[i] for i in use)])
    model.slope, model.offset = _calibration(x, y[use])
    return model


def _calibration(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method, with a little pull to a slope that is not steep."""
    spread = max(float(x.std()), 1e-6)
    z, a, b = x / spread, 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, g = np.maximum(p * (1 - p), 1e-6), p - target
        hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(hess, np.array([(g * z).sum() + 0.1 * a, g.sum() + 0.1 * b]))
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
    return max(a, 0.0) / spread, b


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", most: int = 3000) -> Classifier:
    """A classifier from at most `most` labelled documents, those with the smallest hashes of their ids; whole texts.

    A repeated id counts once, with its largest label and its smallest text. Null ids and labels are left out.
    """
    pairs = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("__y"))
    chosen = pairs.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(most)
    texts = docs.select(F.col(id_col), F.col(text).alias("__t")).join(F.broadcast(chosen), id_col)  # `most` rows
    rows = texts.groupBy(id_col, "__y").agg(F.min("__t").alias("__t")).collect()
    rows.sort(key=lambda r: (r[id_col], r["__t"] or ""))
    return fit([r["__t"] or "" for r in rows], [int(r["__y"]) for r in rows])


def _scores(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for piece in pieces(row_text(batch, text), SPACED, most=1 << 18):
                yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(piece.rows.start, len(piece)), pa.array(m.score(piece))], names=[ROW, "score"])

    return arrow_task(run)


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs as column ROW with score (0 to 1, higher: quality 1 likelier).

    Null and empty texts have no features and get the score of the calibration's offset. Repeated rows get equal scores. An empty table
    gives an empty table. Other columns, null ids and clashing names only travel inside ROW. The model that is broadcast has
    BUCKETS floats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return whole_rows(docs).mapInArrow(_scores(shared, text), f"{ROW} {docs.schema.simpleString()}, score double")
