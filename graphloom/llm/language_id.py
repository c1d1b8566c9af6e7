"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order ORDER over the letters of its words (lower-cased, with word ends). Probabilities are stored
ready interpolated: per order one sorted array of n-gram hashes with a column of log probabilities per language, and one of
context hashes with the weights that lead to the lower order. A text's language is that of the lowest cross-entropy per
letter. A task scores each distinct word of a piece of a batch once, and keeps the scores of some.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkit import PIECE_BYTES, ROW, arrow_task, flat, mix, ragged, row_text, whole_rows, word_hash

ORDER = 4
_END, _START, _UNKNOWN = 1, 2, 3
_MOST_LETTERS = 65_000
_MOST_WORDS = 1 << 17  # whose scores a task keeps


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For code points: whether it is a letter, and its lower case (where that is one code point)."""
    chars = [chr(i) for i in range(0x32400)]  # no letters come later, and the last of these is none
    low = [c.lower() for c in chars]
    return np.array([c.isalpha() for c in chars]), np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)


def _words(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of some texts, begin and end of each word (run of letters), and the text of each word."""
    raw = np.frombuffer(data, np.uint8)
    code = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    total = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edge = total[at]
    letter, lower = _letters()
    small = np.minimum(code, len(letter) - 1)
    inside = letter[small]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = edge[1:] > edge[:-1]
    before[edge[:-1][full]] = False
    after[edge[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return lower[small], start, end, np.searchsorted(edge, start, "right") - 1


def _grams(letter: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each letter (16-bit numbers) and end of the words the n-grams of order 1 to ORDER that it ends, and the word of each."""
    size = end - start
    block = size + ORDER  # starts, letters, end
    first = np.cumsum(block) - block
    padded = np.full(int(block.sum()), _START, np.uint64)
    padded[ragged(size, first + ORDER - 1)] = letter[ragged(size, start)]
    padded[first + block - 1] = _END
    at = ragged(size + 1, first + ORDER - 1)
    out, gram = [], np.zeros(len(at), np.uint64)
    for n in range(ORDER):
        gram = gram | (padded[at - n] << np.uint64(16 * n))
        out.append(gram)
    return out, np.repeat(np.arange(len(size)), size + 1)


class Model:
    """langs; for each order sorted hashes of n-grams with log probabilities, and of contexts with log weights, per language."""

    def __init__(self, texts: list[str], langs: list[str]):
        with_letters = {x for t, x in zip(texts, langs) if any(c.isalpha() for c in t)}
        self.langs = sorted(with_letters)
        split = []
        for lang in self.langs:
            data = [t.encode() for t, x in zip(texts, langs) if x == lang]
            split.append(_words(b"".join(data), np.concatenate([[0], np.cumsum([len(d) for d in data])]))[:3])
        #: Code points that the texts have, the most frequent if there are too many; all others are one unknown letter.
        seen, often = np.unique(np.concatenate([c[ragged(b - a, a)] for c, a, b in split]), return_counts=True) if split else (np.zeros(0, np.uint32), np.zeros(0))
        self.alphabet = np.sort(seen[np.argsort(-often, kind="stable")][:_MOST_LETTERS])
        self.number = np.full(len(_letters()[0]), _UNKNOWN, np.uint16)
        self.number[self.alphabet] = np.arange(len(self.alphabet)) + _UNKNOWN + 1
        # Per language: n-grams of the highest order, and their counts.
        counts = [np.unique(_grams(self._numbers(code), start, end)[0][-1], return_counts=True) for code, start, end in split]
        self.grams, self.logs, self.contexts, self.weights = [], [], [], []
        self.known = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))
        self.scale, self.limit = 1.0, np.full(len(self.langs), np.inf)
        if not self.langs:
            return
        tables = [self._orders(*c) for c in counts]
        alphabet = max(2, len({int(g) for t in tables for g in t[0][0]}))
        self.floor = np.log(np.array([t[0][2] / alphabet for t in tables]))
        # From order 1 up: probabilities of all n-grams that any language has, in every language.
        before: tuple[np.ndarray, np.ndarray] | None = None
        for n in range(ORDER):
            keys = np.unique(np.concatenate([t[n][0] for t in tables]))
            probability = np.empty((len(keys), len(tables)))
            if n:
                mask = np.uint64((1 << (16 * n)) - 1)
                low = before[1][np.searchsorted(before[0], keys & mask)]
                contexts = np.unique(keys >> np.uint64(16))
                weights = np.ones((len(contexts), len(tables)))
            for i, t in enumerate(tables):
                grams, count, spare, contexts_i, total_i, weight_i, discount = t[n]
                place = np.searchsorted(keys, grams)
                if not n:
                    probability[:, i] = spare / alphabet
                    probability[place, i] += np.maximum(count - discount, 0) / max(total_i, 1)
                    continue
                weights[np.searchsorted(contexts, contexts_i), i] = weight_i
                probability[:, i] = weights[np.searchsorted(contexts, keys >> np.uint64(16)), i] * low[:, i]
                own = np.searchsorted(contexts_i, grams >> np.uint64(16))
                probability[place, i] += np.maximum(count - discount, 0) / total_i[own]
            before = (keys, probability)
            self._store(self.grams, self.logs, keys, np.log(np.maximum(probability, 1e-12)))
            if n:
                self._store(self.contexts, self.weights, contexts, np.log(np.maximum(weights, 1e-12)))

    def _numbers(self, code: np.ndarray) -> np.ndarray:
        """Letters as numbers below 2 ** 16."""
        return self.number[code].astype(np.uint64)

    @staticmethod
    def _store(keys: list, values: list, key: np.ndarray, value: np.ndarray) -> None:
        hashed = mix(key)
        order = np.argsort(hashed)
        keys.append(hashed[order])
        values.append(value[order].astype(np.float32))

    @staticmethod
    def _orders(grams: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """For each order: n-grams, counts (of the highest order; below it of distinct letters before), spare mass of order 1,
        contexts, their totals and weights, discount."""
        out = []
        for n in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = float(ones / (ones + 2 * twos)) if ones else 0.5
            if n == 1:
                total = counts.sum()
                out.append((grams, counts, discount * len(grams) / max(total, 1), None, total, None, discount))
            else:
                contexts, where = np.unique(grams >> np.uint64(16), return_inverse=True)
                total, kinds = np.bincount(where, weights=counts), np.bincount(where)
                out.append((grams, counts, 0.0, contexts, total, discount * kinds / total, discount))
                grams, counts = np.unique(grams & np.uint64((1 << (16 * (n - 1))) - 1), return_counts=True)
        return out[::-1]

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashed = mix(keys)
        at = np.minimum(np.searchsorted(sorted_keys, hashed), len(sorted_keys) - 1)
        return at, sorted_keys[at] == hashed

    def _words(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        grams, word = _grams(self._numbers(code), start, end)
        at, hit = self._find(self.grams[0], grams[0])
        logs = np.where(hit[:, None], self.logs[0][at], self.floor.astype(np.float32))
        for n in range(1, ORDER):
            at, hit = self._find(self.grams[n], grams[n])
            where, known = self._find(self.contexts[n - 1], grams[n] >> np.uint64(16))
            logs += np.where(known[:, None], self.weights[n - 1][where], np.float32(0))
            logs[hit] = self.logs[n][at[hit]]
        edges = np.concatenate([[0], np.cumsum(end - start + 1)[:-1]])
        return np.add.reduceat(logs, edges, axis=0, dtype=np.float64) if len(edges) and len(logs) else np.zeros((0, len(self.langs)))

    def _known_words(self, hashed: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """_words of different words with these hashes, in their order; a task's frequent words are scored once."""
        known, rows = self.known
        at = np.searchsorted(known, hashed)
        hit = np.append(known, np.uint64(0))[at] == hashed if len(known) else np.zeros(len(hashed), bool)
        hit &= at < len(known)
        out = np.empty((len(hashed), len(self.langs)))
        out[hit] = rows[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            out[new] = self._words(code, start[new], end[new])
            if len(known) + len(new) > _MOST_WORDS:
                self.known = hashed[new][:_MOST_WORDS], out[new][:_MOST_WORDS]
            else:
                self.known = np.insert(known, at[new], hashed[new]), np.insert(rows, at[new], out[new], axis=0)
        return out

    def entropies(self, data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of each text in each language, and the number of letters."""
        code, start, end, doc = _words(data, at)
        n, size = len(at) - 1, np.zeros(len(at) - 1)
        out = np.zeros((n, len(self.langs)))
        if not len(start):
            return out, size
        raw = np.frombuffer(data, np.uint8)
        lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the byte that each code point begins with
        hashed = word_hash(raw, lead[start], lead[end])
        _, index, which = np.unique(hashed, return_index=True, return_inverse=True)
        words = self._known_words(hashed[index], code, start[index], end[index])
        size = np.bincount(doc, weights=end - start + 1, minlength=n)
        for i in range(len(self.langs)):
            out[:, i] = -np.bincount(doc, weights=words[which, i], minlength=n) / np.maximum(size, 1)
        return out, size

    def predict(self, data: bytes, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (or und), score in [0, 1] and whether it is rejected, for each text."""
        n = len(at) - 1
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        entropy, size = self.entropies(data, at)
        best = entropy.argmin(1)
        low = entropy[np.arange(len(best)), best]
        # Longer texts are surer; the scale comes from texts that the counts have not seen.
        gap = (entropy - low[:, None]) * self.scale * np.sqrt(np.maximum(size, 1))[:, None]
        score = 1 / np.exp(-np.minimum(gap, 700)).sum(1)
        none = size == 0
        return [self.langs[b] if not x else "und" for b, x in zip(best, none)], np.where(none, 0.0, score), none | (low > self.limit[best])

    def calibrate(self, texts: list[str], langs: list[str], accept: float = 0.99) -> None:
        """On unseen texts: the scale that makes scores agree with how often they are right, and for each language the entropy above
        which a text is rejected (a tenth above what `accept` of its own texts stay below)."""
        if not texts:
            return
        data = [t.encode() for t in texts]
        entropy, size = self.entropies(b"".join(data), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
        truth, best = np.array([self.langs.index(x) for x in langs]), entropy.argmin(1)
        low = entropy[np.arange(len(best)), best]
        gap = (entropy - low[:, None]) * np.sqrt(np.maximum(size, 1))[:, None]
        loss = {}
        for scale in (0.03, 0.1, 0.3, 1.0, 3.0, 10.0):
            p = np.exp(-np.minimum(gap * scale, 700))
            loss[scale] = -np.log(np.maximum(p[np.arange(len(truth)), truth] / p.sum(1), 1e-9)).mean()
        self.scale = min(loss, key=lambda s: (round(loss[s], 6), s))
        for i in range(len(self.langs)):
            own = low[(truth == i) & (best == i)]
            if len(own) >= 10:
                self.limit[i] = 1.1 * np.quantile(own, accept)


def _sample(docs: DataFrame, text: str, lang: str, id_col: str, most: int) -> list:
    """At most `most` texts of each language, chosen by a hash of id and text; whole texts."""
    sizes = docs.groupBy(F.col(lang).alias("l")).count().collect()  # a row for each language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(lang) == r["l"], F.lit(min(1.0, 1.5 * most / r["count"]))).otherwise(share)
    rank = F.xxhash64(F.col(id_col).cast("string"), F.col(text))
    place = F.shiftrightunsigned(rank, 11) / F.lit(float(1 << 53))
    # 1.5 * most rows a language, more or less; the limit holds where one row is repeated very often.
    rows = docs.filter(place < share).select(F.col(text).alias("t"), F.col(lang).alias("l"), rank.alias("k")).limit(4 * most * max(1, len(sizes))).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["t"])):
        out.setdefault(r["l"], []).append((r["t"], r["l"]))
    return [x for v in out.values() for x in v[:most]]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", most: int = 300) -> Model:
    """A model of the languages in docs: four in five of the sampled texts are counted, the others calibrate."""
    rows = _sample(docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang, id_col, most)
    counted = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 25]
    model = Model(*map(list, zip(*counted))) if counted else Model([], [])
    held = [r for i, r in enumerate(rows) if i % 5 == 0 and r[1] in model.langs]
    model.calibrate([t for t, _ in held], [x for _, x in held])
    return model


def _predictions(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            buf, at = flat(row_text(batch, text))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 4 * PIECE_BYTES, "right")) - 1)
                lang, score, rejected = m.predict(buf[at[lo] : at[hi]].tobytes(), at[lo : hi + 1] - at[lo])
                yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[ROW, "lang_pred", "score", "rejected"])
                lo = hi

    return arrow_task(run)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs as column ROW with lang_pred, score (0 to 1) and rejected (no known language is likely).

    A text that is null or has no letter is `und` with score 0, and rejected. Repeated rows get equal results. An empty table gives
    an empty table; without learned languages every text is `und`. Other columns, null ids and clashing names only travel
    inside ROW. The model is broadcast; its size is bounded by the number of sampled texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return whole_rows(docs).mapInArrow(_predictions(shared, text), f"{ROW} {docs.schema.simpleString()}, lang_pred string, score double, rejected boolean")
