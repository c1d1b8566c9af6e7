"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one figure of a text and votes good, bad or nothing. Over all documents only the counts of the vote
patterns are needed (at most 3 ** len(RULES), whatever the number of documents), so the model is fitted exactly on the whole
corpus by one aggregate: a two-class model in which each rule has its own vote probabilities per class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkit import ROW, SPACED, Piece, arrow_task, equal_in_text, per_span, per_text, pieces, row_text, stored, whole_rows, window_hash

BAD, ABSTAIN, GOOD = 0, 1, 2
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:] = True

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words", "n_bare_words")


def _rules() -> dict[str, tuple[Column, Column]]:
    """For each rule when it votes bad and when good; it abstains otherwise.

    Bad texts mostly fail one rule and pass the rest, so a passed rule says little: all but two rules only vote bad.
    """
    words, none = F.greatest(F.col("n_words"), F.lit(1)), F.lit(False)
    mean, symbols, bare = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_bare_words") / words
    lines, again = F.col("n_dup_lines") / F.col("n_lines"), F.col("n_repeat_words") / words
    upper, letters = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)), F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    # Distinct words grow slower than words, so they are held against the square root.
    variety = F.col("n_distinct_words") / F.sqrt(words)
    prose = (symbols < 0.05) & (letters > 0.75) & (upper < 0.3) & (bare < 0.15) & (again <= 0.3) & (variety > 1.8)
    return {
        "length": (F.col("n_words") < 20, F.col("n_words") >= 60),
        "word_length": ((mean < 2.5) | (mean > 14), none),
        "symbols": (symbols > 0.25, none),
        "repeated_lines": (lines > 0.4, none),
        "repeated_words": (again > 0.3, none),
        "capitals": (upper > 0.5, none),
        "letters": (letters < 0.75, none),
        "variety": (variety < 1.5, none),
        "bare_words": (bare > 0.2, none),
        "prose": (none, prose),
    }


RULES = ("length", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "letters", "variety", "bare_words", "prose")


_WHITE = b" \t\n\x0b\x0c\r"


def _repeated_lines(piece: Piece) -> np.ndarray:
    """For each text how many lines with a word equal an earlier one: bytes against bytes, no hash."""
    raw, out = piece.buf.tobytes(), []
    for a, b in zip(piece.at[:-1].tolist(), piece.at[1:].tolist()):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(_WHITE)]
        out.append(len(lines) - len(set(lines)))
    return np.array(out, np.int64)


def _features(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text") if "text" in batch.schema.names else row_text(batch, text), SPACED):
                n, buf, doc, at = len(piece), piece.buf, piece.doc, piece.at
                words, letters = piece.words(), np.zeros(len(buf) + 1, np.int32)
                np.cumsum(_LETTER[buf], out=letters[1:])
                bare = letters[piece.end] == letters[piece.start]
                by_word, again = equal_in_text(doc, words)
                begin = np.flatnonzero(np.arange(len(words)) + 8 <= piece.last())
                order, same = equal_in_text(doc[begin], window_hash(words, 8)[begin])
                same[:-1] |= same[1:].copy()
                edge = np.zeros(len(words) + 1, np.int32)
                edge[begin[order[same]]] += 1
                edge[begin[order[same]] + 8] -= 1
                figures = [
                    piece.n_words, per_span(piece.inside & ((buf & 0xC0) != 0x80), at), per_span(_SYMBOLS[buf], at), _repeated_lines(piece), per_text(np.cumsum(edge[:-1]) > 0, doc, n),
                    per_span(buf == 10, at) + 1, per_span(_UPPER[buf], at), np.diff(letters[at]), per_text(~again, doc[by_word], n), per_text(bare, doc, n),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(piece.rows.start, n), *(pa.array(x.astype(np.int64)) for x in figures)], names=[ROW, *FEATURES])

    return arrow_task(run)


def text_figures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or its columns in keep, as column ROW with one column for each of FEATURES."""
    if keep is None:
        rows, kind = whole_rows(docs), docs.schema.simpleString()
    else:
        kept = docs.select(*(F.col(f"`{c}`") for c in keep))
        kind = kept.schema.simpleString()
        rows = whole_rows(docs).select(F.struct(*(F.col(ROW).getField(c).alias(c) for c in keep)).alias(ROW), F.col(ROW).getField(text).alias("text"))
    return rows.mapInArrow(_features(text), f"{ROW} {kind}, " + ", ".join(f"{x} long" for x in FEATURES))


def vote_code() -> Column:
    """The votes of all rules as digits to base 3."""
    votes = [F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN) for bad, good in (_rules()[r] for r in RULES)]
    return sum((v * 3**k for k, v in enumerate(votes)), F.lit(0)).cast("int")


def fit_votes(codes: np.ndarray, counts: np.ndarray, rules: int = len(RULES), rounds: int = 100) -> np.ndarray:
    """Posterior probability of the good class for each vote pattern, by expectation-maximisation over pattern counts.

    It begins with votes that mostly point the right way, rules speaking up for a third of the bad texts. A prior of a few votes keeps probabilities off 0 and 1, and
    a rule never ends with a good vote that speaks for the bad class or the other way round.
    """
    votes = (codes[:, None] // 3 ** np.arange(rules)) % 3
    if not len(codes):
        return np.zeros(0)
    # start[class, vote]
    table = np.tile(np.array([[0.35, 0.55, 0.1], [0.02, 0.48, 0.5]]), (rules, 1, 1))
    prior = 0.9
    for _ in range(rounds):
        logs = np.log(table)[np.arange(rules), :, votes].sum(1) + np.log([1 - prior, prior])
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        weight = np.stack([counts * (1 - good), counts * good])
        new = np.empty_like(table)
        for v in range(3):
            new[:, :, v] = ((votes == v).T @ weight.T) + (1, 1, 1)[v]
        new /= new.sum(2, keepdims=True)
        # The vote must not point the wrong way.
        for v, right in ((GOOD, 1), (BAD, 0)):
            wrong = new[:, right, v] < new[:, 1 - right, v]
            new[wrong, :, v] = new[wrong, :, v].mean(1, keepdims=True)
        table = new / new.sum(2, keepdims=True)
        prior = float(np.clip((weight[1].sum() + 9) / (counts.sum() + 10), 0.05, 0.99))
    return good


def score_quality(docs: DataFrame, text: str = "text", keep_at: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or its columns in keep, as column ROW (a struct) with FEATURES, base_failed, posterior and kept.

    base_failed: fewer than 20 words, or more than 30 % of the words in 8-word windows that occur twice. kept: not base_failed, and
    the posterior probability of good quality is at least keep_at. One pass reads the whole texts of all documents and stores their
    figures with ROW; the counts of vote patterns and the verdicts come from that table, which is narrow where keep leaves the text out.

    Null and empty texts have one empty line, no words and fail the base rules. Repeated rows are judged alike and count each
    time. An empty table gives an empty table. Other columns, null ids and clashing names only travel inside ROW.
    """
    figures = stored(text_figures(docs, text, keep), "figures")
    rows = figures.groupBy(vote_code().alias("code")).count().collect()  # at most 3 ** len(RULES) rows
    codes, counts = np.array([r["code"] for r in rows], int), np.array([r["count"] for r in rows], float)
    posterior = dict(zip(codes.tolist(), fit_votes(codes, counts).tolist()))
    table = docs.sparkSession.createDataFrame(pa.table({"code": pa.array(posterior.keys(), pa.int32()), "posterior": pa.array([round(v, 6) for v in posterior.values()], pa.float64())}))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = figures.withColumn("code", vote_code()).join(F.broadcast(table), "code", "left").withColumn("base_failed", base)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at)).select(ROW, *FEATURES, "base_failed", "posterior", "kept")
