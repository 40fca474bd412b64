"""Quality classifier from weak labels.

Heuristics vote good (1), bad (0) or nothing (-1) on every text: each fault of ``FAULTS`` votes only bad, ``prose`` only good, and the two
word heuristics both ways.  Their votes overlap.  Expectation-maximisation over the counts of vote patterns
(at most 3 ** 10 rows) estimates each heuristic's behaviour on good and on bad texts and gives each pattern a posterior.  The
posteriors of about ``fit_rows`` texts, picked by a hash of the id, train a linear scorer over hashed word-shape features; the scorer judges
every text, so that texts on which no heuristic votes are judged too.

Null and empty texts get only the vote of the emptiness heuristic and the scorer's bias; an empty table gives no rows; repeated rows give
repeated results; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _SEPARATOR, Hasher, find_words, mix, stash, text_chunks

#: Share at or above which a fault votes bad, and at or below which a text passes as prose.
FAULTS = {
    "symbols": (0.30, 0.05),  # words that end in two or more symbols
    "shouting": (0.30, 0.05),  # words of two or more capitals and no small letters
    "pipes": (0.15, 0.02),  # words that are a bar
    "echo": (0.20, 0.05),  # words equal to the one before
    "repeats": (0.50, 0.20),  # runs of five words that came before in the text
    "lines": (0.50, 0.20),  # lines that came before in the text
}
#: Share at or below which the word heuristics vote bad, and at or above which good.
WORDS = {
    "function": (0.05, 0.12),  # short small-letter words
    "plain": (0.50, 0.85),  # letters, then at most one stop
}
VOTERS = (*FAULTS, *WORDS, "prose", "words")
FIT_ROWS = 8_000
FEATURES = 1 << 13
MIN_WORDS = 20  # a heuristic needs so many words to vote on shares
_SYMBOL = np.array([chr(b) in "#$%&*@^~+=<>|\\_!?" for b in range(256)])
_STOP = np.array([chr(b) in ".,;:!?" for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_SMALL = np.array([97 <= b < 123 or b >= 128 for b in range(256)])
_LATER = np.array([128 <= b < 192 for b in range(256)])  # later bytes of a character
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_LINE_END = np.array([b == 10 for b in range(256)])


class Votes(NamedTuple):
    """Class prior and vote probabilities by class: good, and [labeller, class, vote + 1]."""

    good: float
    table: np.ndarray


def _shares(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the share of each heuristic and the word count; and for each word its shape feature, and where each text's words begin."""
    n = len(offsets) - 1
    starts, ends, at = find_words(data, offsets)
    words = np.diff(at)
    if not len(starts):
        return np.zeros((n, len(FAULTS) + len(WORDS))), words, np.zeros(0, np.int64), at
    digest = Hasher(data)
    hashes = digest(starts, ends)
    running = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
    inside = lambda total: total[ends] - total[starts]
    upper, small, digits, symbols = (inside(running(m)) for m in (_UPPER, _SMALL, _DIGIT, _SYMBOL))
    length = ends - starts
    letters = length - inside(running(_LATER))
    last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
    tail = _SYMBOL[last] & _SYMBOL[before] & (length >= 2)
    shout = (upper >= 2) & (small == 0)
    bar = (length == 1) & (data[starts] == 124)
    echo = np.zeros(len(starts), bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    echo[at[:-1][words > 0]] = False
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    shares = np.zeros((n, len(FAULTS) + len(WORDS)))
    many = np.maximum(words, 1)
    stopped = _STOP[last] & (length >= 2)
    function = (small == length) & (letters <= 3)
    plain = (small + upper == length - stopped) & ~shout
    for k, x in ((0, tail), (1, shout), (2, bar), (3, echo), (6, function), (7, plain)):
        shares[:, k] = per(x) / many
    line_starts, line_ends, line_at = find_words(data, offsets, _LINE_END)
    lines = digest(line_starts, line_ends)
    grams = np.zeros(len(hashes), np.uint64)
    for k in range(min(5, len(hashes))):
        grams[: len(hashes) - k] += hashes[k:] * np.uint64(2 * k + 3)
    for k in range(n):
        if words[k] >= MIN_WORDS:
            own = grams[at[k] : at[k + 1] - 4]
            shares[k, 4] = 1 - len(np.unique(own)) / len(own)
            own = lines[line_at[k] : line_at[k + 1]]
            shares[k, 5] = 1 - len(np.unique(own)) / len(own) if len(own) >= 4 else 0.0
    case = np.where(small + upper == 0, 0, np.where(upper == 0, 1, np.where(small == 0, 2, np.where((upper == 1) & _UPPER[data[starts]], 3, 4))))
    shape = ((case * 2 + (digits > 0)) * 4 + np.minimum(symbols, 3)) * 4 + np.where(_STOP[last], 1, np.where(_SYMBOL[last], 2, np.where(_DIGIT[last], 3, 0)))
    shape = (shape * 8 + np.minimum(length // 3, 7)) * 2 + echo
    return shares, words, shape, at


def _features(shape: np.ndarray, at: np.ndarray, shares: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of one text: shapes and pairs of shapes by their share, and the deciles of its repetition shares."""
    own = shape[at[k] : at[k + 1]]
    pairs = own[:-1] * 4096 + own[1:] + (1 << 40)
    levels = np.array([(1 << 50) + 16 * j + int(10 * shares[k, j]) for j in (4, 5)])
    parts = [own, pairs, levels]
    weights = [np.full(len(own), 1.0 / max(len(own), 1)), np.full(len(pairs), 1.0 / max(len(pairs), 1)), np.full(len(levels), 0.5)]
    bucket = (mix(np.concatenate(parts).astype(np.uint64)) >> np.uint64(40)).astype(np.int64) & (FEATURES - 1)
    summed = np.bincount(bucket, np.concatenate(weights), FEATURES)
    full = np.flatnonzero(summed)
    return full, np.sqrt(summed[full])


def vote(shares: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Votes of all of ``VOTERS``; a text without words gets only a bad vote for that."""
    votes = np.full((len(words), len(VOTERS)), -1, np.int64)
    enough, prose = words >= MIN_WORDS, words > 0
    for j, (bad, fine) in enumerate(FAULTS.values()):
        votes[enough & (shares[:, j] >= bad), j] = 0
        prose = prose & (shares[:, j] <= fine)
    for j, (bad, good) in enumerate(WORDS.values(), len(FAULTS)):
        votes[enough & (shares[:, j] <= bad), j] = 0
        votes[enough & (shares[:, j] >= good), j] = 1
    votes[prose, -2] = 1
    votes[words == 0, -1] = 0
    return votes


def _judged(texts: DataFrame, weights=None, keep: bool = False) -> DataFrame:
    """``id, votes, margin, features, values`` of each text: votes as one base-3 number; the features of rows with ``wanted`` if ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None if weights is None else weights.value
        for batch in batches:
            wanted = batch.column(2).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in text_chunks(batch.column(1)):
                shares, words, shape, at = _shares(data, offsets)
                votes = vote(shares, words)
                code = ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(axis=1)
                margin, kept = np.zeros(len(words)), []
                for k in range(len(words)):
                    if w is not None:
                        full, value = _features(shape, at, shares, k)
                        margin[k] = w[full] @ value + w[-1]
                    kept.append(_features(shape, at, shares, k) if keep and wanted[first + k] else ((), ()))
                kinds = pa.list_(pa.int32()), pa.list_(pa.float32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(code), pa.array(margin), pa.array([x for x, _ in kept], kinds[0]), pa.array([x for _, x in kept], kinds[1])], ["id", "votes", "margin", "features", "values"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, votes long, margin double, features array<int>, values array<float>")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[Votes, np.ndarray]:
    """Expectation-maximisation from the counts of vote patterns: the label model, and each pattern's probability of good.

    It starts from whether any fault was voted, and pseudo-counts keep each heuristic better than chance.
    """
    bad, good = (patterns == 0).sum(axis=1), (patterns == 1).sum(axis=1)
    p = np.where(bad > 0, 0.1, np.where(good > 0, 0.95, 0.7))
    share, table = 0.9, np.zeros((patterns.shape[1], 2, 3))
    extra = 0.01 * max(counts.sum(), 1000)
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - p), counts * p)):
            for v in range(3):
                prior = (0.7, 0.295, 0.005)[0 if v == 0 else 1 if v - 1 == c else 2]
                table[:, c, v] = (weight[:, None] * (patterns == v - 1)).sum(axis=0) + extra * prior
        table /= table.sum(axis=2, keepdims=True)
        share = float(((counts * p).sum() + 9) / (counts.sum() + 10))
        log = [np.log(1 - share), np.log(share)]
        for c in range(2):
            for j in range(patterns.shape[1]):
                log[c] = log[c] + np.log(table[j, c, patterns[:, j] + 1])
        log = [np.where(bad + good > 0, x, np.log(q)) for x, q in zip(log, (1 - share, share))]  # no vote, no evidence
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        moved, p = float(np.abs(now - p).max(initial=0)), now
        if moved < 1e-7:
            break
    return Votes(share, table), p


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer on soft labels (the last is the bias), by full-batch gradient steps with momentum scaling."""
    w, square = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    at = np.concatenate([np.full(len(f), k) for k, (f, _) in enumerate(rows)]) if rows else np.zeros(0, np.int64)
    feature = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    n = max(len(rows), 1)
    for k in range(rounds):
        margin = np.bincount(at, w[feature] * value, n)[: len(rows)] + w[-1]
        error = target - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        grad = np.concatenate([np.bincount(feature, error[at] * value, FEATURES) if len(at) else np.zeros(FEATURES), [error.sum()]]) / n - decay * w
        square = 0.95 * square + 0.05 * grad * grad
        w += 0.1 / (1 + k / 100) * grad / np.sqrt(square + 1e-12)
    return w


def _fitted(texts: DataFrame, id_col: str, text_col: str, fit_rows: int) -> tuple[DataFrame, np.ndarray, dict[int, float]]:
    """The source frame ``id, text, wanted``, the scorer's weights and the posterior of each vote pattern."""
    total = texts.count()
    picked = F.coalesce(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / max(total, 1))), F.lit(False))
    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), picked.alias("wanted"))
    voted = stash(_judged(source, keep=True), "votes")
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).toPandas()  # at most 3 ** 10 rows
    codes = counted.votes.to_numpy(np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(VOTERS)) % 3 - 1
    _, posterior = estimate(patterns, counted.n.to_numpy(float))
    of = dict(zip(codes.tolist(), posterior.tolist()))
    sample = voted.where(F.size("features") > 0).select("votes", "features", "values").toArrow()  # about fit_rows
    rows = [(np.array(f, np.int64), np.array(v)) for f, v in zip(sample.column(1).to_pylist(), sample.column(2).to_pylist())]
    return source, train(rows, np.array([of[v] for v in sample.column(0).to_pylist()])), of


def score_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id, weak_label, score``: the label model's probability of good, and the linear scorer's."""
    source, weights, of = _fitted(texts, id_col, text_col, fit_rows)
    judged = _judged(source, texts.sparkSession.sparkContext.broadcast(weights))
    table = F.create_map(*[F.lit(x) for pair in sorted(of.items()) for x in pair])[F.col("votes")] if of else F.lit(None)
    return judged.select(F.col("id").alias(id_col), table.cast("double").alias("weak_label"), (1 / (1 + F.exp(-F.col("margin")))).alias("score"))


def keep_good(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score reaches ``threshold``."""
    _, weights, _ = _fitted(texts, id_col, text_col, fit_rows)
    shipped, at = texts.sparkSession.sparkContext.broadcast(weights), texts.columns.index(text_col)
    least = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(at)):
                shares, words, shape, place = _shares(data, offsets)
                good = []
                for k in range(len(words)):
                    full, value = _features(shape, place, shares, k)
                    good.append(float(w[full] @ value + w[-1]) >= least)
                yield batch.slice(first, end - first).filter(pa.array(good))

    return texts.mapInArrow(run, texts.schema)
