"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are scored by the log-odds of their units (the word and its first 4 and 6 bytes) between toxic and clean labelled texts, under a
Dirichlet prior whose weights are the units' counts in all texts.  A linear-time scan finds all maximal scoring segments of each text.
Segments of clean labelled texts calibrate an extreme-value law (E = K n exp(-lambda S)): a segment is a significant passage if so good a one
is expected less than ``MAX_E`` times in a clean text of that length.  The law's sum statistic over a text's best segments is its evidence,
and a logistic curve through labelled texts' evidence makes it a probability.

The label fit uses at most about ``fit_rows`` labelled rows, picked by a hash of their id; a quarter of them calibrates the law and the
curve and gives no token counts.  Near copies among them share one vote: a row weighs one over the size of its family, which two minima of
hashed word runs tell.  The prior's counts cover all texts.  Units live in
``BUCKETS`` hash buckets, which bounds the model.  Null and empty texts have no evidence and get the curve's lowest value; with no labels of
one class every text gets the base rate.  Repeated rows give repeated results; empty tables none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NOT_ALNUM, SHINGLE, Hasher, find_words, mix, stash, text_chunks, window_hashes, word_hashes

BUCKETS = 1 << 18
FIT_ROWS = 60_000
PREFIXES = (4, 6)
PRIOR_WEIGHT = 500.0
MIN_Z = 4.0  # of the signed root of the likelihood ratio
DRIFT = 0.1
MOST = 8.0
MAX_E = 0.01
EVIDENCE_STEP = 0.25
CALIBRATION_SHARE = 4  # one row in so many


class Segment(NamedTuple):
    first: int
    end: int
    score: float


class Model(NamedTuple):
    """Token scores by bucket, the extreme-value law, and the logistic curve over evidence."""

    scores: np.ndarray
    rate: float
    scale: float
    slope: float
    shift: float


def maximal_segments(scores: np.ndarray) -> list[Segment]:
    """All maximal scoring segments (disjoint, each beating its own parts), in linear time.

    Only positive scores start work: the scores between them enter as differences of one running sum.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # first, end, sums before and after
    for k in np.flatnonzero(scores > 0).tolist():
        first, end, before, after = k, k + 1, float(total[k]), float(total[k + 1])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= after:
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1
        stack.append((first, end, before, after))
    return [Segment(a, b, r - q) for a, b, q, r in stack]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each token's units (a row a unit), and where each text's tokens begin."""
    starts, ends, at = find_words(data, offsets, NOT_ALNUM)
    if not len(starts):
        return np.zeros((1 + len(PREFIXES), 0), np.int64), at
    digest = Hasher(data)
    rows = [digest(starts, ends)] + [digest(starts, np.minimum(ends, starts + p)) + np.uint64(p) for p in PREFIXES]
    return np.stack([(r >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1) for r in rows]), at


def _labels(labels: DataFrame, id_col: str, label_col: str, fit_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of the rows to fit on: all, or about ``fit_rows`` of them by a hash of the id."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    got = rows.select("id", "label").toArrow()  # bounded by fit_rows
    ids, label = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(ids)
    return ids[order], label[order]


def _class_of(ids: np.ndarray, wanted: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Label of each id, -1 for those not in the fit."""
    if not len(wanted):
        return np.full(len(ids), -1)
    k = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
    return np.where(wanted[k] == ids, label[k], -1)


def _weights(texts: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """One over the size of the family of near copies of each wanted row; a family shares the smallest of its hashed word runs under one of two mixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                words, at = word_hashes(data, offsets)
                keys = np.zeros((2, end - first), np.int64)
                for k in range(end - first):
                    row = words[at[k] : at[k + 1]]
                    runs = window_hashes(row, min(SHINGLE, max(len(row), 1)))
                    if len(runs):
                        keys[:, k] = runs.min().view(np.int64), mix(runs).min().view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(keys[0]), pa.array(keys[1])], ["id", "a", "b"])

    picked = texts.sparkSession.createDataFrame(pa.table({"id": pa.array(wanted, pa.int64())}))
    rows = texts.join(F.broadcast(picked), "id", "left_semi").select("id", "text").mapInArrow(run, "id long, a long, b long").dropDuplicates(["id"]).toArrow()  # bounded by fit_rows
    weights = np.ones(len(wanted))
    if rows.num_rows:
        sizes = [n[k] for c in "ab" for _, k, n in [np.unique(rows.column(c).to_numpy(), return_inverse=True, return_counts=True)]]
        weights[np.searchsorted(wanted, rows.column("id").to_numpy())] = 1 / np.maximum(*sizes)
    return weights


def _counts(texts: DataFrame, shipped) -> DataFrame:
    """``bucket, seen, toxic, clean``: tokens over all texts, and the weight of labelled texts of each class that hold the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, label, weight = shipped.value
        seen, by = np.zeros(BUCKETS, np.int64), np.zeros((2, BUCKETS))
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(-(2**62)).to_numpy(zero_copy_only=False)
            kind = _class_of(ids, wanted, label)
            share = _class_of(ids, wanted, weight)
            for first, end, data, offsets in text_chunks(batch.column(1)):
                units, at = _units(data, offsets)
                seen += np.bincount(units.ravel(), minlength=BUCKETS)
                for k in np.flatnonzero(kind[first:end] >= 0).tolist():
                    by[int(kind[first + k] > 0), np.unique(units[:, at[k] : at[k + 1]])] += share[first + k]
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(seen[full]), pa.array(by[1][full]), pa.array(by[0][full])], ["bucket", "seen", "toxic", "clean"])

    return texts.mapInArrow(run, "bucket long, seen long, toxic double, clean double").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("seen", "toxic", "clean")])


def log_odds(seen: np.ndarray, toxic: np.ndarray, clean: np.ndarray, toxic_texts: float, clean_texts: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio of each unit under the informative Dirichlet prior, and the signed root of the likelihood ratio of its texts' counts."""
    prior = np.where(seen > 0, 0.5, 0.0) + PRIOR_WEIGHT * seen / max(seen.sum(), 1)
    a, b = toxic + prior + 1e-9, clean + prior + 1e-9
    delta = np.log(a / max(a.sum(), 1)) - np.log(b / max(b.sum(), 1))
    share, all_texts = toxic + clean, max(toxic_texts + clean_texts, 1e-9)
    ratio = np.zeros(len(seen))
    for held, texts in ((toxic, toxic_texts), (clean, clean_texts)):
        for observed, of in ((held, share), (texts - held, all_texts - share)):
            expected = of * texts / all_texts
            ratio += 2 * np.where(observed > 1e-9, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0.0)
    return delta, np.sign(delta) * np.sqrt(np.maximum(ratio, 0))


def _segments(texts: DataFrame, shipped) -> DataFrame:
    """``id, n, segments`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, strength = shipped.value
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                units, at = _units(data, offsets)
                pick = np.argmax(strength[units], axis=0) if units.shape[1] else np.zeros(0, np.int64)
                token = scores[np.take_along_axis(units, pick[None, :], 0)[0]] if units.shape[1] else np.zeros(0)
                hot = np.concatenate([[0], np.cumsum(token > 0)])
                found = [[s._asdict() for s in maximal_segments(token[at[k] : at[k + 1]])] if hot[at[k + 1]] > hot[at[k]] else [] for k in range(end - first)]
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(at)), pa.array(found, kind)], ["id", "n", "segments"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, n long, segments array<struct<first:long,end:long,score:double>>")


def _logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through weighted counts, with one pseudo-count a class at the ends; by Newton's method."""
    x = np.concatenate([x, [0.0, max(float(x.max(initial=0)), 1.0)]])
    positive, negative = np.concatenate([positive, [0.0, 1.0]]), np.concatenate([negative, [1.0, 0.0]])
    w = np.zeros(2)
    basis = np.stack([x, np.ones_like(x)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ basis, -30, 30)))
        n = positive + negative
        grad = basis @ (positive - n * p) - 1e-3 * w
        hess = (basis * (n * p * (1 - p))) @ basis.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _evidence(rate: float, scale: float) -> Column:
    """A text's evidence in nats: minus the logarithm of the least sum statistic E_r = (K n)^r exp(-lambda (S_1 + ... + S_r)) / r! of its best r segments, 0 at least."""
    load = F.log(F.lit(scale) * F.greatest("n", F.lit(1)))
    start = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("best"), F.lit(0).alias("r"))

    def step(state: Column, s: Column) -> Column:
        now = state["now"] + F.lit(rate) * s - load + F.log(state["r"] + F.lit(1))
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"), (state["r"] + F.lit(1)).alias("r"))

    return F.least(F.aggregate(F.reverse(F.array_sort("segments.score")), start, step)["best"], F.lit(100.0))


def fit(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[Model, DataFrame]:
    """The model, and the segments of every text under it."""
    spark = texts.sparkSession
    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted, label = _labels(labels, id_col, label_col, fit_rows)
    held = ((wanted * 0x9E3779B1 >> 7) & 0xFFFF) % CALIBRATION_SHARE == 0
    weight = _weights(source, wanted)
    counted = _counts(source, spark.sparkContext.broadcast((wanted[~held], label[~held], weight[~held]))).toArrow()  # at most BUCKETS rows
    full = np.zeros((3, BUCKETS))
    for k, c in enumerate(("seen", "toxic", "clean")):
        full[k, counted.column("bucket").to_numpy()] = counted.column(c).to_numpy()
    delta, z = log_odds(*full, *(weight[~held & (label > 0 if toxic else label <= 0)].sum() for toxic in (True, False)))
    scores = np.where(np.abs(z) >= MIN_Z, np.clip(delta, -1.0, MOST), 0.0) - DRIFT
    found = stash(_segments(source, spark.sparkContext.broadcast((scores, np.where(np.abs(z) >= MIN_Z, np.abs(delta), 0.0)))), "segments")
    picked = spark.createDataFrame(pa.table({"id": pa.array(wanted[held], pa.int64()), "label": pa.array(label[held], pa.int32()), "weight": pa.array(weight[held])}))
    labelled = found.join(picked, "id")
    clean = labelled.where("label = 0").select(F.col("n"), F.explode_outer("segments.score").alias("s"))
    sums = clean.agg(F.count("s").alias("m"), F.sum("s").alias("s"), F.count("*").alias("rows")).first()
    tokens = labelled.where("label = 0").agg(F.sum("n")).first()[0] or 0
    # tail of segments in clean texts: an exponential with one further segment of unit score, and their rate a token
    rate = min(2.0, max(0.1, (sums.m + 1) / ((sums.s or 0.0) + 1.0)))
    scale = (sums.m + 1) / (tokens + 1)
    bins = labelled.groupBy(F.round(_evidence(rate, scale) / EVIDENCE_STEP).alias("x")).agg(F.sum(F.when(F.col("label") > 0, F.col("weight")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") > 0, 0).otherwise(F.col("weight"))).alias("q")).toPandas()  # at most 401 rows
    slope, shift = _logistic(bins.x.to_numpy(float) * EVIDENCE_STEP, bins.p.to_numpy(float), bins.q.to_numpy(float))
    return Model(scores, rate, scale, max(slope, 0.0), shift), found


def score_texts(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id, score, n_tokens, passages``: the probability of the label and the significant passages (token range, score, E-value)."""
    model, found = fit(texts, labels, id_col, text_col, label_col, fit_rows)
    e_value = lambda s: F.lit(model.scale) * F.greatest("n", F.lit(1)) * F.exp(-model.rate * s["score"])
    passages = F.filter(F.transform("segments", lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end"), s["score"].alias("score"), e_value(s).alias("e_value"))), lambda s: s["e_value"] <= MAX_E)
    score = 1 / (1 + F.exp(-(model.slope * _evidence(model.rate, model.scale) + model.shift)))
    return found.select(F.col("id").alias(id_col), score.alias("score"), F.col("n").alias("n_tokens"), passages.alias("passages"))
