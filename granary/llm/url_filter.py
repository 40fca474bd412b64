"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models, of accepted and of rejected URLs, give each character a probability from contexts of up to ``ORDER``
characters.  Witten-Bell smoothing blends them from short to long: a context of count c with d different successors weighs its own estimate by
c / (c + d) and the shorter context's by d / (c + d).  A URL's score is the difference of its log-likelihoods, rejected minus accepted,
divided by its length, and a logistic curve through the scores of held-out training URLs makes it the probability of rejection.

Training URLs come from the whole table.  Where a rule fits it says the class; a URL without a rule is rejected if its host has a word of
``seeds``, which name the usual categories of block lists, and accepted otherwise (with only allowed URLs as accepted ones, every host whose
pages a rule blocks in part would lose the rest).  A table without rejected URLs has no second model, and then only rules block.  Three in four
training URLs make the models, the fourth calibrates the curve.

The counts are a table of all runs of ``ORDER`` + 1 characters in the URLs, exact and as large as the URLs make it.  If it has at most
``most_grams`` rows the runs' log-ratios are broadcast to the URLs, otherwise the distinct URLs' runs are joined with it; both give the same
scores.

The models read the host's labels without the top two and the path with digits as one sign, so that they don't learn page numbers.  Null URLs
and URLs without ``://`` have an empty host and path, fit no rule, and get the curve's value for no evidence.  Repeated rows count as often
as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_text import host_and_path
from .shared import stash, text_chunks

ORDER = 4
ALPHABET = 256
#: Words of the adult, gambling, pharmacy, spam and advertising categories of block lists.
SEEDS = ("adult", "porn", "xxx", "casino", "bet", "bets", "betting", "poker", "lottery", "pills", "viagra", "pharma", "spam", "ad", "ads", "adserver", "clickbait")
SCORE_STEP = 0.02
MOST_GRAMS = 1 << 20  # of a broadcast table: 16 MB


class Rule(NamedTuple):
    text: str
    allow: bool


class Curve(NamedTuple):
    slope: float
    shift: float


#: Characters as the models see them: letters without case, digits as one sign, never 0, which stands before a URL's begin.
_FOLD = np.array([b + 32 if 65 <= b < 91 else 48 if 48 <= b < 58 else max(b, 1) for b in range(256)], np.int64)


def rule_verdict(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits a URL, and whether it allows; null without one.

    A rule ``host/path`` fits its host and all subdomains if the URL's path starts with the rule's.  Equal lengths: the earlier rule.
    """
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        name, _, rest = rule.text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        text, allow = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.allow)).otherwise(allow)
    return text, allow


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each character of a chunk of URLs, it and the ``ORDER`` characters before it in its URL as one number, a byte each."""
    symbol = _FOLD[data]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = symbol.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(symbol), np.int64)
        before[k:] = symbol[:-k]
        out |= np.where(place >= k, before, 0) << 8 * k
    return out


def _counted(urls: DataFrame) -> DataFrame:
    """``gram, accepted, rejected`` over a frame ``model_text, kind``: every run of the texts, counted in texts of kind 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, data, offsets in text_chunks(batch.column(0)):
                grams, where = np.unique(_grams(data, offsets), return_inverse=True)
                of = np.repeat(kind[first:end], np.diff(offsets))
                counts = [np.bincount(where[of == c], minlength=len(grams)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(grams), *map(pa.array, counts)], ["gram", "accepted", "rejected"])

    return urls.mapInArrow(run, "gram long, accepted long, rejected long").groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """``gram, value``: log-probability of each run's last character after the others in the rejected model, minus that in the accepted one."""
    masks = F.array(*[F.lit((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)])
    runs = counts.select("*", F.posexplode(masks).alias("order", "mask")).withColumn("run", F.col("gram").bitwiseAND(F.col("mask")))
    seen = runs.groupBy("order", "run").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).withColumn("context", F.shiftright("run", 8))
    seen = stash(seen, "runs")
    contexts = seen.groupBy("order", "context").agg(F.sum("a").alias("a_all"), F.count_if(F.col("a") > 0).alias("a_kinds"), F.sum("r").alias("r_all"), F.count_if(F.col("r") > 0).alias("r_kinds"))
    known = stash(seen.join(contexts, ["order", "context"]).drop("context"), "known")
    told = runs.select("gram", "order", "run").join(known, ["order", "run"]).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("order", "a", "a_all", "a_kinds", "r", "r_all", "r_kinds"))).alias("orders"))

    def step(p: Column, x: Column) -> Column:
        one = lambda c: F.when(x[f"{c}_all"] > 0, (x[c] + x[f"{c}_kinds"] * p[c]) / (x[f"{c}_all"] + x[f"{c}_kinds"])).otherwise(p[c]).alias(c)
        return F.struct(one("a"), one("r"))

    start = F.struct(F.lit(1.0 / ALPHABET).alias("a"), F.lit(1.0 / ALPHABET).alias("r"))
    p = F.aggregate("orders", start, step)
    return told.select("gram", (F.log(p["r"]) - F.log(p["a"])).alias("value"))


def _scores(texts: DataFrame, values: DataFrame, most_grams: int) -> DataFrame:
    """``model_text, score`` of the distinct texts of a frame: the mean value of their runs."""
    distinct = texts.select("model_text").distinct()
    if values.count() <= most_grams:
        table = values.orderBy("gram").toArrow()  # at most most_grams rows
        shipped = texts.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), table.column(1).to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, value = shipped.value
            for batch in batches:
                score = np.zeros(batch.num_rows)
                for first, end, data, offsets in text_chunks(batch.column(0)):
                    if len(data):
                        total = np.concatenate([[0.0], np.cumsum(value[np.searchsorted(grams, _grams(data, offsets))])])
                        score[first:end] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["model_text", "score"])

        return distinct.mapInArrow(run, "model_text string, score double")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(0), 1 << 18):
                row = np.repeat(np.arange(first, end), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(_grams(data, offsets))], ["model_text", "gram"])

    return distinct.mapInArrow(spread, "model_text string, gram long").join(values, "gram").groupBy("model_text").agg(F.avg("value").alias("score"))


def calibrated(x: np.ndarray, rejected: np.ndarray, accepted: np.ndarray) -> Curve:
    """A logistic curve through weighted score bins, each class with the same total weight, so that 0.5 is where both are as likely."""
    r, a = rejected / max(rejected.sum(), 1), accepted / max(accepted.sum(), 1)
    w = np.array([1.0, 0.0])
    basis = np.stack([x, np.ones_like(x)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ basis, -30, 30)))
        grad = basis @ (r * (1 - p) - a * p) - 1e-3 * w
        hess = (basis * ((r + a) * p * (1 - p))) @ basis.T + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -5, 5)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Curve(max(float(w[0]), 0.0), float(w[1]))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", seeds: tuple[str, ...] = SEEDS, reject_at: float = 0.9, most_grams: int = MOST_GRAMS) -> DataFrame:
    """One row a URL: id, host, path, rule, verdict, score and the models' probability of rejection; at ``reject_at`` or more it blocks."""
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = source.select("id", "url", host.alias("host"), path.alias("path"))
    rule, allow = rule_verdict(F.col("host"), F.col("path"), rules)
    labels = F.regexp_replace("host", r"(^|\.)[^.]*\.[^.]*$", "")
    text = F.concat(F.coalesce(labels, F.lit("")), F.lit("/"), F.col("path"))
    rows = rows.select("id", F.pmod(F.xxhash64("url"), F.lit(4)).alias("fold"), "host", "path", rule.alias("rule"), allow.alias("allow"), text.alias("model_text"))
    seeded = F.regexp_replace("host", r"[^a-z]+", " ").rlike("(^| )(" + "|".join(seeds) + ")( |$)") if seeds else F.lit(False)
    rows = rows.withColumn("rejected", F.when(F.col("host") != "", F.coalesce(~F.col("allow"), seeded)))
    kind = F.when(F.col("fold") == 0, -1).otherwise(F.coalesce(F.col("rejected").cast("int"), F.lit(-1)))
    values = stash(log_ratios(_counted(rows.select("model_text", kind.alias("kind")))), "ratios")
    scores = stash(_scores(rows, values, most_grams), "scores")
    scored = rows.join(scores, "model_text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    held = scored.where((F.col("fold") == 0) & F.col("rejected").isNotNull())
    bins = held.groupBy(F.round(F.col("score") / SCORE_STEP).alias("x")).agg(F.count_if("rejected").alias("r"), F.count_if(~F.col("rejected")).alias("a")).toPandas()  # scores are bounded
    curve = calibrated(bins.x.to_numpy(float) * SCORE_STEP, bins.r.to_numpy(float), bins.a.to_numpy(float)) if len(bins) and bins.r.sum() and bins.a.sum() else Curve(0.0, -10.0)
    chance = 1 / (1 + F.exp(-(curve.slope * F.col("score") + curve.shift)))
    verdict = F.when(F.coalesce("allow", chance < reject_at), F.lit("allow")).otherwise("block")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", chance.alias("rejection"))
