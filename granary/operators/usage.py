"""Usage analytics: totals, days, dimensions, gaps, timelines, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..sources.shared import stored
from . import ranges


def totals(acts: DataFrame) -> DataFrame:
    """Counts by kind, sessions, and discrete percentiles of the values of searches (views)."""
    is_ = lambda a: F.col("action") == a
    counts = acts.agg(
        F.count("*").alias("events"),
        F.count_if(is_("view")).alias("views"),
        F.count_if(is_("error")).alias("errors"),
        F.countDistinct("session_id").alias("sessions"),
        F.round(F.sum(F.when(is_("purchase"), F.col("value"))), 4).alias("purchase_value"),
    )
    views = ranges.percentiles(acts.where(is_("view")).select(F.lit(0).alias("_all"), "value"), ["_all"], "value", {"view_p50": 0.5, "view_p95": 0.95})
    return counts.withColumn("_all", F.lit(0)).join(views, "_all", "left").drop("_all")


def daily(acts: DataFrame) -> DataFrame:
    """Tumbling days: events, errors, sessions."""
    return acts.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("events"), F.count_if(F.col("action") == "error").alias("errors"), F.countDistinct("session_id").alias("sessions"))


def by_dimension(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """``value`` with one count column a part; a full outer merge with zeros."""
    rows = None
    for name, part in parts.items():
        row = part.select(F.col(column).alias("value"), F.lit(name).alias("part"))
        rows = row if rows is None else rows.unionByName(row)
    return rows.groupBy("value").agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])


def sessions_without(acts: DataFrame, having: str, lacking: str) -> DataFrame:
    """Sessions that have one action and lack another, with the first's count."""
    have = acts.where(F.col("action") == having).groupBy("session_id").agg(F.count("*").alias("n"))
    lack = acts.where((F.col("action") == lacking)).select("session_id").distinct()
    return have.join(lack, "session_id", "left_anti")


def documents_without_later(acts: DataFrame, first: str, later: str) -> DataFrame:
    """First actions on a document that no later action of the same session on it follows."""
    a = acts.where((F.col("action") == first) & F.col("session_id").isNotNull()).alias("a")
    b = acts.where(F.col("action") == later).select("session_id", "doc_id", F.col("at").alias("later_at")).alias("b")
    follows = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("later_at") > F.col("a.at"))
    return a.join(b, follows, "left_anti")


def bucket(date: Column, granularity: str) -> Column:
    """Label of a date's bucket: YYYY, YYYY-Qn or YYYY-MM, from the truncated anchor."""
    anchor = F.date_trunc(granularity, date)
    return {
        "year": F.date_format(anchor, "yyyy"),
        "quarter": F.concat(F.date_format(anchor, "yyyy"), F.lit("-Q"), F.quarter(anchor).cast("string")),
        "month": F.date_format(anchor, "yyyy-MM"),
    }[granularity]


def timeline(docs: DataFrame, date: str, granularity: str) -> DataFrame:
    """``bucket, n`` documents."""
    return docs.where(F.col(date).isNotNull()).groupBy(bucket(F.col(date), granularity).alias("bucket")).agg(F.countDistinct("doc_id").alias("n"))


def auto_granularity(docs: DataFrame, date: str, least: int = 3) -> str:
    """The coarsest of year, quarter and month with ``least`` buckets, else month."""
    n = docs.agg(*[F.countDistinct(bucket(F.col(date), g)).alias(g) for g in ("year", "quarter", "month")]).first()
    return next((g for g in ("year", "quarter", "month") if n[g] >= least), "month")


def engagement(acts: DataFrame, as_of: Column, window_days: int = 30, half_life: float = 30.0) -> DataFrame:
    """``doc_id, opens, useful, irrelevant, multiplier``: decayed reads of a trailing window and all ratings."""
    age = scores.age_days(as_of, F.col("at"))
    opens = F.sum(F.when((F.col("action") == "view") & (age <= window_days), scores.decay(age, half_life)).otherwise(0.0))
    count = lambda a: F.sum(F.when(F.col("action") == a, 1.0).otherwise(0.0))
    out = acts.groupBy("doc_id").agg(opens.alias("opens"), count("purchase").alias("useful"), count("error").alias("irrelevant"))
    return out.withColumn("multiplier", scores.engagement_multiplier(F.col("opens"), F.col("useful"), F.col("irrelevant")))


def trailing(acts: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days up to ``as_of``."""
    return acts.where((F.unix_micros("at") > F.unix_micros(as_of) - days * 86_400_000_000) & (F.col("at") <= as_of))


def sessionised(acts: DataFrame, gap_minutes: int) -> DataFrame:
    """``session_id, start, end, n``: runs of a session's events with no longer gap."""
    order = Window.partitionBy("session_id").orderBy("at", "event_id")
    fresh = F.coalesce(F.unix_micros("at") - F.unix_micros(F.lag("at").over(order)) > gap_minutes * 60_000_000, F.lit(True))
    runs = acts.withColumn("_run", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("session_id", "_run").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n")).drop("_run")


def with_seed(seed: DataFrame, hits: DataFrame) -> DataFrame:
    """``search, doc_id, seeded``: the hits of saved searches, those that a seed run had found before marked."""
    known = seed.select("search", "doc_id", F.lit(True).alias("_s")).distinct()
    return hits.join(known, ["search", "doc_id"], "left").select("search", "doc_id", F.coalesce("_s", F.lit(False)).alias("seeded"))


def notified(ledger: DataFrame, listed: DataFrame) -> DataFrame:
    """The ledger (search, doc_id, notified) with exactly the listed keys marked."""
    marks = listed.select("search", "doc_id", F.lit(True).alias("_m")).distinct()
    return ledger.join(marks, ["search", "doc_id"], "left").select("search", "doc_id", (F.col("notified") | F.coalesce("_m", F.lit(False))).alias("notified"))


def gap_fusion(signals: DataFrame) -> DataFrame:
    """``target, score``: each signal's scores over its maximum, ranked and fused by reciprocal ranks, over the fused maximum.

    ``signals`` has signal, target and score.  Maxima are aggregates joined back, and ranks come from a range partitioning with the counts of
    the partitions before, so that a signal of many targets is no single group.
    """
    most = signals.groupBy("signal").agg(F.max("score").alias("_most"))
    scaled = signals.join(F.broadcast(most), "signal").select("signal", "target", (F.col("score") / F.col("_most")).alias("scaled"))  # a row a signal
    ranked = ranges.numbered(scaled, ["signal"], [F.desc("scaled"), F.col("target")]).withColumn("rank", F.col("k") - 1)
    fused = stored(ranked.groupBy("target").agg(F.sum(scores.rrf(F.col("rank"))).alias("score")), "fused")
    top = fused.agg(F.max("score")).first()[0]
    return fused.select("target", (F.col("score") / F.lit(top)).alias("score"))
