"""Rules that link documents: threads, participants, days; their precedence; backlinks and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored

SPLIT = 16


def participant_keys(rows: DataFrame) -> DataFrame:
    """``doc_id, key`` of each document's lower-case participants."""
    return rows.select("doc_id", F.explode(F.array_distinct(F.transform("participants", F.lower))).alias("key")).where("key <> ''")


def split_join(touched: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Equality join of touched rows (``x``) with all rows (``y``), of which each key is dealt to ``SPLIT`` parts.

    A key that a third of all rows share is no single task; the few touched rows meet every part.
    """
    a = touched.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    b = rows.withColumn("_part", F.pmod(F.xxhash64("y"), F.lit(SPLIT)).cast("int"))
    return a.join(b, [*keys, "_part"]).drop("_part")


def _pairs(touched: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``src, dst, key`` of touched documents and others that share a key, the smaller id first, each pair once."""
    a, b = touched.select(F.col("doc_id").alias("x"), key), rows.select(F.col("doc_id").alias("y"), key)
    return split_join(a, b, [key]).where("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), key).distinct()


def shared_thread(touched: DataFrame, rows: DataFrame) -> DataFrame:
    """``src, dst, evidence`` of documents of one thread."""
    named = lambda d: d.where("thread_id IS NOT NULL AND trim(thread_id) <> ''").select("doc_id", "thread_id")
    return _pairs(named(touched), named(rows), "thread_id").select("src", "dst", F.col("thread_id").alias("evidence"))


#: Documents of a chunk, documents of a key that need no parts, and parts of a key at most.
CHUNK, PART_DOCS = 256, 4096


def _chunks(sets: DataFrame, *more: str) -> DataFrame:
    """``keys, asked, docs, first`` and ``more`` columns' arrays beside ``docs``: documents of equal sets in chunks of about ``CHUNK``; ``first`` tells chunks apart."""
    sized = sets.groupBy("keys", "asked").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_n")).where("_n > 1")
    dealt = sets.join(F.broadcast(sized), ["keys", "asked"], "left").withColumn("_chunk", F.pmod(F.xxhash64("doc_id"), F.coalesce("_n", F.lit(1))))
    held = dealt.groupBy("keys", "asked", "_chunk").agg(F.collect_list(F.struct("doc_id", *more)).alias("_docs"))
    return held.select("keys", "asked", F.array_min("_docs.doc_id").alias("first"), F.col("_docs.doc_id").alias("docs"), *[F.col("_docs")[c].alias(c) for c in more])


def _bits(keys: str) -> Column:
    """A bit of 64 for each key: sets without a common bit have no common key."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(k), F.lit(64)).cast("int"))))


def _shared(touched: DataFrame | None, rows: DataFrame, *more: str) -> DataFrame:
    """``src, dst, evidence, shared`` and both sides' ``more`` columns (``x_``, ``y_``) of touched documents (all, if None) and others with a common key.

    Documents of equal sets go in chunks, so that their common keys are found once a pair of chunks, at the smallest one, and no pair of documents is
    exchanged.  The chunks of a frequent key are dealt to parts on both sides, and each two parts meet in a task.
    """
    sets = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("keys"), *[F.first(c).alias(c) for c in more])
    if touched is None:
        sets = sets.withColumn("asked", F.lit(True))
    else:
        sets = sets.join(touched.select("doc_id", F.lit(True).alias("asked")).distinct(), "doc_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    sets = stored(sets, "participants")
    often = sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.least(F.lit(SPLIT), F.ceil(F.count("*") / PART_DOCS)).cast("int").alias("_n")).where("_n > 1")
    tasks = 16 * rows.sparkSession.sparkContext.defaultParallelism

    def side(chunks: DataFrame, x: str, own: str, other: str) -> DataFrame:
        each = chunks.select(F.posexplode("keys").alias("_at", "key"), *chunks.columns)
        each = each.select("key", F.slice("keys", F.lit(1), F.col("_at")).alias(f"{x}_before"), F.slice("keys", F.col("_at") + 2, F.size("keys")).alias(f"{x}_after"), *[F.col(c).alias(f"{x}_{c}") for c in chunks.columns if c != "keys"])
        each = each.select("*", *[_bits(f"{x}_{c}").alias(f"{x}_{c}_bits") for c in ("before", "after")])
        parts = each.join(F.broadcast(often), "key", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
        parts = parts.withColumn(own, F.pmod(F.xxhash64(f"{x}_first"), F.col("_n")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        return parts.drop("_n").repartition(tasks, "key", "_i", "_j")

    a, b = side(_chunks(sets.where("asked"), *more), "x", "_i", "_j"), side(_chunks(sets, *more), "y", "_j", "_i")
    # a pair is made at its smallest common key; two chunks of touched documents meet from the smaller one, and a chunk meets itself
    apart = lambda c: F.col(f"x_{c}_bits").bitwiseAND(F.col(f"y_{c}_bits")) == 0
    once = ~F.col("y_asked") | (F.col("x_first") <= F.col("y_first"))
    met = a.join(b, ["key", "_i", "_j"]).where(once & (apart("before") | ~F.arrays_overlap("x_before", "y_before")))
    shared = F.when(apart("after"), F.lit(1)).otherwise(F.size(F.array_intersect("x_after", "y_after")) + 1).cast("long")
    met = met.select(F.col("key").alias("evidence"), shared.alias("shared"), (F.col("x_first") == F.col("y_first")).alias("_own"), *[f"{x}_{c}" for x in "xy" for c in ("docs", *more)])
    for x in "xy":
        kept = [c for c in met.columns if c not in (f"{x}_docs", *(f"{x}_{m}" for m in more))]
        met = met.select(*kept, *(f"{x}_{m}" for m in more), F.posexplode(f"{x}_docs").alias("_at", x)).select(*kept, x, *[F.col(f"{x}_{m}")[F.col("_at")].alias(f"{x}_{m}") for m in more])
    pairs = met.where(~F.col("_own") | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "evidence", "shared", *[f"{x}_{c}" for x in "xy" for c in more])


def shared_participant(touched: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``src, dst, evidence, shared`` of documents with a common participant: the smallest common key and their number."""
    return _shared(touched, rows)


def ruled_participant(touched: DataFrame | None, rows: DataFrame, dates: DataFrame, days: int = 1) -> DataFrame:
    """``rule, src, dst, evidence`` of pairs with a common participant, of the stronger rule alone: by day where dates (``doc_id, day``, one each) are near, else by participant."""
    near = F.coalesce(F.abs(F.date_diff("x_day", "y_day")) <= days, F.lit(False))
    return _shared(touched, rows.join(dates, "doc_id", "left"), "day").select(F.when(near, "same_day").otherwise("participant").alias("rule"), "src", "dst", "evidence")


def same_day_participant(touched: DataFrame, rows: DataFrame, dates: DataFrame, days: int = 1) -> DataFrame:
    """``src, dst, evidence`` of pairs with a common participant whose dates (``doc_id, day``) are at most ``days`` apart."""
    dated = lambda d: d.join(dates, "doc_id")
    a = dated(touched).select(F.col("doc_id").alias("x"), "key", F.col("day").alias("dx"), F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("at"))
    b = dated(rows).select(F.col("doc_id").alias("y"), "key", F.col("day").alias("at"))
    near = split_join(a, b, ["key", "at"]).where("x <> y")
    return near.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "key").groupBy("src", "dst").agg(F.min("key").alias("evidence"))


def with_precedence(strong: DataFrame, weak: DataFrame) -> DataFrame:
    """Weak pairs that no strong rule has found."""
    return weak.join(strong.select("src", "dst"), ["src", "dst"], "left_anti")


def backlinks(links: DataFrame, derived: DataFrame, budget: int) -> DataFrame:
    """``target, source, kind``: written links first, then derived ones in either direction, ``budget`` in all for each target."""
    both = derived.select(F.col("dst").alias("target"), F.col("src").alias("source")).union(derived.select("src", "dst"))
    rows = links.select(F.col("dst").alias("target"), F.col("src").alias("source"), F.lit("written").alias("kind"), F.lit(0).alias("_k")).union(both.select("target", "source", F.lit("derived"), F.lit(1)))
    rows = rows.groupBy("target", "source").agg(F.min("_k").alias("_k"))
    order = Window.partitionBy("target").orderBy("_k", "source")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= budget).select("target", "source", F.when(F.col("_k") == 0, "written").otherwise("derived").alias("kind"))


def graph_rows(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``what, id, other, degree``: the nodes with their degrees, and the edges between known nodes."""
    known = nodes.select(F.col("id").alias("_id"))
    inner = links.join(known, F.col("src") == F.col("_id"), "left_semi").join(known, F.col("dst") == F.col("_id"), "left_semi").select("src", "dst").distinct()
    degree = inner.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    out = nodes.select("id").join(degree, "id", "left").select(F.lit("node").alias("what"), "id", F.lit(None).cast("long").alias("other"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.union(inner.select(F.lit("edge"), "src", "dst", F.lit(None).cast("long")))


def suggestions(graph_scores: DataFrame, vector_scores: DataFrame, linked: DataFrame, least: float = 0.6, most: int = 5) -> DataFrame:
    """``src, dst, score``: the mean of both affinities, a missing one as zero, without linked pairs, the best ``most`` of each source."""
    joined = graph_scores.select("src", "dst", F.col("affinity").alias("_g")).join(vector_scores.select("src", "dst", F.col("affinity").alias("_v")), ["src", "dst"], "full_outer")
    scored = joined.select("src", "dst", F.round((F.coalesce("_g", F.lit(0.0)) + F.coalesce("_v", F.lit(0.0))) / 2, 7).alias("score")).where(F.col("score") >= least)
    fresh = scored.join(linked.select("src", "dst"), ["src", "dst"], "left_anti")
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return fresh.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
