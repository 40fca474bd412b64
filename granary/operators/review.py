"""Review of a collection: stale and conflicting documents, gap queues, weekly themes, findings, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..sources.shared import stored
from . import ranges

#: Gap detectors by signal: functions from the tables of ``queue`` to ``target, score, evidence``.
DETECTORS: dict[str, Callable[..., DataFrame]] = {}


def detector(signal: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a detector; a second one for a signal is an error."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if signal in DETECTORS:
            raise ValueError(f"signal {signal} has a detector")
        DETECTORS[signal] = f
        return f

    return add


def superseded(old: DataFrame, newer: DataFrame, mentions: DataFrame, vectors: DataFrame, window_days: int, floor: float) -> DataFrame:
    """``doc_id, superseded_by, score``: each old document's most similar newer one that shares an entity and is at most ``window_days`` younger.

    ``old`` and ``newer`` have doc_id and at.  Entities join first, so that vectors are compared only between documents that share one.
    """
    held = mentions.select("doc_id", "entity_id").distinct()
    a = old.join(held, "doc_id").select("doc_id", F.col("at").alias("t0"), "entity_id")
    b = newer.join(held, "doc_id").select(F.col("doc_id").alias("other"), F.col("at").alias("t1"), "entity_id")
    pairs = a.join(b, "entity_id").where((F.col("t1") > F.col("t0")) & (F.unix_micros("t1") <= F.unix_micros("t0") + window_days * 86_400_000_000)).select("doc_id", "other").distinct()
    v, w = vectors.select(F.col("id").alias("doc_id"), F.col("vector").alias("_v")), vectors.select(F.col("id").alias("other"), F.col("vector").alias("_w"))
    scored = pairs.join(v, "doc_id").join(w, "other").select("doc_id", "other", F.round(scores.cosine(F.col("_v"), F.col("_w")), 6).alias("score")).where(F.col("score") >= floor)
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("other")).alias("n"))).alias("x"))
    return best.select("doc_id", (-F.col("x.n")).alias("superseded_by"), "x.score")


def conflict_pairs(mentions: DataFrame, vectors: DataFrame, least_docs: int, most_docs: int, floor: float, most_pairs: int) -> DataFrame:
    """``entity_id, a, b, score``: the most similar document pairs of each entity with enough documents, from its first ``most_docs`` ones.

    The bound on an entity's documents is the scan's own; it also bounds a group's pairs.
    """
    order = Window.partitionBy("entity_id").orderBy("doc_id")
    held = mentions.select("entity_id", "doc_id").distinct()
    enough = held.groupBy("entity_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_docs).select("entity_id")
    few = held.join(enough, "entity_id").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most_docs).select("entity_id", "doc_id")
    rows = few.join(vectors.select(F.col("id").alias("doc_id"), "vector"), "doc_id")
    a, b = (rows.select("entity_id", F.col("doc_id").alias(x), F.col("vector").alias(f"v{x}")) for x in "ab")
    scored = a.join(b, "entity_id").where("a < b").select("entity_id", "a", "b", F.round(scores.cosine(F.col("va"), F.col("vb")), 6).alias("score")).where(F.col("score") >= floor)
    best = Window.partitionBy("entity_id").orderBy(F.desc("score"), "a", "b")
    return scored.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= most_pairs).drop("_k")


def stale_funnel(docs: DataFrame, mentions: DataFrame, as_of: Column, age_days: int) -> DataFrame:
    """``aged, in_graph, summarised`` counts, each of those before, in one pass."""
    known = mentions.select("doc_id").distinct().withColumn("_known", F.lit(True))
    aged = scores.age_days(as_of, F.col("ingested_at")) >= age_days
    held = aged & F.coalesce("_known", F.lit(False))
    return docs.join(known, "doc_id", "left").agg(F.count_if(aged).alias("aged"), F.count_if(held).alias("in_graph"), F.count_if(held & F.col("summary").isNotNull()).alias("summarised"))


def community_weight(labels: DataFrame, contributions: DataFrame, docs: DataFrame | None, most: int) -> DataFrame:
    """``community, weight``: co-occurrence in a set of documents (all without one), each edge and document once for a community that holds either end.

    ``contributions`` has doc_id, src, dst, n, each edge of a document once.  Both ends bring the communities of their nodes, whose union the edge
    counts for, so that edges aren't made distinct again.
    """
    inside = contributions if docs is None else contributions.join(docs.select("doc_id"), "doc_id", "left_semi")
    held = labels.groupBy("node").agg(F.collect_set("community").alias("all"))
    for end in ("src", "dst"):
        inside = inside.join(held.select(F.col("node").alias(end), F.col("all").alias(f"_{end}")), end, "left")
    none = F.array().cast(held.schema["all"].dataType)
    both = F.array_union(F.coalesce("_src", none), F.coalesce("_dst", none))
    return inside.select(F.explode(both).alias("community"), "n").groupBy("community").agg(F.sum("n").alias("weight")).orderBy(F.desc("weight"), "community").limit(most)


def tag_themes(docs: DataFrame, most: int, most_docs: int) -> DataFrame:
    """``tag, doc_id``: documents by their first tag, the tags of most documents, the first documents of each."""
    rows = docs.where(F.size("tags") > 0).select(F.element_at("tags", 1).alias("tag"), "doc_id")
    best = rows.groupBy("tag").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "tag").limit(most).select("tag")
    order = Window.partitionBy("tag").orderBy("doc_id")
    return rows.join(F.broadcast(best), "tag").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most_docs).drop("_k")


def tallied(rows: DataFrame, column: str, most: int) -> DataFrame:
    """``key, n``: the most frequent elements of an array column, each row's once."""
    return rows.select(F.explode(F.array_distinct(column)).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(most)


def zero_filled(known: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``key, n``: counts of the known values, zero for those that don't occur."""
    return known.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def upserted_findings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``target, score, status`` after a scan: dismissed and snoozed findings stay as they are, open ones take the new score, resolved ones open again."""
    s, n = stored.alias("s"), fresh.alias("n")
    both = s.join(n, F.col("s.target") == F.col("n.target"), "full_outer")
    held = F.col("s.target").isNotNull() & (F.col("s.status").isin("dismissed", "snoozed") | F.col("n.target").isNull())
    return both.select(F.coalesce("s.target", "n.target").alias("target"), F.when(held, F.col("s.score")).otherwise(F.col("n.score")).alias("score"), F.when(held, F.col("s.status")).otherwise("open").alias("status"))


def gap_queue(findings: DataFrame, decided: DataFrame, as_of: Column, floor: float, least_evidence: int, most: int) -> DataFrame:
    """``target, score``: findings over a floor with enough evidence, without resolved, dismissed or still snoozed ones.

    ``decided`` has target, status and snoozed_until.
    """
    shut = decided.where(F.col("status").isin("resolved", "dismissed") | ((F.col("status") == "snoozed") & (F.col("snoozed_until") > as_of))).select("target")
    fine = findings.where((F.col("score") >= floor) & (F.size("evidence") >= least_evidence))
    return fine.join(shut, "target", "left_anti").select("target", "score").orderBy(F.desc("score"), "target").limit(most)


def refreshed_pairs(stored: DataFrame, touched: DataFrame, found: DataFrame) -> DataFrame:
    """``a, b, similarity, status`` after some documents changed: their open pairs that aren't found again go, labelled ones stay, new ones open."""
    hit = lambda d: d.join(touched.select(F.col("doc_id").alias("_a")), F.col("a") == F.col("_a"), "left").join(touched.select(F.col("doc_id").alias("_b")), F.col("b") == F.col("_b"), "left").withColumn("_hit", F.col("_a").isNotNull() | F.col("_b").isNotNull()).drop("_a", "_b")
    old = hit(stored)
    kept = old.where("status <> 'open' OR NOT _hit").select("a", "b", "similarity", "status")
    fresh = hit(found).where("_hit").select("a", "b", "similarity", F.lit("open").alias("status")).join(kept.select("a", "b"), ["a", "b"], "left_anti")
    return kept.unionByName(fresh)


def retired(pending: DataFrame, links: DataFrame) -> DataFrame:
    """Suggestions without those whose two documents are linked now, in either direction."""
    both = links.select("src", "dst").union(links.select("dst", "src")).distinct()
    return pending.join(both, ["src", "dst"], "left_anti")


def query_clusters(queries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``seed, query``: every query in order, each with the first seed whose words it shares to ``threshold``; without one it is a seed.

    ``queries`` has query (unique) and n, most frequent first.  Which queries are seeds depends on the order, so they are settled in rounds: a
    query is a seed once no earlier neighbour can be one, and no seed once an earlier neighbour is.  Neighbours come from a join on rare words: a
    pair of that similarity shares one of the n - ceil(threshold * n) + 1 rarest words of each.  Rounds go on as long as something is settled, and
    a chain of decisions is as long as the order makes it, not as the table.
    """
    ranked = ranges.numbered(queries.select("query", "n"), [], [F.desc("n"), F.col("query")], "place")
    words = stored(ranked.select("place", "query", F.array_distinct(F.split(F.trim(F.lower("query")), r"\s+")).alias("words")), "queries")
    held = words.select("place", F.size("words").alias("size"), F.explode("words").alias("word"))
    often = held.groupBy("word").agg(F.count("*").alias("holders"))
    rare = held.join(often, "word").groupBy("place", "size").agg(F.array_sort(F.collect_list(F.struct("holders", "word"))).alias("all"))
    prefix = rare.select("place", "size", F.explode(F.slice("all", F.lit(1), (F.col("size") - F.ceil(F.col("size") * threshold) + 1).cast("int"))).alias("x")).where("x.holders > 1")
    x, y = (prefix.select(F.col("x.word").alias("word"), F.col("place").alias(s), F.col("size").alias(f"n{s}")) for s in "ab")
    near = x.join(y, "word").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)).select("a", "b").distinct()
    wa, wb = (words.select(F.col("place").alias(s), F.col("words").alias(f"w{s}")) for s in "ab")
    both = F.size(F.array_intersect("wa", "wb"))
    near = stored(near.join(wa, "a").join(wb, "b").where(both / (F.size("wa") + F.size("wb") - both) >= threshold).select("a", "b"), "neighbours")

    # a query without an earlier neighbour is a seed at once
    known = stored(words.select("place").join(near.select(F.col("b").alias("place")), "place", "left_anti").withColumn("is_seed", F.lit(True)), "settled")
    total = words.count()
    while known.count() < total:
        a = near.join(known.select(F.col("place").alias("b")), "b", "left_anti")
        told = a.join(known.select(F.col("place").alias("a"), "is_seed"), "a", "left")
        settled = told.groupBy(F.col("b").alias("place")).agg(F.max(F.coalesce("is_seed", F.lit(False))).alias("follows"), F.count_if(F.col("is_seed").isNull()).alias("open"))
        fresh = settled.where("follows OR open = 0").select("place", (~F.col("follows")).alias("is_seed"))
        known = stored(known.unionByName(fresh), "settled")
    seeds = known.where("is_seed").select(F.col("place").alias("a"))
    first = near.join(seeds, "a", "left_semi").groupBy(F.col("b").alias("place")).agg(F.min("a").alias("seed"))
    out = known.where("NOT is_seed").join(first, "place").select("place", "seed").unionByName(known.where("is_seed").select("place", F.col("place").alias("seed")))
    names = words.select(F.col("place").alias("seed"), F.col("query").alias("name"))
    return out.join(words.select("place", "query"), "place").join(names, "seed").select(F.col("name").alias("seed"), "query")


def keyed_failures(failures: DataFrame, key: Column) -> DataFrame:
    """``key, query, n``: failures by their canonical key, with the most frequent spelling."""
    spelled = failures.groupBy(key.alias("key"), "query").agg(F.count("*").alias("n"))
    return spelled.groupBy("key").agg(F.max(F.struct("n", F.col("query"))).alias("x"), F.sum("n").alias("n")).select("key", "x.query", "n")
