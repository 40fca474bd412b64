"""Review queries: stale documents, conflicts, queues, weekly themes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, review
from ..sources import tables
from ..sources.shared import stored, tasks_for
from .graph import PAIRS
from .registry import ACTS, DOCS, MENTIONS, NOTES, query

_COS = "round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6)"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.embeddings(spark, sf)


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """Documents mention the words of their participants: ``doc_id, entity_id``."""
    return tables.notes(spark, sf).select("doc_id", F.explode(F.array_distinct("participants")).alias("entity_id")).where("entity_id <> ''")


PEOPLE = f"(SELECT DISTINCT doc_id, e AS entity_id FROM (SELECT doc_id, unnest(participants) AS e FROM {NOTES}) WHERE e <> '')"


@query(
    f"""SELECT doc_id, arg_max(other, (s, -other)) AS superseded_by, max(s) AS score FROM (SELECT DISTINCT a.doc_id, b.doc_id AS other, {_COS} AS s FROM {PEOPLE} p JOIN {PEOPLE} q ON p.entity_id = q.entity_id JOIN {NOTES} a ON a.doc_id = p.doc_id AND a.summary IS NOT NULL AND NOT a.draft
JOIN {NOTES} b ON b.doc_id = q.doc_id AND b.ingested_at > a.ingested_at AND b.ingested_at <= a.ingested_at + INTERVAL 5 DAY JOIN embeddings x ON x.vec_id = a.doc_id JOIN embeddings y ON y.vec_id = b.doc_id) WHERE s >= 0.0 GROUP BY 1"""
)
def staleness_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Summarised documents that a similar newer one with a common participant supersedes."""
    notes = tables.notes(spark, sf)
    old = notes.where("summary IS NOT NULL AND NOT draft").select("doc_id", F.col("ingested_at").alias("at"))
    return review.superseded(old, notes.select("doc_id", F.col("ingested_at").alias("at")), _people(spark, sf), _vectors(spark, sf), 5, 0.0)


@query(
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY entity_id) AS n FROM {PEOPLE}), h AS (SELECT * FROM e WHERE n >= 2 AND k <= 10)
SELECT entity_id, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, a, b) AS k FROM (SELECT p.entity_id, p.doc_id AS a, q.doc_id AS b, {_COS} AS score FROM h p JOIN h q ON p.entity_id = q.entity_id AND p.doc_id < q.doc_id
JOIN embeddings x ON x.vec_id = p.doc_id JOIN embeddings y ON y.vec_id = q.doc_id) WHERE score >= 0.1) WHERE k <= 3"""
)
def conflict_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar document pairs of each participant, for a verdict."""
    return review.conflict_pairs(_people(spark, sf), _vectors(spark, sf), 2, 10, 0.1, 3)


def _newest(docs: DataFrame) -> Column:
    return F.lit(docs.agg(F.max("ingested_at")).first()[0])


@query(
    f"""SELECT count(*) FILTER (WHERE age >= 0.05) AS aged, count(*) FILTER (WHERE age >= 0.05 AND known) AS in_graph, count(*) FILTER (WHERE age >= 0.05 AND known AND summary IS NOT NULL) AS summarised
FROM (SELECT *, date_diff('microsecond', ingested_at, (SELECT max(ingested_at) FROM {DOCS})) / 86400000000.0::DOUBLE AS age, doc_id IN (SELECT doc_id FROM {PEOPLE}) AS known FROM {NOTES})"""
)
def stale_funnel(spark: SparkSession, sf: str) -> DataFrame:
    notes = tables.notes(spark, sf)
    return review.stale_funnel(notes, _people(spark, sf), _newest(notes), 0.05)


CONTRIBUTIONS = f"(SELECT a.doc_id, a.entity_id AS src, b.entity_id AS dst, least(a.mention_count, b.mention_count) AS n FROM {MENTIONS} a JOIN {MENTIONS} b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id)"


@query(
    f"""SELECT community, sum(n) AS weight FROM (SELECT DISTINCT p_brand AS community, doc_id, src, dst, n FROM {CONTRIBUTIONS} JOIN orders ON o_orderkey = doc_id AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' JOIN part ON p_partkey = src OR p_partkey = dst) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
)
def weekly_community_weight(spark: SparkSession, sf: str) -> DataFrame:
    """The communities of most co-occurrence in a period's documents."""
    docs = tables.table(spark, sf, "orders").where("o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'").select(F.col("o_orderkey").alias("doc_id"))
    labels = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    inside = stored(tables.mentions_by_document(spark, sf, docs), "period-mentions")
    spread = inside.repartition(tasks_for(inside.count(), spark), "doc_id")
    return review.community_weight(labels, graph.contributions(spread), None, 5)


@query(f"WITH t AS (SELECT lang AS tag, doc_id FROM documents), b AS (SELECT tag FROM t GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 2) SELECT tag, doc_id FROM (SELECT tag, doc_id, row_number() OVER (PARTITION BY tag ORDER BY doc_id) AS k FROM t WHERE tag IN (SELECT tag FROM b)) WHERE k <= 10")
def tag_themes(spark: SparkSession, sf: str) -> DataFrame:
    """The two largest first tags and ten documents of each."""
    return review.tag_themes(tables.documents(spark, sf), 2, 10)


@query(f"SELECT key, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(participants) AS key FROM {NOTES}) WHERE key <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def key_people(spark: SparkSession, sf: str) -> DataFrame:
    """The ten participants of most documents."""
    return review.tallied(tables.notes(spark, sf), "participants", 10)


@query("SELECT lang, count(doc_id) AS n FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS lang) LEFT JOIN documents USING (lang) GROUP BY 1")
def kind_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each known kind; a kind without any counts zero."""
    known = spark.createDataFrame([(k,) for k in ("de", "en", "es", "fr", "it")], "lang string")
    return review.zero_filled(known, tables.documents(spark, sf), "lang")


@query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY 1")
def content_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT tag, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(tags) AS tag FROM {NOTES} WHERE NOT draft AND sensitivity <> 'confidential' AND path NOT LIKE 'people/%') GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def browseable_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of at least two discoverable documents."""
    from ..operators.predicates import discoverable

    rows = tables.notes(spark, sf).where(discoverable()).select("doc_id", F.explode("tags").alias("tag"))
    return rows.groupBy("tag").agg(F.countDistinct("doc_id").alias("n")).where("n >= 2")


@query(
    f"""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM {NOTES} WHERE draft) AS drafts, (SELECT count(*) FROM embeddings) AS vectors,
(SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) AS kinds"""
)
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One row of totals, with the counts by kind in it."""
    notes = tables.notes(spark, sf)
    kinds = notes.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("draft").alias("d"))
    rows = kinds.agg(F.sum("n").alias("documents"), F.sum("d").alias("drafts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat_ws("=", x["lang"], x["n"].cast("string"))), ",").alias("kinds"))
    total = tables.embeddings(spark, sf).count()
    return rows.select("documents", "drafts", F.lit(total).cast("long").alias("vectors"), "kinds")


@query(
    f"""WITH s AS (SELECT doc_id AS target, 0.5::DOUBLE AS score, CASE WHEN lang = 'de' THEN 'dismissed' WHEN lang = 'fr' THEN 'snoozed' WHEN lang = 'es' THEN 'resolved' ELSE 'open' END AS status FROM documents WHERE source < 'src15'),
n AS (SELECT doc_id AS target, round(1.0 / (1 + n_chars), 6)::DOUBLE AS score FROM documents WHERE source >= 'src12')
SELECT coalesce(s.target, n.target) AS target, CASE WHEN s.target IS NOT NULL AND (s.status IN ('dismissed', 'snoozed') OR n.target IS NULL) THEN s.score ELSE n.score END AS score,
CASE WHEN s.target IS NOT NULL AND (s.status IN ('dismissed', 'snoozed') OR n.target IS NULL) THEN s.status ELSE 'open' END AS status FROM s FULL JOIN n ON s.target = n.target"""
)
def finding_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Findings after a scan; decided ones aren't overwritten."""
    docs = tables.documents(spark, sf)
    status = F.when(F.col("lang") == "de", "dismissed").when(F.col("lang") == "fr", "snoozed").when(F.col("lang") == "es", "resolved").otherwise("open")
    old = docs.where("source < 'src15'").select(F.col("doc_id").alias("target"), F.lit(0.5).alias("score"), status.alias("status"))
    fresh = docs.where("source >= 'src12'").select(F.col("doc_id").alias("target"), F.round(1.0 / (1 + F.col("n_chars")), 6).alias("score"))
    return review.upserted_findings(old, fresh)


@query(
    f"""WITH f AS (SELECT doc_id AS target, count(*)::DOUBLE AS score, count(DISTINCT session_id) AS evidence FROM {ACTS} WHERE action = 'error' GROUP BY 1)
SELECT target, score FROM f WHERE score >= 2 AND evidence >= 2 AND target NOT IN (SELECT doc_id FROM {DOCS} WHERE lang = 'de' OR (lang = 'fr' AND ingested_at + INTERVAL 1 DAY > (SELECT max(ingested_at) FROM {DOCS}))) ORDER BY 2 DESC, 1 LIMIT 20"""
)
def gap_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of failing sessions, without dismissed and still snoozed ones, twenty at most."""
    found = review.DETECTORS["failures"](tables.interactions(spark, sf))
    docs = tables.documents(spark, sf)
    status = F.when(F.col("lang") == "de", "dismissed").when(F.col("lang") == "fr", "snoozed").otherwise("open")
    decided = docs.select(F.col("doc_id").alias("target"), status.alias("status"), F.timestamp_micros(F.unix_micros("ingested_at") + 86_400_000_000).alias("snoozed_until"))
    return review.gap_queue(found, decided, _newest(docs), 2.0, 2, 20)


@review.detector("failures")
def failing_documents(acts: DataFrame) -> DataFrame:
    """``target, score, evidence``: documents with errors, their number, and the sessions."""
    return acts.where("action = 'error'").groupBy(F.col("doc_id").alias("target")).agg(F.count("*").cast("double").alias("score"), F.collect_set("session_id").alias("evidence"))


@query(
    f"""WITH p AS (SELECT src AS a, dst AS b, co_docs / 100.0::DOUBLE AS similarity FROM {PAIRS} WHERE co_docs >= 2), s AS (SELECT a, b, 0.5::DOUBLE AS similarity, CASE WHEN b % 3 = 0 THEN 'duplicate' ELSE 'open' END AS status FROM (SELECT DISTINCT a, b + 1 AS b FROM p UNION SELECT a, b FROM p)),
t AS (SELECT p_partkey AS id FROM part WHERE p_size < 10), k AS (SELECT * FROM s WHERE status <> 'open' OR NOT (a IN (SELECT id FROM t) OR b IN (SELECT id FROM t)))
SELECT * FROM k UNION ALL SELECT a, b, similarity, 'open' FROM p WHERE (a IN (SELECT id FROM t) OR b IN (SELECT id FROM t)) AND NOT EXISTS (SELECT 1 FROM k WHERE k.a = p.a AND k.b = p.b)"""
)
def refreshed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pairs after some documents changed."""
    found = graph.cooccurrence(tables.mentions(spark, sf)).where("co_docs >= 2").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("co_docs") / 100.0).alias("similarity"))
    old = found.select("a", (F.col("b") + 1).alias("b")).union(found.select("a", "b")).distinct().select("a", "b", F.lit(0.5).alias("similarity"), F.when(F.col("b") % 3 == 0, "duplicate").otherwise("open").alias("status"))
    touched = tables.table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("doc_id"))
    return review.refreshed_pairs(old, touched, found)


@query(f"SELECT a, b, similarity FROM (SELECT src AS a, dst AS b, co_docs AS similarity FROM {PAIRS} WHERE co_docs >= 2) ORDER BY similarity DESC, a, b LIMIT 25")
def pair_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 pairs of highest similarity."""
    rows = graph.cooccurrence(tables.mentions(spark, sf)).where("co_docs >= 2").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("co_docs").alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "a", "b").limit(25)


@query(f"SELECT src, dst FROM (SELECT DISTINCT src, dst FROM {PAIRS} WHERE co_docs >= 2) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_partkey + p_size AS a, p_partkey AS b FROM part) l WHERE (l.a = src AND l.b = dst) OR (l.a = dst AND l.b = src))")
def retired_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Pending suggestions without those that are linked by now."""
    pending = graph.cooccurrence(tables.mentions(spark, sf)).where("co_docs >= 2").select("src", "dst")
    links = tables.table(spark, sf, "part").select((F.col("p_partkey") + F.col("p_size")).alias("src"), F.col("p_partkey").alias("dst"))
    return review.retired(pending, links)


_WORDS = "string_split(lower(p_name), ' ')"


@query(f"WITH q AS (SELECT p_name AS query, array_to_string(list_sort(list_distinct({_WORDS})), ' ') AS key, count(*) AS n FROM part GROUP BY 1, 2) SELECT key, arg_max(query, (n, query)) AS query, sum(n) AS n FROM q GROUP BY 1")
def failures_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Failed queries by canonical key, with the usual spelling."""
    rows = tables.table(spark, sf, "part").select(F.col("p_name").alias("query"))
    return review.keyed_failures(rows, tx.query_key(F.col("query")))


@query()
def failed_query_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of all failed queries, in the order of their number."""
    rows = tables.table(spark, sf, "part").groupBy(F.col("p_name").alias("query")).agg(F.count("*").alias("n"))
    return review.query_clusters(rows)
