"""Document filters, scalars, merges and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import predicates, ranges, records
from ..sources import tables
from .registry import DOCS, TOKENS, query


@query(f"SELECT doc_id FROM {DOCS} WHERE lang = 'en' AND list_contains(tags, 'src1') AND NOT list_contains(tags, 'de') AND ingested_at >= TIMESTAMP '2024-01-01 00:10:00' AND ingested_at < TIMESTAMP '2024-01-01 10:00:00'")
def predicate_combined(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).where(predicates.search_predicate(kind="en", tag="src1", not_tag="de", after="2024-01-01 00:10:00", before="2024-01-01 10:00:00")).select("doc_id")


@query(f"SELECT doc_id FROM {DOCS}, (SELECT max(ingested_at) AS m FROM {DOCS}) WHERE ingested_at >= m - INTERVAL 1 DAY")
def since_days(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    return docs.where(predicates.search_predicate(since_days=1, as_of=F.lit(docs.agg(F.max("ingested_at")).first()[0]))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 40)")
def source_kind_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    kinds = docs.groupBy("source").agg(F.count("*").alias("n")).where("n > 40")
    return docs.join(kinds, "source", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IS NULL")
def source_missing(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).where(predicates.search_predicate(source_missing=True)).select("doc_id")


@query("SELECT conv_id FROM conversations GROUP BY 1 HAVING bool_or(lower(role) IN ('system'))")
def participant_overlap(spark: SparkSession, sf: str) -> DataFrame:
    threads = tables.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("participants"))
    return threads.where(predicates.search_predicate(persons=["SYSTEM"])).select("conv_id")


@query(f"SELECT doc_id, ingested_at FROM {DOCS} ORDER BY ingested_at DESC, doc_id LIMIT 25")
def list_newest(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.newest(tables.documents(spark, sf), 25).select("doc_id", "ingested_at")


@query("SELECT doc_id FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.keyset_page(tables.documents(spark, sf), "doc_id", 100, 50).select("doc_id")


@query("SELECT CASE WHEN count(*) = 0 THEN 'missing' WHEN count(*) > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN count(*) = 1 THEN min(c_name) END AS id FROM customer WHERE starts_with(c_name, 'Customer#00000012')")
def prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.prefix_lookup(tables.table(spark, sf, "customer"), "c_name", "Customer#00000012")


@query("SELECT s.doc_id FROM documents s LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality IS DISTINCT FROM 1")
def unenriched_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label, or with another one; null-safe."""
    rows = tables.documents(spark, sf).join(tables.table(spark, sf, "labels"), "doc_id", "left")
    return rows.where(~F.col("quality").eqNullSafe(1)).select("doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id)")
def orphan_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in none of three link sets."""
    docs = tables.documents(spark, sf).select("doc_id")
    for name, key in (("labels", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id")):
        docs = docs.join(tables.table(spark, sf, name).select(F.col(key).alias("doc_id")), "doc_id", "left_anti")
    return docs


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'ECONOMY' UNION SELECT 'nobody'),
l AS (SELECT n.name, 0 AS level, p_partkey AS id FROM n JOIN part ON lower(p_name) = lower(n.name) UNION ALL SELECT n.name, 1, p_partkey FROM n JOIN part ON lower(p_type) = lower(n.name)),
g AS (SELECT name, level, count(DISTINCT id) AS k, min(id) AS id, row_number() OVER (PARTITION BY name ORDER BY level) AS r FROM l GROUP BY 1, 2)
SELECT n.name, CASE WHEN k = 1 THEN g.id END AS id FROM n LEFT JOIN g ON g.name = n.name AND r = 1"""
)
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names to entities by name, then by type; none where several fit."""
    parts = tables.table(spark, sf, "part")
    names = parts.select(F.col("p_name").alias("name")).union(spark.createDataFrame([("ECONOMY",), ("nobody",)], "name string"))
    return predicates.resolve(names, parts.withColumn("id", F.col("p_partkey")), [F.col("p_name"), F.col("p_type")])


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS words, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens, sha256(text) AS content_hash FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("words"), tx.token_estimate(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("content_hash"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#:@]+(/[^?#]*)?([?#].*)?$') THEN lower(regexp_extract(url, '^(https?)', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#:@]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) END END AS url FROM pages")
def url_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "pages").select("page_id", tx.normalised_url(F.col("url")).alias("url"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "pages").select("page_id", tx.plain_text(F.col("html")).alias("text"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_brand || ' ' || p_name)), '[ \t\n_/\\-]+', '-', 'g'), '^-+|-+$', '', 'g') AS tag, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def tag_and_slug(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws(" ", "p_brand", "p_name")
    return tables.table(spark, sf, "part").select("p_partkey", tx.normalised_tag(name).alias("tag"), tx.slug(name).alias("slug"))


@query()
def sub_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Host and address parts of every page's URL."""
    return tables.table(spark, sf, "pages").select("page_id", tx.sub_tokens(F.col("url")).alias("parts"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS keys, len(regexp_extract_all(text, 'password=[A-Za-z0-9]{8,}')) AS passwords FROM documents")
def secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of two formats in every document."""
    found = tables.documents(spark, sf).select("doc_id", tx.secret_findings(F.col("text")).alias("f"))
    count = lambda kind: F.size(F.filter("f", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count("aws_access_key").alias("keys"), count("password").alias("passwords"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}', '[aws_access_key]', 'g'), 'password=[A-Za-z0-9]{8,}', '[password]', 'g')) AS hash FROM documents")
def secret_redaction(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).select("doc_id", F.sha2(tx.without_secrets(F.col("text")), 256).alias("hash"))


@query()
def card_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Luhn-valid digit runs of every document that has one."""
    return tables.documents(spark, sf).select("doc_id", tx.card_numbers(tx.folded_digits(F.col("text"))).alias("cards")).where(F.size("cards") > 0)


@query("SELECT doc_id, (list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 1000 AND length(text) / len(string_split(text, chr(10))) > 200) AS minified FROM documents")
def minified(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).select("doc_id", tx.is_minified(F.col("text")).alias("minified"))


@query("SELECT event_id, CASE WHEN (id >> 22) >= 60000 AND make_timestamp_ms((id >> 22) + 1288834974657) <= TIMESTAMP '2030-01-01' THEN make_timestamp_ms((id >> 22) + 1288834974657) END AS at FROM (SELECT event_id, (event_id % 30000 * 40000000 + 10000) * 4194304 AS id FROM events)")
def snowflake_time(spark: SparkSession, sf: str) -> DataFrame:
    """Times in the ids of every event; those after the as-of time have none."""
    return snowflake_time_all(spark, sf)


@query("SELECT event_id, CASE WHEN (id >> 22) >= 60000 AND make_timestamp_ms((id >> 22) + 1288834974657) <= TIMESTAMP '2030-01-01' THEN make_timestamp_ms((id >> 22) + 1288834974657) END AS at FROM (SELECT event_id, ((event_id % 30000) * 40000000 + 10000) * 4194304 AS id FROM events)")
def snowflake_time_all(spark: SparkSession, sf: str) -> DataFrame:
    """Times in the ids of every event; the time part repeats after 30,000 events, so that no id overflows."""
    ids = tables.table(spark, sf, "events").select("event_id", ((F.col("event_id") % 30_000 * 40_000_000 + 10_000) * 4_194_304).alias("id"))
    return ids.select("event_id", tx.snowflake_time(F.col("id"), F.lit("2030-01-01").cast("timestamp")).alias("at"))


@query(
    f"""SELECT doc_id, running FROM (SELECT doc_id, source, sum(greatest(n_chars, 1)) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 20000"""
)
def token_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each source that fit a budget, as a prefix."""
    return records.packed_prefix(tables.documents(spark, sf), ["source"], [F.col("doc_id")], "n_chars", 20000).select("doc_id", "running")


@query()
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in chunks of 600 words with 100 of overlap."""
    return records.chunked(tables.documents(spark, sf))


@query(
    """SELECT conv_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(lower(role)))), ',') AS participants, string_agg(CASE WHEN k < n0 THEN '> ' ELSE '' END || role || ': ' || text, chr(10) ORDER BY turn) AS content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n0 FROM conversations) GROUP BY 1"""
)
def thread_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return records.assembled_threads(tables.table(spark, sf, "conversations"))


@query(
    """WITH s AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE source <> 'src3'), i AS (SELECT doc_id AS id, CASE WHEN lang = 'de' THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents),
k AS (SELECT h, min(id) AS id FROM s GROUP BY 1)
SELECT i.id, CASE WHEN s.id IS NULL AND k.id IS NULL THEN 'insert' WHEN coalesce(s.h, k.h) = i.h THEN 'skip' ELSE 'update' END AS action, coalesce(s.id, k.id) AS matched_id FROM i LEFT JOIN s ON s.id = i.id LEFT JOIN k ON k.h = i.h"""
)
def dedup_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """What to do with each incoming document: by its own key, then by its content."""
    docs = tables.documents(spark, sf)
    stored = docs.where("source <> 'src3'").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("external"), F.sha2("text", 256).alias("content_hash"))
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    incoming = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("external"), F.sha2(text, 256).alias("content_hash"))
    return records.ingest_actions(incoming, stored, ["external", "content_hash"]).select("id", "action", "matched_id")


@query(
    """SELECT a, b, score, status FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY status <> 'pending' DESC, score DESC, old DESC) AS k FROM (
SELECT least(o_custkey, o_orderkey % 50) AS a, greatest(o_custkey, o_orderkey % 50) AS b, o_totalprice AS score, CASE WHEN o_orderstatus = 'F' THEN 'dismissed' ELSE 'pending' END AS status, 1 AS old FROM orders
UNION ALL SELECT least(o_orderkey % 50, o_custkey), greatest(o_orderkey % 50, o_custkey), o_totalprice * 2, 'pending', 0 FROM orders)) WHERE k = 1"""
)
def undirected_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in either direction become one row; decided ones stay."""
    orders = tables.table(spark, sf, "orders")
    other = F.col("o_orderkey") % 50
    stored = orders.select(F.col("o_custkey").alias("a"), other.alias("b"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") == "F", "dismissed").otherwise("pending").alias("status"))
    return records.upsert_undirected(stored, orders.select(other.alias("a"), F.col("o_custkey").alias("b"), (F.col("o_totalprice") * 2).alias("score"), F.lit("pending").alias("status")))


@query("SELECT doc_id, CASE WHEN source = 'src2' THEN [CASE WHEN lang = 'fr' THEN 'french' ELSE lang END] ELSE [CASE WHEN lang = 'fr' THEN 'french' ELSE lang END, source] END AS tags FROM documents")
def tag_mapping_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """One tag renamed, one dropped."""
    mapping = spark.createDataFrame([("fr", "french"), ("src2", None)], "tag string, target string")
    return records.retagged(tables.documents(spark, sf), mapping)


@query("SELECT 'labels' AS name, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'es') UNION ALL SELECT 'documents', count(*) FROM documents WHERE lang <> 'es'")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    left = records.cascaded({"labels": (tables.table(spark, sf, "labels"), "doc_id"), "documents": (docs, "doc_id")}, docs.where("lang = 'es'"))
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in left.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY 1 HAVING count(*) >= 2")
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY ingested_at DESC, doc_id) AS k FROM {DOCS}) WHERE k <= 3")
def newest_per_tag(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.desc("ingested_at"), "doc_id")
    return tables.documents(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 3").select("lang", "doc_id")


@query("SELECT title, doc_id, CASE WHEN k = 1 THEN title ELSE title || '-' || k END AS numbered FROM (SELECT split_part(text, chr(10), 1) AS title, doc_id, row_number() OVER (PARTITION BY split_part(text, chr(10), 1) ORDER BY doc_id) AS k FROM documents)")
def slug_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Equal titles are numbered from the second."""
    rows = tables.documents(spark, sf).select("title", "doc_id", F.xxhash64("title").alias("group"))
    return ranges.numbered(rows, ["group"], [F.col("doc_id")]).select("title", "doc_id", F.when(F.col("k") == 1, F.col("title")).otherwise(F.concat_ws("-", "title", F.col("k").cast("string"))).alias("numbered"))
