"""Ingest, edits, synchronisation and lookups of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import predicates, records, search
from ..sources import tables
from .registry import ACTS, DOCS, MENTIONS, NOTES, query


@query("SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'Neu' ELSE split_part(text, chr(10), 1) END AS title, sha256(CASE WHEN source = 'src3' THEN text || '!' ELSE text END) AS hash, CASE WHEN lang = 'de' THEN lang || ',2' ELSE lang || ',1' END AS metadata, source = 'src3' AS rechunk FROM documents")
def edit_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Field-level patches: titles of one language, texts of one source, one key of the metadata."""
    docs = tables.documents(spark, sf)
    meta = lambda n: F.create_map(F.lit("v"), F.lit(n))
    stored = docs.select(F.col("doc_id").alias("id"), "title", "text", "tags", F.map_concat(meta("1"), F.create_map(F.lit("lang"), F.col("lang"))).alias("metadata"))
    patches = docs.where("lang = 'de' OR source = 'src3'").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "Neu").alias("title"), F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).alias("text"), F.lit(None).cast("array<string>").alias("tags"), F.when(F.col("lang") == "de", meta("2")).alias("metadata"))
    return records.patched(stored, patches).select("id", "title", F.sha2("text", 256).alias("hash"), F.concat_ws(",", F.col("metadata")["lang"], F.col("metadata")["v"]).alias("metadata"), "rechunk")


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id + 1000000000, sha256(text) FROM documents d WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.text = d.text)")
def insert_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents and the incoming ones that aren't stored."""
    docs = tables.documents(spark, sf).select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    stored = docs.where("lang = 'en'").select("doc_id", "hash")
    fresh = docs.where("lang <> 'en'").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "hash").join(stored.select("hash"), "hash", "left_anti")
    return stored.unionByName(fresh.select("doc_id", "hash"))


@query("SELECT lang AS kind, CASE WHEN source < 'src15' THEN source END AS external_id, min(n_chars)::VARCHAR AS metadata FROM documents WHERE source < 'src12' GROUP BY 1, 2 UNION ALL SELECT lang, CASE WHEN source < 'src15' THEN source END AS e, min(n_chars::VARCHAR) FROM documents WHERE source >= 'src12' GROUP BY 1, 2")
def source_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of the collection and the new ones; those without an id of their own share one a kind."""
    external = F.when(F.col("source") < "src15", F.col("source"))
    docs = tables.documents(spark, sf)
    stored = docs.where("source < 'src12'").groupBy(F.col("lang").alias("kind"), external.alias("external_id")).agg(F.min("n_chars").cast("string").alias("metadata"))
    return records.upserted_sources(stored, docs.select(F.col("lang").alias("kind"), external.alias("external_id"), F.col("n_chars").cast("string").alias("metadata")))


_CHUNKS = "(SELECT doc_id, i - 1 AS chunk_index, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(content) <> '')"


@query(f"SELECT doc_id, chunk_index, sha256(title) AS title, lang || ' ' || source AS tags FROM {_CHUNKS} JOIN {DOCS} USING (doc_id)")
def chunk_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their document's search fields."""
    docs = tables.documents(spark, sf)
    return records.chunk_rows(search.chunks(docs), docs).select("doc_id", "chunk_index", F.sha2("title_text", 256).alias("title"), F.col("tags_text").alias("tags"))


@query(f"SELECT doc_id, chunk_index, lang || ' ' || source AS new_tags FROM {_CHUNKS} JOIN documents USING (doc_id) WHERE lang = 'fr'")
def chunk_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose stored tags are old."""
    docs = tables.documents(spark, sf)
    old = records.chunk_rows(search.chunks(docs), docs).withColumn("tags_text", F.when(F.col("title_text").isNotNull() & F.col("tags_text").startswith("fr "), "french").otherwise(F.col("tags_text")))
    return records.stale_chunk_fields(old, docs).select("doc_id", "chunk_index", "new_tags")


@query("SELECT user_id AS series, array_to_string(list_slice(s, greatest(1, len(s) - 4), len(s)), ',') AS starts FROM (SELECT user_id, list_sort(list_distinct(list(event_id) FILTER (WHERE event_type <> 'view' OR value > 100 OR event_id > 900))) AS s FROM events GROUP BY 1)")
def calendar_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of a series after a run over part of its time: unseen ones inside go, the last five stay."""
    events = tables.table(spark, sf, "events")
    seen = F.when((F.col("event_type") != "view") | (F.col("value") > 100), F.col("event_id"))
    rows = events.groupBy("user_id").agg(F.collect_list("event_id").alias("stored"), F.collect_list(seen).alias("incoming"))
    starts = records.merged_occurrences(F.col("stored"), F.col("incoming"), F.lit(0), F.lit(900), 5)
    return rows.select(F.col("user_id").alias("series"), F.array_join(starts, ",").alias("starts"))


@query("SELECT conv_id AS item_id, 'Talk ' || conv_id AS title, '# Talk ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn, role, text) AS content FROM conversations GROUP BY conv_id")
def item_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Items with their events as one text each."""
    turns = tables.table(spark, sf, "conversations")
    items = turns.select(F.col("conv_id").alias("item_id"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), F.col("turn").alias("updated"))
    return records.item_documents(items, turns.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("at"), F.col("role").alias("kind"), F.col("text").alias("body")))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN 'page' WHEN lang = 'de' AND source < 'src15' THEN 'skip: index' WHEN lang = 'de' THEN 'database' ELSE 'skip: attachment' END AS kind FROM documents) GROUP BY 1")
def export_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Files of an export by what becomes of them."""
    ending = F.when(F.col("lang") == "en", ".MD").when((F.col("lang") == "de") & (F.col("source") < "src15"), "_all.csv").when(F.col("lang") == "de", ".csv").otherwise(".png")
    rows = tables.documents(spark, sf).select(records.export_plan(F.concat("source", ending)).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT event_id AS id, CASE WHEN action <> 'error' THEN acted END AS posted FROM {ACTS}), s AS (SELECT * FROM p WHERE posted >= TIMESTAMP '2024-01-10') SELECT id, posted, greatest(0, (SELECT count(*) FROM s) - 30) AS remaining FROM s ORDER BY posted DESC, id LIMIT 30")
def post_select(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty newest posts since a day, and how many more there are."""
    posts = tables.interactions(spark, sf).select(F.col("event_id").alias("id"), F.when(F.col("action") != "error", F.col("at")).alias("at"))
    return records.selected_posts(posts, F.lit("2024-01-10").cast("timestamp"), 30).withColumnRenamed("at", "posted")


@query(f"SELECT path, CASE WHEN source < 'src12' AND source > 'src10' THEN 'insert' WHEN lang = 'es' THEN 'prune' WHEN lang = 'de' THEN 'update' ELSE 'keep' END AS action FROM {NOTES} WHERE NOT (source < 'src12' AND source > 'src10' AND lang = 'es')")
def vault_sync(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of notes against the stored ones."""
    notes = tables.notes(spark, sf)
    listed = notes.where("lang <> 'es'").select("path", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    stored = notes.where("NOT (source < 'src12' AND source > 'src10')").select("path", F.sha2("text", 256).alias("content_hash"))
    return records.sync_actions(listed, stored)


@query("SELECT doc_id, CASE WHEN lang = 'es' THEN 'new' WHEN lang = 'de' THEN 'content' WHEN lang = 'fr' THEN 'inputs' ELSE 'version' END AS reason FROM documents WHERE lang <> 'en' OR source = 'src1'")
def reconcile_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose graph is stale, and why."""
    docs = tables.documents(spark, sf)
    now = docs.select("doc_id", "lang", "source", F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("inputs_hash"))
    state = now.where("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "de", "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("lang") == "fr", F.lit(None)).otherwise(F.col("lang")).alias("inputs_hash"), F.when(F.col("source") == "src1", 1).otherwise(2).alias("version"))
    return records.stale_aspects(now, state, 2)


@query("SELECT email, name FROM (SELECT email, name, row_number() OVER (PARTITION BY email ORDER BY bool_or(curated) DESC, count(*) DESC, name) AS k FROM (SELECT c_mktsegment || '@x.org' AS email, substr(c_name, 1, 16) AS name, c_acctbal > 9900 AS curated FROM customer) GROUP BY 1, 2) WHERE k = 1")
def directory_index(spark: SparkSession, sf: str) -> DataFrame:
    """The name of each address."""
    rows = tables.table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("@x.org")).alias("email"), F.substring("c_name", 1, 16).alias("name"), (F.col("c_acctbal") > 9900).alias("curated"), F.lit(1).alias("n"))
    return records.directory_index(rows)


@query(f"SELECT doc_id FROM {NOTES} WHERE updated_at >= TIMESTAMP '2024-01-01 05:00:00' AND updated_at < TIMESTAMP '2024-01-03' AND NOT draft AND sensitivity <> 'confidential' AND doc_date >= TIMESTAMP '2023-12-31 12:00:00' AND doc_date < TIMESTAMP '2024-01-02'")
def updated_range(spark: SparkSession, sf: str) -> DataFrame:
    """Public notes by the time of their change and their own date."""
    fits = predicates.search_predicate(updated_after="2024-01-01 05:00:00", updated_before="2024-01-03", draft=False, confidential=False, date="doc_date", after="2023-12-31 12:00:00", before="2024-01-02")
    return tables.notes(spark, sf).where(fits).select("doc_id")


@query(f"SELECT doc_id, thread_id FROM {NOTES} WHERE thread_id = (SELECT min(thread_id) FROM {NOTES})")
def thread_members(spark: SparkSession, sf: str) -> DataFrame:
    notes = tables.notes(spark, sf)
    return notes.where(predicates.search_predicate(thread=notes.agg(F.min("thread_id")).first()[0])).select("doc_id", "thread_id")


@query(f"SELECT o_orderkey AS doc_id, o_totalprice FROM orders WHERE o_orderkey IN (SELECT doc_id FROM {MENTIONS} WHERE entity_id IN (1, 2, 3))")
def entity_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that mention one of three entities."""
    docs = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice")
    return predicates.mentioning(docs, tables.mentions(spark, sf), (1, 2, 3))


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {NOTES} WHERE sensitivity <> 'confidential' AND NOT draft), n AS (SELECT DISTINCT participants[1] AS name FROM {NOTES} WHERE regexp_full_match(participants[1], '[a-z]+')) SELECT name FROM n WHERE name IN (SELECT w FROM w)")
def public_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names (first words of titles) that a public text holds."""
    notes = tables.notes(spark, sf)
    names = notes.select(F.get("participants", F.lit(0)).alias("name")).where(F.col("name").rlike("^[a-z]+$")).distinct()
    return predicates.in_public_record(names, notes)


@query("SELECT CASE WHEN count(DISTINCT c_custkey) = 0 THEN 'missing' WHEN count(DISTINCT c_custkey) > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN count(DISTINCT c_custkey) = 1 THEN min(c_custkey) END AS person FROM customer WHERE contains(lower(c_name), '00014')")
def person_lookup(spark: SparkSession, sf: str) -> DataFrame:
    people = tables.table(spark, sf, "customer").select(F.lit("x@y.org").alias("email"), F.col("c_name").alias("name"), F.col("c_custkey").alias("person"))
    return predicates.resolve_person(people, " 00014 ")


@query(f"SELECT d.doc_id, d.lang, s.n AS source_docs FROM {DOCS} d LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) s USING (source) WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def fetch_document(spark: SparkSession, sf: str) -> DataFrame:
    """One document with its source."""
    docs = tables.documents(spark, sf)
    sources = docs.groupBy("source").agg(F.count("*").alias("source_docs"))
    return docs.where(F.col("doc_id") == docs.agg(F.min("doc_id")).first()[0]).join(sources, "source", "left").select("doc_id", "lang", "source_docs")


@query(f"SELECT c.doc_id, c.chunk_index FROM {_CHUNKS} c JOIN {NOTES} n USING (doc_id) WHERE n.sensitivity <> 'confidential' AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = c.doc_id)")
def chunks_without_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of public documents that have no vector; the join on the document is there only for its tier."""
    notes = tables.notes(spark, sf)
    public = notes.where("sensitivity <> 'confidential'").select("doc_id")
    missing = search.chunks(notes).join(tables.embeddings(spark, sf).select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    return missing.join(public, "doc_id", "left_semi").select("doc_id", "chunk_index")


@query(f"SELECT doc_id, ingested_at FROM {NOTES}, (SELECT max(ingested_at) AS m FROM {DOCS}) WHERE ingested_at >= m - INTERVAL 12 HOUR AND NOT draft ORDER BY ingested_at DESC, doc_id LIMIT 20")
def recent_captures(spark: SparkSession, sf: str) -> DataFrame:
    """The newest notes of the last twelve hours."""
    notes = tables.notes(spark, sf)
    last = F.lit(notes.agg(F.max("ingested_at")).first()[0])
    rows = notes.where((F.unix_micros("ingested_at") >= F.unix_micros(last) - 12 * 3_600_000_000) & ~F.col("draft"))
    return predicates.newest(rows, 20).select("doc_id", "ingested_at")


@query(f"SELECT doc_id FROM {NOTES} WHERE ingested_at BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 06:00:00' AND sensitivity <> 'confidential'")
def ingested_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Public notes of a window that holds both its ends."""
    return tables.notes(spark, sf).where("ingested_at BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 06:00:00' AND sensitivity <> 'confidential'").select("doc_id")


@query(f"SELECT entity_id, p_name AS name, df FROM part JOIN (SELECT entity_id, count(*) AS df FROM {MENTIONS} GROUP BY 1) ON entity_id = p_partkey WHERE p_type = 'PROMO' ORDER BY df DESC, name, entity_id LIMIT 15")
def entity_list(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of a type, those of most documents first."""
    df = tables.mentions(spark, sf).groupBy("entity_id").agg(F.count("*").alias("df"))
    return tables.entities(spark, sf).where("entity_type = 'PROMO'").join(df, "entity_id").orderBy(F.desc("df"), "name", "entity_id").limit(15).select("entity_id", "name", "df")


@query("SELECT p_partkey AS id FROM part WHERE lower(p_type) = 'promo' OR lower(p_brand) = 'promo'")
def alias_match(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose JSON list of aliases holds a name, case aside."""
    aliases = F.from_json(F.to_json(F.array("p_type", "p_brand")), "array<string>")
    return tables.table(spark, sf, "part").where(F.exists(aliases, lambda x: F.lower(x) == "promo")).select(F.col("p_partkey").alias("id"))


@query(f"SELECT doc_id FROM {NOTES} WHERE list_contains(tags, 'de') AND NOT draft ORDER BY ingested_at DESC, doc_id LIMIT 10")
def tag_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The ten newest notes with a tag."""
    return predicates.newest(tables.notes(spark, sf).where(predicates.search_predicate(tag="de", draft=False)), 10).select("doc_id")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN [source, 'new'] ELSE [lang, source, 'new'] END AS tags FROM documents")
def tag_edits(spark: SparkSession, sf: str) -> DataFrame:
    """One tag added to all, one removed."""
    return tables.documents(spark, sf).select("doc_id", F.array_union(F.array_except("tags", F.array(F.lit("en"))), F.array(F.lit("new"))).alias("tags"))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'confidential' ELSE 'normal' END AS sensitivity FROM documents WHERE (lang = 'de') IS DISTINCT FROM (source IN ('src1', 'src2'))")
def sensitivity_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The notes whose tier a rule changes; equal ones aren't written."""
    wanted = F.when(F.col("lang") == "de", "confidential").otherwise("normal")
    return tables.notes(spark, sf).where(~F.col("sensitivity").eqNullSafe(wanted)).select("doc_id", wanted.alias("sensitivity"))


@query(f"SELECT event_id FROM {ACTS} WHERE action IN ('view', 'click') AND ((doc_id < 50) <> (session_id < 20))")
def interaction_append(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows that name exactly one of a document and a graph target."""
    acts = tables.interactions(spark, sf).select("event_id", "action", F.when(F.col("doc_id") < 50, F.col("doc_id")).alias("document_id"), F.when(F.col("session_id") < 20, F.col("session_id")).alias("target_id"))
    fine = F.col("action").isin("view", "click") & (F.col("document_id").isNotNull() != F.col("target_id").isNotNull())
    return acts.where(fine).select("event_id")
