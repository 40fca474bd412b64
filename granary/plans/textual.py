"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import records
from ..sources import tables
from .registry import NOTES, query

_STEPS = (
    ("(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", ""), ("(?s)<!--.*?-->", ""), *((f"(?is)<h{k}[^>]*>\\s*(.*?)\\s*</h{k}>", "\n\n" + "#" * k + " \\1\n\n") for k in range(1, 7)),
    ("(?is)<a\\s[^>]*href=[\"''](https?://[^\"'']*|mailto:[^\"'']*|/[^\"'']*)[\"''][^>]*>(.*?)</a>", "[\\2](\\1)"), ("(?is)<(b|strong)>(.*?)</(b|strong)>", "**\\2**"), ("(?is)<(i|em)>(.*?)</(i|em)>", "*\\2*"),
    ("(?is)<code>(.*?)</code>", "`\\1`"), ("(?is)<blockquote[^>]*>\\s*(.*?)\\s*</blockquote>", "\n\n> \\1\n\n"), ("(?is)<li[^>]*>\\s*", "\n- "), ("(?is)</t[dh]>\\s*<t[dh][^>]*>", " | "), ("(?is)<tr[^>]*>|</tr>", "\n"), ("(?is)<br[^>]*>", "\n"),
    ("(?is)</?(p|div|ul|ol|table|article|section|nav|footer|header)[^>]*>", "\n\n"), ("(?s)<[^>]+>", ""), ("[ \\t]+", " "), (" ?\\n ?", "\n"), ("\\n\\n+", "\n\n"),
)
_MARKDOWN = "html"
for _pattern, _with in _STEPS:
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_pattern}', '{_with}', 'g')"


@query(f"SELECT page_id, trim({_MARKDOWN}, ' ' || chr(10)) AS markdown FROM pages")
def html_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "pages").select("page_id", tx.markdown(F.col("html")).alias("markdown"))


@query(
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT conv_id, turn, role || chr(10) || text AS text FROM conversations)), p AS (SELECT conv_id, count(DISTINCT turn) AS pages FROM l GROUP BY 1),
r AS (SELECT conv_id, line FROM l JOIN p USING (conv_id) WHERE pages >= 3 GROUP BY conv_id, line, pages HAVING count(DISTINCT turn) * 2 > pages)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, k) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = l.conv_id AND r.line = l.line) GROUP BY 1"""
)
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents of pages (turns headed by their role) without the lines that stand on over half of the pages."""
    pages = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.concat_ws("\n", "role", "text").alias("text"))
    return records.without_repeated_lines(pages).withColumnRenamed("doc_id", "conv_id")


_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query(
    f"""SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN regexp_matches('/' || lower(p), '/(node_modules|vendor|third_party|dist|build)/') THEN 'vendored' WHEN regexp_matches(lower(f), '(^|[-.])lock(\\.|$)|-lock\\.(json|yaml)$') THEN 'lockfile'
WHEN regexp_matches(lower(f), '\\.(min\\.[a-z]+|map)$') THEN 'minified' WHEN NOT regexp_matches(lower(f), '\\.(html|py)$') THEN 'extension' END AS reason FROM (SELECT p, split_part(p, '/', -1) AS f FROM (SELECT replace({_PATH}, 'de/', 'build/') AS p FROM pages))) GROUP BY 1"""
)
def code_file_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Paths by the reason that leaves them out."""
    path = F.replace(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), F.lit("de/"), F.lit("build/"))
    rows = tables.table(spark, sf, "pages").select(tx.code_skip_reason(path, ("html", "py")).alias("reason"))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT strftime(o_orderdate, '%G-W%V') AS week, date_trunc('week', o_orderdate)::TIMESTAMP AS first, date_trunc('week', o_orderdate)::TIMESTAMP + INTERVAL 7 DAY - INTERVAL 1 SECOND AS last FROM orders")
def week_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """First and last second of every ISO week that has orders."""
    day = F.to_date("o_orderdate")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    first, last = tx.week_bounds(F.col("week"))
    return tables.table(spark, sf, "orders").select(week.alias("week")).distinct().select("week", first.alias("first"), last.alias("last"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN n_chars * 86400 WHEN 'de' THEN n_chars * 3600 WHEN 'fr' THEN n_chars * 604800 END AS seconds FROM documents")
def duration_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds of duration texts in days, hours and weeks; another text has none."""
    unit = F.create_map(*[F.lit(x) for x in ("en", "d", "de", "H", "fr", " w ")])[F.col("lang")]
    text = F.concat(F.col("n_chars").cast("string"), F.coalesce(unit, F.lit("years")))
    return tables.documents(spark, sf).select("doc_id", tx.duration_seconds(text).alias("seconds"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' THEN o_orderdate::TIMESTAMP - INTERVAL 2 HOUR ELSE o_orderdate::TIMESTAMP END AS at FROM orders")
def dates_to_utc(spark: SparkSession, sf: str) -> DataFrame:
    """Mail dates with a zone, ISO dates without one, and texts that are no dates."""
    mail = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    text = F.when(F.col("o_orderstatus") == "P", "soon").when(F.col("o_orderstatus") == "O", mail).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return tables.table(spark, sf, "orders").select("o_orderkey", tx.sent_at(text).alias("at"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY role) AS speakers FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY 1")
def transcript_speakers(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers of transcripts that label every turn with a name and a time."""
    label = F.concat(F.lit("**"), F.col("role"), F.lit(" | 00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("**\n"), F.col("text"))
    bodies = tables.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", label.alias("x")))), lambda m: m["x"]), "\n").alias("body"))
    return bodies.select("conv_id", F.array_join(F.array_sort(tx.speakers(F.col("body"))), ",").alias("speakers"))


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN lower(replace(c_name, '#', '.')) || '@example.org' WHEN c_nationkey % 3 = 1 THEN lower(c_name) END AS key,
CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END AS mails, c_mktsegment = 'MACHINERY' AS automated, 'First ' || c_name AS person FROM customer"""
)
def participant_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of participants given as addresses, names or placeholders; automated senders; names the right way round."""
    mail = F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.org"))
    which = F.col("c_nationkey") % 3
    token = F.when(which == 0, F.concat(F.col("c_name"), F.lit(" <"), mail, F.lit(">"))).when(which == 1, F.concat(F.lit("  "), F.col("c_name"))).otherwise(F.concat(F.lit("Speaker "), F.col("c_nationkey").cast("string")))
    sender = F.when(F.col("c_mktsegment") == "MACHINERY", "no_reply@example.org").otherwise("robota@example.org")
    name, address = records.email_parts(F.concat(F.lit('"'), F.col("c_name"), F.lit(', First" <'), mail, F.lit(">")))
    rows = tables.table(spark, sf, "customer")
    return rows.select("c_custkey", tx.participant(token).alias("key"), F.when(which == 0, 1).otherwise(0).alias("mails"), (tx.is_automated(sender) & address.isNotNull()).alias("automated"), name.alias("person"))


@query("SELECT doc_id, left(text, 403) AS head, (CASE WHEN length(text) > 403 THEN 100 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens FROM documents")
def token_truncation(spark: SparkSession, sf: str) -> DataFrame:
    head = tx.truncated(F.col("text"), 100)
    return tables.documents(spark, sf).select("doc_id", head.alias("head"), tx.token_estimate(head).alias("tokens"))


@query(
    r"SELECT conv_id, turn, trim(regexp_replace(left(text, 30), '[ \n\t]+', ' ', 'g')) AS item, role = 'assistant' AS done FROM conversations UNION ALL SELECT conv_id, turn, 'again', false FROM conversations"
)
def action_items(spark: SparkSession, sf: str) -> DataFrame:
    """One row an item of every turn that lists its beginning and one item more."""
    line = F.trim(F.regexp_replace(F.left("text", F.lit(30)), r"[ \n\t]+", " "))
    box = F.when(F.col("role") == "assistant", "X").otherwise(" ")
    body = F.concat(F.lit("Notes\n- ["), box, F.lit("] "), line, F.lit("\nno item\n  * [ ] again\n- [y] no"))
    rows = tables.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(tx.action_items(body)).alias("x"))
    return rows.select("conv_id", "turn", "x.item", "x.done")


@query("SELECT p_partkey, 2::BIGINT AS links, p_name AS target, p_type AS alias, split_part(p_brand, '#', 1) AS embed, 'Part ' || p_size AS heading FROM part")
def wiki_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links and embeds of notes that name a part."""
    text = F.concat(F.lit("See [["), F.col("p_name"), F.lit("#Part "), F.col("p_size").cast("string"), F.lit("|"), F.col("p_type"), F.lit("]] and ![["), F.col("p_brand"), F.lit("]], not [ [x]] or [[\n]]"))
    x = tx.wiki_links(text)
    return tables.table(spark, sf, "part").select("p_partkey", F.size(x).cast("long").alias("links"), x[0]["target"].alias("target"), x[0]["alias"].alias("alias"), x[1]["target"].alias("embed"), x[0]["heading"].alias("heading"))


@query("SELECT p_partkey, array_to_string(CASE WHEN p_size BETWEEN 2 AND 20 THEN [p_size, 1] WHEN p_size = 1 THEN [1] ELSE [1] END, ',') AS refs FROM part")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of an answer with twenty sources: doubles and numbers beyond go."""
    text = F.concat(F.lit("As in ["), F.col("p_size").cast("string"), F.lit("] and [1], but [0] or [x] not; again [1]."))
    return tables.table(spark, sf, "part").select("p_partkey", F.array_join(tx.cited(text, F.lit(20)), ",").alias("refs"))


@query("SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS body FROM conversations")
def boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """Mails made of turns, with a footer, a repeated long line and a signature, which go."""
    head = F.element_at(F.split("text", "\n"), 1)
    long = F.concat(F.lit("A long notice that this sender puts under each of the paragraphs: "), F.col("conv_id").cast("string"))
    body = F.concat(long, F.lit("\n"), F.col("text"), F.lit("\n"), long, F.lit("\nSent from my phone\n-- \nJane Doe\n"), head)
    clean = tx.without_boilerplate(body)
    rows = tables.table(spark, sf, "conversations").where(F.col("text").isNotNull())
    return rows.select("conv_id", "turn", F.trim(F.substring(clean, F.length(long) + 2, F.length(clean)), F.lit(" \n")).alias("body"), F.col("text")).select("conv_id", "turn", "body")


@query("SELECT p_partkey, lower(replace(p_name, ' ', '')) || p_size AS key, array_to_string(list_sort(list_distinct(string_split(lower(p_name || ' ' || p_name), ' '))), ' ') AS query, p_name AS line, 'x ' || p_name AS clean, 'ein-tag,' || lower(p_type) AS tags FROM part")
def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical keys, query keys, cleaned lines and tag lists of the parts' names."""
    name = F.col("p_name")
    tags = tx.normalised_tags(F.array(F.lit(" Ein_Tag "), F.col("p_type"), F.lit("ein  tag"), F.lower("p_type"), F.lit(" - ")))
    return tables.table(spark, sf, "part").select(
        "p_partkey", tx.canonical_key(F.concat(name, F.lit(" - "), F.col("p_size").cast("string"))).alias("key"), tx.query_key(F.concat(name, F.lit("? "), F.upper(name))).alias("query"),
        tx.one_line(F.concat(F.lit("\u0007"), name, F.lit("\n\u200b"))).alias("line"), tx.without_escapes(F.concat(F.lit("\x1b[31mx "), name, F.lit("\x1b[0m\u202e"))).alias("clean"), F.array_join(tags, ",").alias("tags"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-' || right(o_orderkey::VARCHAR, 6) || '-' || trim(regexp_replace(lower(o_orderpriority || ' of ' || o_orderstatus), '[^a-z0-9]+', '-', 'g'), '-') AS slug, [lower(o_orderpriority) || '.x@a.org', lower(o_orderpriority) || '.x', CASE WHEN regexp_extract(lower(o_orderpriority), '^([^ ._+-]+)', 1) = '' THEN '' ELSE regexp_extract(lower(o_orderpriority), '^([^ ._+-]+)', 1) END] AS owner FROM orders")
def thread_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs of threads, and the keys of an owner's address."""
    slug = tx.thread_slug(F.col("o_orderdate"), F.col("o_orderkey").cast("string"), F.concat_ws(" of ", "o_orderpriority", "o_orderstatus"))
    return tables.table(spark, sf, "orders").select("o_orderkey", slug.alias("slug"), tx.owner_keys(F.concat(F.col("o_orderpriority"), F.lit(".X@a.org"))).alias("owner"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE 't' || user_id END AS thread_id, CAST(ts AS TIMESTAMP) AS sent_at, ['u' || user_id, event_type] AS participants, CASE WHEN event_type = 'click' THEN NULL ELSE CAST(trunc(value) AS INTEGER) END AS duration_min, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def metadata_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Typed columns of JSON metadata; wrong types are null; a map keeps the rest."""
    thread = F.when(F.col("event_type") == "view", F.col("user_id").cast("string")).otherwise(F.concat(F.lit('"t'), F.col("user_id").cast("string"), F.lit('"')))
    minutes = F.when(F.col("event_type") == "click", "true").otherwise(F.col("value").cast("string"))
    people = F.concat(F.lit('["u'), F.col("user_id").cast("string"), F.lit('", "'), F.col("event_type"), F.lit('"]'))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    meta = F.concat(F.lit('{"thread_id": '), thread, F.lit(', "duration_min": '), minutes, F.lit(', "participants": '), people, F.lit(', "date": "'), when, F.lit('"}'))
    rows = records.promoted(tables.table(spark, sf, "events").select("event_id", "props", meta.alias("metadata")))
    return rows.select("event_id", "thread_id", "sent_at", "participants", "duration_min", F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"))


@query(f"SELECT doc_id, sha256(left(CASE WHEN summary IS NOT NULL THEN title || chr(10) || summary ELSE title || chr(10) || left(text, 2048) END, 2051)) AS basis_hash, regexp_replace(path, '\\.md$', '') AS stem FROM {NOTES}")
def embedding_basis(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of what a document's vector stands for, and its path without the ending."""
    text = tx.basis(F.col("title"), F.col("summary"), F.col("text"))
    return tables.notes(spark, sf).select("doc_id", F.sha2(text, 256).alias("basis_hash"), F.regexp_replace("path", r"\.md$", "").alias("stem"))


@query()
def code_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's lines cut at lines that begin like definitions, or every sixty."""
    rows = tables.documents(spark, sf).select("doc_id", F.posexplode(tx.code_chunks(F.col("text"))).alias("k", "x"))
    return rows.select("doc_id", "k", "x.first_line", "x.code")


@query(
    f"""SELECT ref, doc_id, tokens FROM (SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS ref, doc_id, greatest(1, n_chars // 4) AS tokens, sum(greatest(1, n_chars // 4)) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT * FROM documents ORDER BY n_chars, doc_id LIMIT 17)) WHERE running <= 2000"""
)
def budgeted_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The best rows whose tokens fit a budget, numbered for citation; the candidates are as many as the budget can hold."""
    budget = 2000
    rows = tables.documents(spark, sf).orderBy("n_chars", "doc_id").limit(records.over_fetch(budget)).select("doc_id", "n_chars", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).alias("tokens"))
    packed = records.packed_prefix(rows.withColumn("all", F.lit(0)), ["all"], [F.col("n_chars"), F.col("doc_id")], "tokens", budget)
    return packed.select(F.row_number().over(Window.orderBy("n_chars", "doc_id")).cast("long").alias("ref"), "doc_id", "tokens")
