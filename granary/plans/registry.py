"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: SQL of the document view that ``sources.tables.documents`` makes.
DOCS = "(SELECT doc_id, text, lang, source, n_chars, split_part(text, chr(10), 1) AS title, [lang, source] AS tags, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS ingested_at FROM documents)"
#: SQL of the view that ``sources.tables.notes`` makes.
NOTES = f"""(SELECT *, coalesce(sent_at, ingested_at) AS doc_date FROM (SELECT *, n_chars < 200 AS draft, CASE WHEN source IN ('src1', 'src2') THEN 'confidential' ELSE 'normal' END AS sensitivity,
ingested_at + to_hours(CAST(n_chars % 24 AS INTEGER)) AS updated_at, CASE WHEN lang <> 'en' THEN ingested_at - INTERVAL 24 HOUR END AS sent_at, source || '-' || (n_chars // 40) AS thread_id,
list_slice(string_split(lower(title), ' '), 1, 2) AS participants, source || '/' || lang || '/' || doc_id || '.md' AS path, CASE WHEN n_chars >= 1000 THEN title END AS summary FROM {DOCS}))"""
#: SQL of the interaction view.
ACTS = "(SELECT event_id, ts AS acted, user_id AS session_id, event_type AS action, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id FROM events)"
#: SQL of the mention view.
MENTIONS = "(SELECT l_orderkey AS doc_id, l_partkey AS entity_id, count(*) AS mention_count FROM lineitem GROUP BY 1, 2)"
#: SQL of a text's tokens.
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n\\f]+'), lambda x: x <> '')"
