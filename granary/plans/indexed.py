"""Queries over the stored fielded index: words or English lexemes, phrases, and hybrid search on lexemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemming
from ..operators import lexical_index, search
from ..sources import tables
from .registry import DOCS, query
from .retrieval import VECTOR, _query_vector


def _case(value: str, pairs: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


def _ends(suffixes: object) -> str:
    return f"regexp_extract(w, '({'|'.join(suffixes)})$', 1)"


_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_LIST = ", ".join(f"'{w}'" for w in stemming.STOP_WORDS)
_SHORT = "(([^aeiouy][aeiouy][^aeiouywxY])|(^[aeiouy][^aeiouy]))$"
#: ``word, lexeme`` of the distinct words of a relation ``words``, one step a common table.
STEMS = f"""q0 AS (SELECT DISTINCT word FROM words WHERE word NOT IN ({_LIST})),
q1 AS (SELECT word, {_case('word', stemming.OWN_STEMS)} AS own FROM q0),
q2 AS (SELECT word, own IS NOT NULL OR NOT regexp_matches(word, '^[a-z]{{3,}}$') AS done, CASE WHEN own IS NOT NULL OR NOT regexp_matches(word, '^[a-z]{{3,}}$') THEN coalesce(own, word) ELSE regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') END AS w FROM q1),
q3 AS (SELECT word, done, w, coalesce(nullif(length(regexp_extract(w, '^(gener|commun|arsen)')), 0), nullif(length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')), 0), length(w)) AS r1 FROM q2),
q4 AS (SELECT word, done, w, r1, r1 + coalesce(nullif(length(regexp_extract(w[r1 + 1:], '^.*?[aeiouy][^aeiouy]')), 0), length(w) - r1) AS r2 FROM q3),
q5 AS (SELECT *, {_ends(("sses", "ied", "ies", "us", "ss", "s"))} AS s FROM q4),
q6 AS (SELECT word, r1, r2, done, CASE WHEN done THEN w WHEN s = 'sses' THEN w[:-3] WHEN s IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END WHEN s = 's' AND regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w FROM q5),
q7 AS (SELECT * REPLACE (done OR w IN ({", ".join(f"'{w}'" for w in stemming.LEFT_ALONE)}) AS done), {_ends(("eedly", "eed", "edly", "ed", "ingly", "ing"))} AS s FROM q6),
q8 AS (SELECT *, left(w, length(w) - length(s)) AS b FROM q7),
q9 AS (SELECT word, r1, r2, done, CASE WHEN done OR s = '' THEN w WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN NOT regexp_matches(b, '[aeiouy]') THEN w WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
  WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN b[:-2] WHEN regexp_matches(b, '{_SHORT}') AND length(b) <= r1 THEN b || 'e' ELSE b END AS w FROM q8),
q10 AS (SELECT word, r1, r2, done, CASE WHEN NOT done AND regexp_matches(w, '^.+[^aeiouy][yY]$') THEN w[:-2] || 'i' ELSE w END AS w FROM q9),
q11 AS (SELECT *, {_ends(stemming.SECOND)} AS s FROM q10),
q12 AS (SELECT word, r1, r2, done, CASE WHEN NOT done AND s <> '' AND length(w) - length(s) >= r1 AND (s <> 'ogi' OR regexp_matches(w, 'logi$')) AND (s <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$')) THEN left(w, length(w) - length(s)) || {_case('s', stemming.SECOND)} ELSE w END AS w FROM q11),
q13 AS (SELECT *, {_ends(stemming.THIRD)} AS s FROM q12),
q14 AS (SELECT word, r1, r2, done, CASE WHEN NOT done AND s <> '' AND length(w) - length(s) >= r1 AND (s <> 'ative' OR length(w) - length(s) >= r2) THEN left(w, length(w) - length(s)) || {_case('s', stemming.THIRD)} ELSE w END AS w FROM q13),
q15 AS (SELECT *, {_ends(stemming.FOURTH)} AS s FROM q14),
q16 AS (SELECT word, r1, r2, done, CASE WHEN NOT done AND s <> '' AND length(w) - length(s) >= r2 AND (s <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN left(w, length(w) - length(s)) ELSE w END AS w FROM q15),
q17 AS (SELECT word, done, CASE WHEN NOT done AND ((right(w, 1) = 'e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(w[:-2], '{_SHORT}')))) OR (right(w, 2) = 'll' AND length(w) - 1 >= r2)) THEN w[:-2] ELSE w END AS w FROM q16),
stems AS (SELECT word, CASE WHEN done AND w NOT IN ({", ".join(f"'{w}'" for w in stemming.LEFT_ALONE)}) THEN w ELSE replace(w, 'Y', 'y') END AS lexeme FROM q17)"""
#: One row a document, field and word, with its place from 1.
HELD = f"""held AS MATERIALIZED (SELECT doc_id, field, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT doc_id, 'title' AS field, {_WORDS.format('title')} AS w FROM {DOCS}
UNION ALL SELECT doc_id, 'tags', {_WORDS.format("lang || ' ' || source")} FROM documents UNION ALL SELECT doc_id, 'content', {_WORDS.format('text')} FROM documents))"""
_WEIGHT = "CASE field WHEN 'title' THEN 1.0::DOUBLE WHEN 'tags' THEN 0.4 ELSE 0.2 END"


def _index(spark: SparkSession, sf: str, english: bool) -> lexical_index.TextIndex:
    docs = tables.documents(spark, sf).select("doc_id", "title", F.array_join("tags", " ").alias("tags"), F.col("text").alias("content"))
    return lexical_index.current(docs, f"{sf}/documents", ["doc_id"], ["title", "tags", "content"], english)


@query(
    f"""WITH {HELD} SELECT doc_id, score FROM (SELECT doc_id, count(DISTINCT CASE WHEN word IN ('en', 'the') THEN word END) AS n, bool_or(word = 'enthe') AS c, round(sum({_WEIGHT} * tf / (tf + 1)), 6) AS score
FROM (SELECT doc_id, field, word, count(*) AS tf FROM held WHERE word IN ('en', 'the', 'enthe') GROUP BY 1, 2, 3) GROUP BY 1) WHERE n = 2 OR c ORDER BY score DESC, doc_id LIMIT 50"""
)
def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a query in any fields of the stored index, without stemming."""
    return lexical_index.scores(_index(spark, sf, False), "En the!").orderBy(F.desc("score"), "doc_id").limit(50)


@query(
    f"""WITH {HELD} SELECT a.doc_id, a.field, count(*) AS n FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.field = b.field AND b.place = a.place + 1 AND a.word = 'of' AND b.word = 'the' GROUP BY 1, 2"""
)
def phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that hold words one after the other, by the index's positions."""
    return lexical_index.phrases(_index(spark, sf, False), "of the")


@query(f"WITH {HELD}, words AS (SELECT word FROM held), {STEMS} SELECT word, lexeme FROM stems")
def lexeme_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """English lexemes of all the words of all fields."""
    docs = tables.documents(spark, sf)
    parts = F.explode(F.concat(*map(stemming.words_of, (F.col("title"), F.array_join("tags", " "), F.col("text")))))
    return stemming.lexemes(docs.select(parts.alias("word")))


LEXEMES = f"{HELD}, words AS (SELECT word FROM held), {STEMS}, held_stems AS (SELECT doc_id, field, lexeme, place FROM held JOIN stems USING (word))"
MATCHED = f"""matched AS (SELECT doc_id, score FROM (SELECT doc_id, count(DISTINCT CASE WHEN lexeme IN ('orant', 'thon') THEN lexeme END) AS n, bool_or(lexeme = 'orantionsthon') AS c, round(sum({_WEIGHT} * tf / (tf + 1)), 6) AS score
FROM (SELECT doc_id, field, lexeme, count(*) AS tf FROM held_stems WHERE lexeme IN ('orant', 'thon', 'orantionsthon') GROUP BY 1, 2, 3) GROUP BY 1) WHERE n = 2 OR c)"""
ASKED = "Orantions thon"


@query(f"WITH {LEXEMES}, {MATCHED} SELECT doc_id, score FROM matched ORDER BY score DESC, doc_id LIMIT 50")
def stemmed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Lexemes of a query in any fields: other forms of its words match too."""
    return lexical_index.scores(_index(spark, sf, True), ASKED).orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"WITH {LEXEMES} SELECT a.doc_id, a.field, count(*) AS n FROM held_stems a JOIN held_stems b ON a.doc_id = b.doc_id AND a.field = b.field AND b.place = a.place + 2 AND a.lexeme = 'orant' AND b.lexeme = 'orant' GROUP BY 1, 2")
def stemmed_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase with a stop word in its middle, whose place may hold any word."""
    return lexical_index.phrases(_index(spark, sf, True), "orantion of orantions")


@query(
    f"""WITH {LEXEMES}, {MATCHED}, l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM matched ORDER BY score DESC, doc_id LIMIT 50)
SELECT id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score FROM (SELECT id, rank FROM l UNION ALL SELECT id, rank FROM {VECTOR} WHERE score >= 0.25) GROUP BY 1"""
)
def hybrid_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical leg on lexemes and the vector leg, fused."""
    vectors = tables.embeddings(spark, sf)
    lexical = search.top(lexical_index.scores(_index(spark, sf, True), ASKED), 50, "doc_id").select(F.col("doc_id").alias("id"), "rank")
    vector = search.vector_leg(vectors, _query_vector(vectors)).select("id", "rank")
    return search.fuse([(lexical, 1.0), (vector, 1.0)], "id").select("id", F.round("score", 9).alias("score"))
