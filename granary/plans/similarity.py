"""Near-duplicate and set-similarity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import near_dup_store, similarity
from ..sources.shared import stored
from ..sources import tables
from .registry import TOKENS, query

NEAR = f"""WITH words AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents) WHERE len(w) >= 50),
runs AS (SELECT doc_id, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS shingle FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
held AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM runs WHERE shingle IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(c.n / (x.n + y.n - c.n)::DOUBLE, 6) AS similarity FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE round(c.n / (x.n + y.n - c.n)::DOUBLE, 6) >= 0.85"""


@query(NEAR)
def near_dup_exact(spark: SparkSession, sf: str) -> DataFrame:
    sets, members = similarity.classes(similarity.shingled(tables.documents(spark, sf)))
    return similarity.expanded(similarity.exact_pairs(sets, 0.85), members)


@query(NEAR)
def near_dup_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures and bands find the pairs of different sets, full sets confirm them, and copies come back at the end."""
    sets, members = similarity.classes(similarity.shingled(tables.documents(spark, sf)))
    return similarity.expanded(similarity.verified(similarity.candidate_pairs(similarity.signatures(sets)), sets), members)


@query()
def near_dup_estimated(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs by the signatures' estimate."""
    sets, members = similarity.classes(similarity.shingled(tables.documents(spark, sf)))
    signed = stored(similarity.signatures(sets), "signatures")
    return similarity.expanded(similarity.estimated(similarity.candidate_pairs(signed), signed), members)


CLASSES = f"""WITH words AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents) WHERE len(w) >= 50),
runs AS (SELECT doc_id, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS shingle FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
every AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM runs WHERE shingle IS NOT NULL),
digests AS (SELECT doc_id, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS d FROM every GROUP BY 1),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY d) AS class_id, source || '-' || (doc_id % 3) AS thread FROM digests JOIN documents USING (doc_id)),
spread AS (SELECT class_id, min(thread) AS t1, max(thread) AS t2 FROM classes GROUP BY 1),
held AS (SELECT * FROM every WHERE doc_id IN (SELECT class_id FROM classes)),
sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b, round(c.n / (x.n + y.n - c.n)::DOUBLE, 6) AS similarity FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE round(c.n / (x.n + y.n - c.n)::DOUBLE, 6) >= 0.85)"""


def _state(spark: SparkSession, sf: str) -> near_dup_store.NearDupState:
    """A state of the documents as they were, with a hundredth of other texts and a hundredth missing, brought up to the documents as they are."""
    docs = tables.documents(spark, sf).select("doc_id", "text", F.concat_ws("-", "source", (F.col("doc_id") % 3).cast("string")).alias("thread"))
    old = F.when(F.col("doc_id") % 100 == 7, F.concat(F.lit("An earlier text of the same document. "), F.reverse("text"))).otherwise(F.col("text"))
    state = near_dup_store.started(spark)
    near_dup_store.updated(state, docs.withColumn("text", old).where("doc_id % 100 <> 13"))
    near_dup_store.updated(state, docs)
    return state


@query(f"{CLASSES} SELECT a, b, similarity FROM pairs JOIN spread x ON x.class_id = a JOIN spread y ON y.class_id = b WHERE NOT (x.t1 = x.t2 AND y.t1 = y.t2 AND x.t1 = y.t1)")
def near_dup_state(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of classes across threads, from a stored state that followed a change."""
    return near_dup_store.listing(_state(spark, sf))[0]


@query(f"{CLASSES} SELECT doc_id, class_id, thread FROM classes")
def near_dup_membership(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every document that is long enough, from the same state."""
    return near_dup_store.listing(_state(spark, sf))[1]


@query(
    """WITH t AS (SELECT o_custkey AS doc_id, unnest(list_distinct(list(o_orderpriority))) AS tag FROM orders GROUP BY 1), n AS (SELECT tag, count(*) AS n FROM t GROUP BY 1)
SELECT a.tag AS a, b.tag AS b, count(*) AS shared, round(count(*) / (min(x.n) + min(y.n) - count(*))::DOUBLE, 6) AS jaccard FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.tag < b.tag JOIN n x ON x.tag = a.tag JOIN n y ON y.tag = b.tag GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def tag_merge_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    tagged = tables.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_set("o_orderpriority").alias("tags"))
    return similarity.tag_pairs(tagged)


@query("SELECT a.r_name AS a, b.r_name AS b, round(1 - levenshtein(a.r_name, b.r_name) / greatest(length(a.r_name), length(b.r_name))::DOUBLE, 6) AS ratio FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def spelling_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling likeness of the few region names."""
    names = tables.table(spark, sf, "region")
    a, b = names.select(F.col("r_regionkey").alias("i"), F.col("r_name").alias("a")), names.select(F.col("r_regionkey").alias("j"), F.col("r_name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b", F.round(similarity.spelling_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_SAME = f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0"


@query(f"{_SAME} WHERE {_COS} >= 0.4")
def cosine_pairs_in_group(spark: SparkSession, sf: str) -> DataFrame:
    """The stated set of vectors with every vector of their group over a floor; groups are split, so that a hot one is no single task."""
    v = tables.embeddings(spark, sf)
    return similarity.cosine_to(v.where("id % 20 = 0"), v, "label", 0.4)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.4")
def cosine_pairs_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of every group's vectors over a floor, in blocks."""
    return similarity.cosine_pairs(tables.embeddings(spark, sf), "label", 0.4).select("a", "b", F.round("cosine", 6).alias("cosine"))
