"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import ranges, search, vector_index
from ..operators.predicates import search_predicate
from ..sources import tables
from .registry import DOCS, TOKENS, query

TERMS = ["the", "of"]
CHUNKS = "(SELECT doc_id, i - 1 AS chunk_index, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(content) <> '')"
_TF = TOKENS.replace("lower(text)", "lower(content)").replace("x <> ''", "x = '{0}'")
SCORED = f"(SELECT *, round(a / (a + 1.0) + b / (b + 1.0), 6) AS score FROM (SELECT *, len({_TF.format('the')}) AS a, len({_TF.format('of')}) AS b FROM {CHUNKS}) WHERE a > 0 AND b > 0)"
LEXICAL = f"(SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) - 1 AS rank FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) AS n FROM {SCORED}) WHERE n <= 3 ORDER BY score DESC, doc_id, chunk_index LIMIT 50))"
COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
VECTOR = f"(SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT e.vec_id AS id, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 50))"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return search.chunks(tables.documents(spark, sf))


def _query_vector(vectors: DataFrame, key: int = 0) -> Column:
    return F.array(*map(F.lit, vectors.where(F.col("id") == key).first().vector))


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, chunk_index, score`` of the chunks that hold all terms, from the stored index."""
    index = search.stored_index(_chunks(spark, sf), ["doc_id", "chunk_index"], "content", f"{sf}/documents chunks")
    return search.index_scores(index, ["doc_id", "chunk_index"], TERMS)


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(search.cap_per_document(_matched(spark, sf)), 50, "doc_id", "chunk_index")


@query(f"SELECT doc_id, chunk_index, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) - 1 AS rank FROM {SCORED}) WHERE rank < 50")
def fts_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(_matched(spark, sf), 50, "doc_id", "chunk_index").select("doc_id", "chunk_index", "score", "rank")


@query(f"SELECT doc_id, chunk_index, score, rank FROM {LEXICAL}")
def fts_doc_cap(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf).select("doc_id", "chunk_index", "score", "rank")


@query(f"SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM {SCORED}")
def match_total(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


@query(f"SELECT id, score, rank FROM {VECTOR}")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = tables.embeddings(spark, sf)
    return search.vector_leg(vectors, _query_vector(vectors), floor=None)


@query(f"SELECT id, score, rank FROM {VECTOR} WHERE score >= 0.25")
def vector_floor(spark: SparkSession, sf: str) -> DataFrame:
    vectors = tables.embeddings(spark, sf)
    return search.vector_leg(vectors, _query_vector(vectors))


HYBRID = f"""(SELECT doc_id, chunk_index, sum(part) AS score FROM (
  SELECT doc_id, chunk_index, 1.0::DOUBLE / (rank + 61) AS part FROM {LEXICAL}
  UNION ALL SELECT id, 0, 1.0::DOUBLE / (rank + 61) FROM {VECTOR} WHERE score >= 0.25) GROUP BY 1, 2)"""


@query(
    f"""SELECT doc_id, chunk_index, round(score * pow(0.5, greatest(date_diff('microsecond', ingested_at, as_of) / 86400000000.0::DOUBLE, 0) / 180.0), 9) AS score
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) AS n FROM {HYBRID}) WHERE n = 1)
JOIN {DOCS} USING (doc_id), (SELECT max(ingested_at) AS as_of FROM {DOCS}) ORDER BY 3 DESC, doc_id LIMIT 10"""
)
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical and vector legs, fused by chunk, the best chunk for its document, then recency."""
    docs, vectors = tables.documents(spark, sf), tables.embeddings(spark, sf)
    key = F.struct("doc_id", "chunk_index").alias("chunk")
    lexical = _lexical(spark, sf).select(F.struct("doc_id", F.col("chunk_index").cast("long").alias("chunk_index")).alias("chunk"), "rank")
    vector = search.vector_leg(vectors, _query_vector(vectors)).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("chunk_index"), "rank").select(key, "rank")
    best = search.best_chunk(search.fuse([(lexical, 1.0), (vector, 1.0)], "chunk").select("chunk.*", "score"))
    as_of = F.lit(docs.agg(F.max("ingested_at")).first()[0])
    dated = search.with_recency(best.join(docs.select("doc_id", "ingested_at"), "doc_id"), "ingested_at", as_of)
    return dated.select("doc_id", "chunk_index", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(
    f"SELECT key, round(sum(w / (rank + 61)), 9) AS score FROM (SELECT doc_id AS key, min(rank) AS rank, 1.0::DOUBLE AS w FROM {LEXICAL} GROUP BY 1 UNION ALL SELECT id, rank, 0.5::DOUBLE FROM {VECTOR}) GROUP BY 1"
)
def rewrite_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted fusion of two rankings of documents."""
    vectors = tables.embeddings(spark, sf)
    a = _lexical(spark, sf).groupBy(F.col("doc_id").alias("key")).agg(F.min("rank").alias("rank"))
    b = search.vector_leg(vectors, _query_vector(vectors), floor=None).select(F.col("id").alias("key"), "rank")
    return search.fuse([(a, 1.0), (b, 0.5)], "key").select("key", F.round("score", 9).alias("score"))


@query(
    f"SELECT doc_id, round(pow(0.5, (date_diff('microsecond', ingested_at, as_of) / 86400000000.0::DOUBLE) / 180.0), 6) AS decay FROM {DOCS}, (SELECT max(ingested_at) AS as_of FROM {DOCS})"
)
def recency_decay(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    as_of = F.lit(docs.agg(F.max("ingested_at")).first()[0])
    return docs.select("doc_id", F.round(scores.decay(scores.age_days(as_of, F.col("ingested_at")), 180.0), 6).alias("decay"))


@query(
    f"""SELECT facet, value, count(DISTINCT doc_id) AS n FROM (
  SELECT doc_id, 'source' AS facet, source AS value FROM documents WHERE doc_id IN (SELECT doc_id FROM {SCORED})
  UNION ALL SELECT doc_id, 'lang', lang FROM documents WHERE doc_id IN (SELECT doc_id FROM {SCORED})
  UNION ALL SELECT doc_id, 'tag', unnest([lang, source]) FROM documents WHERE doc_id IN (SELECT doc_id FROM {SCORED})) GROUP BY 1, 2"""
)
def facets(spark: SparkSession, sf: str) -> DataFrame:
    matched = tables.documents(spark, sf).join(_matched(spark, sf).select("doc_id").distinct(), "doc_id", "left_semi")
    return search.facets(matched, {"source": F.array("source"), "lang": F.array("lang"), "tag": F.col("tags")})


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def facet_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).rollup("lang", "source").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n")


@query(
    f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) AS k FROM {SCORED}) WHERE k = 1)
SELECT b.doc_id, string_agg(c.content, chr(10) ORDER BY c.chunk_index) AS snippet FROM b JOIN {CHUNKS} c ON c.doc_id = b.doc_id AND c.chunk_index BETWEEN b.chunk_index - 2 AND b.chunk_index + 2 GROUP BY 1"""
)
def snippet_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return search.snippet(_chunks(spark, sf), search.best_chunk(_matched(spark, sf)))


@query(
    f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5"
)
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of every vector of the stated query set."""
    vectors = tables.embeddings(spark, sf)
    return search.nearest_neighbours(vectors.where("id % 20 = 0"), vectors, 5).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5"
)
def knn_join_twentieth(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    vectors = tables.embeddings(spark, sf)
    return search.nearest_neighbours(vectors.where("id % 20 = 0"), vectors, 5).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id AND {COSINE} >= 0.3) WHERE rank <= 5"
)
def adaptive_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors over a floor of the stated query set, by an index whose search widens until no unread cell can hold more."""
    vectors = tables.embeddings(spark, sf)
    return vector_index.adaptive(vector_index.built(vectors), vectors.where("id % 20 = 0"), 5, 0.3)


@query()
def approximate_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors of the stated query set in three quarters of the index's cells; of vectors this evenly spread fewer hold too little."""
    vectors = tables.embeddings(spark, sf)
    index = vector_index.built(vectors)
    return vector_index.approximate(index, vectors.where("id % 20 = 0"), 5, max(1, index.cells.count() * 3 // 4))


@query(
    f"SELECT label, max({COSINE}) AS best FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 GROUP BY 1 HAVING max({COSINE}) >= 0.1"
)
def exhaustive_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The best cosine of each group, with a floor."""
    vectors = tables.embeddings(spark, sf)
    scored = vectors.where("id <> 0").select("label", F.round(scores.cosine(F.col("vector"), _query_vector(vectors)), 6).alias("s"))
    return scored.groupBy("label").agg(F.max("s").alias("best")).where("best >= 0.1")


@query(
    f"""SELECT doc_id, lang, score FROM (SELECT DISTINCT ON (doc_id) doc_id, score FROM {SCORED} ORDER BY doc_id, score DESC) JOIN {DOCS} USING (doc_id)
WHERE lang = 'en' AND list_contains(tags, 'src1') AND ingested_at >= TIMESTAMP '2024-01-01 01:00:00'"""
)
def filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical leg under the shared predicate; the filter runs before the texts are split."""
    docs = tables.documents(spark, sf).where(search_predicate(kind="en", tag="src1", after="2024-01-01 01:00:00"))
    best = search.lexical_scores(search.chunks(docs), TERMS).groupBy("doc_id").agg(F.max("score").alias("score"))
    return best.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "score")


@query(f"SELECT label AS id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS square, len(v) AS places FROM (SELECT label, list(m ORDER BY place) AS v FROM (SELECT label, place, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY 1, 2) GROUP BY 1)")
def mean_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The mean vector of each group, by its squared length."""
    from ..operators.similarity import mean_vectors as mean

    rows = mean(tables.embeddings(spark, sf), "label")
    return rows.select(F.col("label").alias("id"), F.round(scores.dot(F.col("vector"), F.col("vector")), 6).alias("square"), F.size("vector").cast("long").alias("places"))


@query(
    "SELECT word, ndoc, nentry FROM (SELECT word, count(DISTINCT doc_id) AS ndoc, count(*) AS nentry FROM (SELECT doc_id, unnest(" + TOKENS + ") AS word FROM documents) GROUP BY 1) ORDER BY ndoc DESC, nentry DESC, word LIMIT 100"
)
def lexeme_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred words of most documents."""
    terms = search.inverted_index(tables.documents(spark, sf), ["doc_id"], "text")
    return terms.groupBy(F.col("term").alias("word")).agg(F.count("*").alias("ndoc"), F.sum("tf").alias("nentry")).orderBy(F.desc("ndoc"), F.desc("nentry"), "word").limit(100)


@query(
    """WITH r AS (SELECT label, vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS rank, 1.0::DOUBLE / (61 + row_number() OVER (ORDER BY vec_id) - 1) AS score FROM embeddings),
s AS (SELECT id, CASE WHEN label < 5 THEN label / 10.0::DOUBLE END AS side FROM embeddings e JOIN r USING (label) WHERE e.vec_id = r.id),
h AS (SELECT r.id, r.rank, r.score, s.side, row_number() OVER (PARTITION BY side IS NOT NULL ORDER BY rank) AS slot,
  CASE WHEN side IS NOT NULL THEN row_number() OVER (PARTITION BY side IS NOT NULL ORDER BY r.score * 0.5 + side * 0.5 DESC, r.id) ELSE row_number() OVER (PARTITION BY side IS NOT NULL ORDER BY rank) END AS want FROM r JOIN s USING (id))
SELECT a.id, b.rank FROM h a JOIN h b ON (a.side IS NULL) = (b.side IS NULL) AND a.want = b.slot"""
)
def slot_preserving_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a second score are re-sorted among their own slots."""
    rows = tables.embeddings(spark, sf).select("id", "label")
    ranked = ranges.numbered(rows, [], [F.col("id")]).withColumn("rank", F.col("k") - 1).drop("k").withColumn("score", scores.rrf(F.col("rank")))
    side = ranked.where("label < 5").select("id", (F.col("label") / 10.0).alias("score"))
    return search.slot_rerank(ranked.select("id", "score", "rank"), side, "id", 0.5).select("id", "rank")
