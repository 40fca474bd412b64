"""Search by fields, explained results, stages, related documents, and merging of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import tokens
from ..operators import graph, merges, search, usage
from ..sources import tables
from ..sources.shared import stored
from .graph import DF, LIFT
from .registry import ACTS, DOCS, MENTIONS, TOKENS, query
from .retrieval import COSINE, LEXICAL, VECTOR, _lexical, _query_vector

FIELDS = f"""(SELECT doc_id, field, term, count(*) AS tf FROM (SELECT doc_id, 'title' AS field, unnest({TOKENS.replace('lower(text)', 'lower(title)')}) AS term FROM {DOCS} UNION ALL SELECT doc_id, 'tags', unnest([lang, source]) FROM documents
UNION ALL SELECT doc_id, 'content', unnest({TOKENS}) FROM documents) GROUP BY 1, 2, 3)"""


@query(
    f"""SELECT doc_id, score FROM (SELECT doc_id, count(DISTINCT CASE WHEN term IN ('en', 'the') THEN term END) AS n, bool_or(term = 'enthe') AS c, round(sum(CASE field WHEN 'title' THEN 1.0::DOUBLE WHEN 'tags' THEN 0.4 ELSE 0.2 END * tf / (tf + 1)), 6) AS score
FROM {FIELDS} WHERE term IN ('en', 'the', 'enthe') GROUP BY 1) WHERE n = 2 OR c ORDER BY 2 DESC, 1 LIMIT 50"""
)
def fts_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted fields under a plain query: all words in any field, or the compact spelling."""
    docs = tables.documents(spark, sf)
    index = search.field_index(docs, "doc_id", {"title": F.col("title"), "tags": F.array_join("tags", " "), "content": F.col("text")})
    return search.field_scores(index, "doc_id", "En the!").orderBy(F.desc("score"), "doc_id").limit(50)


LEX = f"(SELECT doc_id AS id, min(rank) AS rank, max(score) AS score FROM {LEXICAL} GROUP BY 1)"


def _legs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = tables.embeddings(spark, sf)
    lexical = _lexical(spark, sf).groupBy(F.col("doc_id").alias("id")).agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    return lexical, search.vector_leg(vectors, _query_vector(vectors))


@query(
    f"""SELECT coalesce(f.id, v.id) AS id, f.rank + 1 AS fts_rank, f.score AS fts_score, round(coalesce(1.0::DOUBLE / (61 + f.rank), 0), 9) AS fts_part, v.rank + 1 AS vec_rank, v.score AS vec_score, round(coalesce(1.0::DOUBLE / (61 + v.rank), 0), 9) AS vec_part,
round(coalesce(1.0::DOUBLE / (61 + f.rank), 0) + coalesce(1.0::DOUBLE / (61 + v.rank), 0), 9) AS score FROM {LEX} f FULL JOIN (SELECT * FROM {VECTOR} WHERE score >= 0.25) v ON f.id = v.id"""
)
def search_explained(spark: SparkSession, sf: str) -> DataFrame:
    return search.explained(*_legs(spark, sf), "id")


@query(f"SELECT (SELECT count(*) FROM {LEX}) AS fts_count, (SELECT count(*) FROM {VECTOR} WHERE score >= 0.25) AS vector_count, (SELECT count(*) FROM (SELECT id FROM {LEX} UNION SELECT id FROM {VECTOR} WHERE score >= 0.25)) AS total")
def search_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each leg and of both."""
    told = search.explained(*_legs(spark, sf), "id")
    return told.agg(F.count("fts_rank").alias("fts_count"), F.count("vec_rank").alias("vector_count"), F.count("*").alias("total"))


PIPED = f"""WITH r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT id, sum(1.0::DOUBLE / (61 + rank)) AS score FROM (SELECT id, rank FROM {LEX} UNION ALL SELECT id, rank FROM {VECTOR} WHERE score >= 0.25) GROUP BY 1) ORDER BY score DESC, id LIMIT 50),
m AS (SELECT doc_id AS id, greatest(0.8, least(1.25, 1 + 0.1 * (count(*) FILTER (WHERE action = 'purchase') - count(*) FILTER (WHERE action = 'error')))) AS m FROM {ACTS} GROUP BY 1)
SELECT id, row_number() OVER (ORDER BY round(coalesce(m, 1.0) / (rank + 61), 9) DESC, rank) - 1 AS rank FROM r LEFT JOIN m USING (id)"""


@query(f"SELECT * FROM ({PIPED}) WHERE rank < 10")
def search_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Search of the depth that the stages need, the engagement stage, and the first ten; a stage that can't be planned is left out."""
    acts = tables.interactions(spark, sf)
    count = lambda a: F.count_if(F.col("action") == a)
    multipliers = acts.groupBy(F.col("doc_id").alias("id")).agg(count("purchase").alias("u"), count("error").alias("i")).select("id", scores.engagement_multiplier(F.lit(0.0), F.col("u"), F.col("i")).alias("multiplier"))

    def found(n: int) -> DataFrame:
        lexical, vector = _legs(spark, sf)
        return search.top(search.fuse([(lexical, 1.0), (vector, 1.0)], "id"), n, "id").select("id", "rank")

    stages = [search.Stage("engagement", lambda n: max(50, search.engagement_reach(n)), lambda rows: search.engaged(rows, multipliers, "id")), search.Stage("broken", lambda n: n, lambda rows: rows.select("id", "rank", "no_such_column"))]
    return search.piped(found, stages, 10)


@query(f"SELECT *, true AS text_only FROM (SELECT id, rank FROM {LEX})")
def text_only_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search when the embedder can't be reached."""

    def embed():
        raise ConnectionError("no embedder")

    lexical, vector = _legs(spark, sf)
    return search.with_fallback(lambda v: (lexical if v is None else vector).select("id", "rank"), embed)


@query(
    f"""WITH r AS (SELECT id, rank, 1.0::DOUBLE / (61 + rank) AS score FROM {VECTOR}), s AS (SELECT e.vec_id AS id, {COSINE.replace('q.embedding', 'q.m')} AS side FROM embeddings e, (SELECT list(m ORDER BY place) AS m FROM (SELECT place, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings WHERE label = 0) GROUP BY 1)) q WHERE label < 5),
h AS (SELECT r.id, r.rank, s.side, row_number() OVER (PARTITION BY side IS NOT NULL ORDER BY rank) AS slot, CASE WHEN side IS NOT NULL THEN row_number() OVER (PARTITION BY side IS NOT NULL ORDER BY r.score * 0.5 + side * 0.5 DESC, r.id) ELSE row_number() OVER (PARTITION BY side IS NOT NULL ORDER BY rank) END AS want FROM r LEFT JOIN s USING (id))
SELECT a.id, b.rank FROM h a JOIN h b ON (a.side IS NULL) = (b.side IS NULL) AND a.want = b.slot"""
)
def document_vector_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Results with a document vector are sorted again among their own places by its cosine to a query's."""
    from ..operators.similarity import mean_vectors

    v = tables.embeddings(spark, sf)
    ranked = search.vector_leg(v, _query_vector(v), floor=None).select("id", scores.rrf(F.col("rank")).alias("score"), "rank")
    asked = F.array(*map(F.lit, mean_vectors(v.where("label = 0"), "label").first().vector))
    side = v.where("label < 5").select("id", F.round(scores.cosine(F.col("vector"), asked), 6).alias("score"))
    return search.slot_rerank(ranked, side, "id", 0.5).select("id", "rank")


@query(
    f"""WITH t AS (SELECT DISTINCT doc_id, unnest({TOKENS.replace('lower(text)', 'lower(title)')}) AS word FROM {DOCS}), c AS (SELECT word FROM t GROUP BY 1 HAVING count(*) <= greatest(2, floor((SELECT count(*) FROM documents) * 0.025::DOUBLE))), h AS (SELECT t.* FROM t JOIN c USING (word)),
l AS (SELECT doc_id, other, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, other) - 1 AS rank FROM (SELECT a.doc_id, b.doc_id AS other, count(*) AS n FROM h a JOIN h b ON a.word = b.word AND a.doc_id <> b.doc_id AND a.doc_id % 20 = 0 GROUP BY 1, 2)),
v AS (SELECT q.vec_id AS doc_id, e.vec_id AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) - 1 AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
SELECT doc_id, other, score FROM (SELECT doc_id, other, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score FROM (SELECT * FROM l WHERE rank < 10 UNION ALL SELECT * FROM v WHERE rank < 10) GROUP BY 1, 2) WHERE score >= 0.015"""
)
def related_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Related documents of the stated set, by title words that aren't common and by near vectors."""
    v = tables.embeddings(spark, sf)
    titles = tables.documents(spark, sf).select("doc_id", tokens(F.col("title")).alias("words"))
    near = search.nearest_neighbours(v.where("id % 20 = 0"), v, 10)
    return search.related(titles.where("doc_id % 20 = 0"), titles, near, floor=0.015)


ALIASES = "(SELECT p_partkey AS k, p_partkey + 1 AS t FROM part WHERE p_size = 7 AND p_partkey + 1 IN (SELECT p_partkey FROM part WHERE p_size <> 7))"


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    part = tables.table(spark, sf, "part")
    last = part.where("p_size <> 7").select(F.col("p_partkey").alias("t"))
    return part.where("p_size = 7").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") + 1).alias("t")).join(last, "t", "left_semi").select("k", "t")


@query(
    f"""SELECT doc_id, entity_id, CASE WHEN bool_or(source = 'people') THEN max(mention_count) ELSE sum(mention_count) END AS mention_count, CASE WHEN bool_or(source = 'people') THEN 'people' ELSE min(source) END AS source FROM (
SELECT doc_id, coalesce(t, entity_id) AS entity_id, mention_count, CASE WHEN doc_id % 2 = 0 THEN 'people' ELSE 'text' END AS source FROM {MENTIONS} LEFT JOIN {ALIASES} ON k = entity_id) GROUP BY 1, 2"""
)
def mention_merge(spark: SparkSession, sf: str) -> DataFrame:
    mentions = tables.mentions(spark, sf).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "people").otherwise("text"))
    return merges.repointed_mentions(mentions, _aliases(spark, sf))


@query(
    f"""WITH e AS (SELECT a.doc_id, a.entity_id AS src, b.entity_id AS dst, least(a.mention_count, b.mention_count) AS n FROM {MENTIONS} a JOIN {MENTIONS} b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id),
r AS (SELECT doc_id, least(s, d) AS src, greatest(s, d) AS dst, n FROM (SELECT doc_id, coalesce(x.t, src) AS s, coalesce(y.t, dst) AS d, n FROM e LEFT JOIN {ALIASES} x ON x.k = src LEFT JOIN {ALIASES} y ON y.k = dst) WHERE s <> d)
SELECT doc_id, src, dst, CASE WHEN src IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') AND dst IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') THEN max(n) ELSE sum(n) END AS n FROM r GROUP BY 1, 2, 3"""
)
def edge_merge(spark: SparkSession, sf: str) -> DataFrame:
    persons = tables.entities(spark, sf).where("entity_type = 'PROMO'").select("entity_id")
    return merges.repointed_edges(graph.contributions(tables.mentions(spark, sf)), _aliases(spark, sf), persons)


_TYPE = "CASE p_type WHEN 'ECONOMY' THEN 'topic' WHEN 'PROMO' THEN 'person' WHEN 'LARGE' THEN 'org' ELSE 'tool' END"


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.coalesce(F.create_map(*[F.lit(x) for x in ("ECONOMY", "topic", "PROMO", "person", "LARGE", "org")])[F.col("p_type")], F.lit("tool"))
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("key"), kind.alias("entity_type"))


@query(f"SELECT p_name AS key, arg_min({_TYPE}, CASE {_TYPE} WHEN 'person' THEN 1 WHEN 'org' THEN 2 WHEN 'topic' THEN 4 ELSE 5 END) AS entity_type, count(DISTINCT {_TYPE}) AS types FROM part GROUP BY 1")
def type_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest type of each name, and the number of its types."""
    return merges.one_type(_typed(spark, sf))


@query(f"SELECT k AS entity_id, t AS target FROM (SELECT p_partkey AS k, first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY CASE {_TYPE} WHEN 'person' THEN 1 WHEN 'org' THEN 2 WHEN 'topic' THEN 4 ELSE 5 END, p_partkey) AS t FROM part) WHERE k <> t")
def cross_type_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Merge rules: entities of one name go to that of the strongest type."""
    rows = _typed(spark, sf)
    best = rows.groupBy("key").agg(F.min(F.struct(merges.type_rank(F.col("entity_type")), "entity_id"))["entity_id"].alias("target"))
    return rows.join(best, "key").where("entity_id <> target").select("entity_id", "target")


@query(
    f"""SELECT key, name FROM (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY (upper(name) = name AND lower(name) <> name), length(regexp_replace(name, '[^A-Z]', '', 'g')) DESC, df DESC, length(name) DESC, name) AS k FROM (
SELECT p_name AS key, CASE WHEN p_size < 15 THEN upper(p_name) WHEN p_size < 30 THEN upper(p_name[1]) || substr(p_name, 2) ELSE p_name END AS name, coalesce(df, 0) AS df FROM part LEFT JOIN {DF} ON entity_id = p_partkey)) WHERE k = 1"""
)
def surface_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The best spelling of each name."""
    name = F.when(F.col("p_size") < 15, F.upper("p_name")).when(F.col("p_size") < 30, F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))).otherwise(F.col("p_name"))
    df = graph.document_frequency(tables.mentions(spark, sf)).withColumnRenamed("entity_id", "p_partkey")
    rows = tables.table(spark, sf, "part").join(df, "p_partkey", "left").select(F.col("p_name").alias("key"), name.alias("name"), F.coalesce("df", F.lit(0)).alias("df"))
    return merges.best_surface(rows)


_NAMES = "(SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN p_size < 15 THEN split_part(p_name, ' ', 2) ELSE p_name END AS name FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"SELECT DISTINCT a.doc_id, a.name FROM {_NAMES} a JOIN {_NAMES} b ON a.doc_id = b.doc_id AND a.name <> b.name AND contains(' ' || b.name || ' ', ' ' || a.name || ' ')")
def subsumed_names(spark: SparkSession, sf: str) -> DataFrame:
    """A document's names that stand inside a longer one of it."""
    name = F.when(F.col("p_size") < 15, F.element_at(F.split("p_name", " "), 2)).otherwise(F.col("p_name"))
    part = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), name.alias("name"))
    return merges.subsumed(tables.table(spark, sf, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("doc_id"), "name").distinct())


@query(
    f"""WITH c AS (SELECT doc_id, text, unnest({TOKENS}) AS name FROM documents), f AS (SELECT doc_id, name AS key, count(*) AS n FROM c WHERE length(name) >= 2 AND NOT regexp_full_match(name, '[0-9]+') AND contains(lower(text), lower(name)) GROUP BY 1, 2)
SELECT doc_id, key, n AS mention_count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, key) AS k FROM f) WHERE k <= 5"""
)
def entity_finalise(spark: SparkSession, sf: str) -> DataFrame:
    """The five most frequent words of each document as its entities, without noise."""
    words = merges.present(tables.documents(spark, sf).select("doc_id", "text"), "text", tokens(F.col("text")))
    raw = words.groupBy("doc_id", "name").agg(F.count("*").alias("mention_count")).select("doc_id", "name", F.col("name").alias("key"), F.lit("topic").alias("entity_type"), "mention_count")
    return merges.finalised(raw, 5).select("doc_id", "key", "mention_count")


@query(f"SELECT doc_id, entity_id, mention_count FROM {MENTIONS} JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus <> 'P' UNION ALL SELECT doc_id, entity_id, mention_count * 2 FROM {MENTIONS} JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus = 'P'")
def document_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions after some documents were read again."""
    m = tables.mentions_by_document(spark, sf)
    docs = tables.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"))
    return merges.rewritten(m, m.withColumn("mention_count", F.col("mention_count") * 2), docs)


@query(
    f"""WITH h AS (SELECT 'errors' AS search, doc_id FROM {ACTS} WHERE action = 'error' GROUP BY 2 UNION ALL SELECT 'purchases', doc_id FROM {ACTS} WHERE action = 'purchase' GROUP BY 2), seed AS (SELECT 'errors' AS search, doc_id FROM {ACTS} WHERE action = 'error' AND acted < TIMESTAMP '2024-01-05' GROUP BY 2)
SELECT h.search, h.doc_id, seed.doc_id IS NOT NULL AS seeded FROM h LEFT JOIN seed ON seed.search = h.search AND seed.doc_id = h.doc_id"""
)
def seeded_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of two saved searches; those of the seed run count as notified from the start."""
    acts = tables.interactions(spark, sf)
    hits = acts.where(F.col("action").isin("error", "purchase")).select(F.concat("action", F.lit("s")).alias("search"), "doc_id").distinct()
    seed = acts.where((F.col("action") == "error") & (F.col("at") < F.lit("2024-01-05").cast("timestamp"))).select(F.lit("errors").alias("search"), "doc_id").distinct()
    return usage.with_seed(seed, hits)


@query(f"SELECT doc_id, word FROM (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY ndoc DESC, nentry DESC, word) AS k FROM (SELECT doc_id, w AS word, count(*) AS nentry FROM (SELECT doc_id, unnest({TOKENS}) AS w FROM documents) GROUP BY 1, 2) JOIN (SELECT w AS word, count(DISTINCT doc_id) AS ndoc FROM (SELECT doc_id, unnest({TOKENS}) AS w FROM documents) GROUP BY 1) USING (word) WHERE ndoc <= 20) WHERE k <= 5")
def body_lexemes(spark: SparkSession, sf: str) -> DataFrame:
    """The five words of each document that most documents hold, of those that at most twenty do."""
    terms = search.inverted_index(tables.documents(spark, sf), ["doc_id"], "text")
    return search.top_terms(terms, 20, 5)


@query(f"SELECT 'entity' AS what, entity_id AS id, df AS n FROM {DF} JOIN part ON p_partkey = entity_id UNION ALL SELECT 'edges', 0, count(*) FROM {LIFT} l JOIN {DF} x ON x.entity_id = src JOIN {DF} y ON y.entity_id = dst WHERE greatest(x.df, y.df) <= (SELECT round_even(count(DISTINCT l_orderkey) * 0.02::DOUBLE, 0) FROM lineitem)")
def aggregate_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Document counts of the entities that are mentioned, and the number of edges between ones that aren't generic."""
    entities, edges = graph.refreshed(tables.entities(spark, sf), tables.mentions(spark, sf), 0.02)
    count = edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.lit(0).cast("long").alias("id"), "n")
    return entities.select(F.lit("entity").alias("what"), F.col("entity_id").alias("id"), F.col("doc_count").alias("n")).unionByName(count)


BUILT = f"""(SELECT doc_id, key, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, key) AS k FROM (SELECT doc_id, name AS key, count(*) AS n FROM (SELECT doc_id, text, unnest({TOKENS}) AS name FROM documents) WHERE length(name) >= 2 AND NOT regexp_full_match(name, '[0-9]+') AND contains(lower(text), lower(name)) GROUP BY 1, 2)) WHERE k <= 5)"""


@query(f"WITH m AS (SELECT * FROM {BUILT}), d AS (SELECT key, count(*) AS df FROM m GROUP BY 1) SELECT a.key AS src, b.key AS dst, round(count(*) / min(least(x.df, y.df))::DOUBLE, 6) AS weight, count(*) AS co_docs FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.key < b.key JOIN d x ON x.key = a.key JOIN d y ON y.key = b.key GROUP BY 1, 2 HAVING count(*) >= 2")
def graph_build(spark: SparkSession, sf: str) -> DataFrame:
    """From texts to edges: candidates, final entities, pairs by document, lift."""
    # five rows a document, that pairs and frequencies both read: the texts are read once
    mentions = stored(entity_finalise(spark, sf).select("doc_id", F.col("key").alias("entity_id"), "mention_count"), "mentions")
    return graph.lift_edges(graph.cooccurrence(mentions), graph.document_frequency(mentions)).where("co_docs >= 2")


@query(
    """WITH a AS (SELECT p_type AS s, p_partkey AS m FROM part WHERE p_size > 5), b AS (SELECT CASE WHEN p_size > 40 THEN 'other' ELSE p_type END AS s, p_partkey AS m FROM part), na AS (SELECT s, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT s, count(*) AS n FROM b GROUP BY 1),
j AS (SELECT a.s AS x, b.s AS y, count(*) / (min(na.n) + min(nb.n) - count(*))::DOUBLE AS j FROM a JOIN b USING (m) JOIN na ON na.s = a.s JOIN nb ON nb.s = b.s GROUP BY 1, 2 HAVING count(*) / (min(na.n) + min(nb.n) - count(*))::DOUBLE >= 0.5)
SELECT round(count(*) / (SELECT count(*) FROM na)::DOUBLE, 6) AS precision, round(count(*) / (SELECT count(*) FROM nb)::DOUBLE, 6) AS recall, round(2 * (count(*) / (SELECT count(*) FROM na)::DOUBLE) * (count(*) / (SELECT count(*) FROM nb)::DOUBLE) / ((count(*) / (SELECT count(*) FROM na)::DOUBLE) + (count(*) / (SELECT count(*) FROM nb)::DOUBLE)), 6) AS f1 FROM j"""
)
def theme_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Found themes against expected ones."""
    from ..operators.evaluation import set_matches

    part = tables.table(spark, sf, "part")
    actual = part.where("p_size > 5").select(F.col("p_type").alias("set_id"), F.col("p_partkey").alias("member"))
    expected = part.select(F.when(F.col("p_size") > 40, "other").otherwise(F.col("p_type")).alias("set_id"), F.col("p_partkey").alias("member"))
    return set_matches(actual, expected)
