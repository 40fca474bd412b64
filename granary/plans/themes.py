"""Themes, communities and graph retrieval over orders (documents) and parts (entities)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import graph, search, themes
from ..sources import tables
from ..sources.shared import stored
from .graph import BOTH, DF, LIFT
from .registry import MENTIONS, query

SCOPE = "(SELECT o_orderkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT')"


def _strong(spark: SparkSession, sf: str) -> DataFrame:
    m = tables.mentions(spark, sf)
    return stored(graph.lift_edges(graph.cooccurrence(m), graph.document_frequency(m)).where("co_docs >= 2"), "lift")


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """``entity_id, name, key, df``."""
    df = graph.document_frequency(tables.mentions(spark, sf))
    return tables.entities(spark, sf).join(df, "entity_id", "left").select("entity_id", "name", F.lower(F.regexp_replace("name", " ", "")).alias("key"), F.coalesce("df", F.lit(0)).alias("df"))


@query()
def theme_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges on no cycle of the graph of strong lift, with the sizes of their sides."""
    return themes.bridges(_strong(spark, sf).where("weight >= 0.1"))


@query()
def theme_groups(spark: SparkSession, sf: str) -> DataFrame:
    """All ranked themes of the parts."""
    return themes.grouped(tables.entities(spark, sf), _strong(spark, sf), 0.1, 0.15)[1]


@query()
def theme_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The five best documents of the ten best themes."""
    groups = themes.grouped(tables.entities(spark, sf), _strong(spark, sf), 0.1, 0.15, 10)[0]
    return themes.theme_documents(groups, tables.mentions(spark, sf))


@query(
    f"""WITH e AS (SELECT entity_id, p_name AS name, lower(replace(p_name, ' ', '')) AS key, coalesce(df, 0) AS df FROM (SELECT p_partkey AS entity_id, p_name FROM part) LEFT JOIN {DF} USING (entity_id)),
t AS (SELECT *, CASE WHEN lower(name) = 'widget' OR key = 'widget' THEN 0 WHEN contains(lower(name), 'widget') OR contains(key, 'widget') THEN 1 END AS tier FROM e)
SELECT entity_id, name, df FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY df DESC, key, entity_id LIMIT 10"""
)
def seed_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Entities named by a query."""
    return themes.seeds(_named(spark, sf), " Widget ")


@query(
    f"""WITH e AS (SELECT * FROM {BOTH} WHERE weight >= 0.03), one AS (SELECT b AS entity_id, max(weight) AS a FROM e WHERE a = 1 GROUP BY 1),
two AS (SELECT e.b AS entity_id, max(one.a * e.weight) AS a FROM one JOIN e ON e.a = one.entity_id GROUP BY 1),
r AS (SELECT entity_id, round(max(a), 6) AS a FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE entity_id <> 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200)
SELECT doc_id, round(sum(a), 6) AS score FROM {MENTIONS} JOIN (SELECT * FROM r UNION ALL SELECT 1, 1.0) USING (entity_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
)
def local_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the weight of a seed entity and of what traversal reaches from it."""
    start = tables.entities(spark, sf).where("entity_id = 1")
    return themes.local_documents(_strong(spark, sf), tables.mentions(spark, sf), start, floor=0.03)


def _types(spark: SparkSession, sf: str) -> DataFrame:
    """Communities given by type: ``node, community``."""
    return tables.entities(spark, sf).select(F.col("entity_id").alias("node"), F.col("entity_type").alias("community"))


@query(f"SELECT p_type AS community, doc_id, sum(mention_count) AS n FROM part JOIN {MENTIONS} ON entity_id = p_partkey GROUP BY 1, 2")
def community_documents(spark: SparkSession, sf: str) -> DataFrame:
    return themes.community_documents(_types(spark, sf), tables.mentions(spark, sf)).select("community", "doc_id", "n")


@query(f"SELECT DISTINCT p_brand AS community FROM part JOIN {MENTIONS} ON entity_id = p_partkey JOIN orders ON o_orderkey = doc_id WHERE o_totalprice > 470000")
def community_taint(spark: SparkSession, sf: str) -> DataFrame:
    """Communities with a member in a confidential document."""
    labels = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    docs = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_totalprice") > 470000, "confidential").otherwise("normal").alias("sensitivity"))
    return themes.tainted(labels, tables.mentions(spark, sf), docs)


@query(
    f"""WITH s AS (SELECT p_type AS key, string_agg(p_name, ' ' ORDER BY p_partkey) AS summary, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1),
w AS (SELECT key, list_filter(string_split(lower(summary), ' '), lambda x: x <> '') AS ws, price FROM s),
f AS (SELECT key, row_number() OVER (ORDER BY n DESC, key) - 1 AS rank FROM (SELECT key, len(list_filter(ws, lambda x: x = 'part')) AS n FROM w) WHERE n > 0 ORDER BY n DESC, key LIMIT 50),
v AS (SELECT key, row_number() OVER (ORDER BY price DESC, key) - 1 AS rank FROM w ORDER BY price DESC, key LIMIT 50)
SELECT key, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM v) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
)
def global_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Communities by two rankings of their summaries (words, and a value in place of a vector), fused."""
    part = tables.table(spark, sf, "part")
    words = part.select(F.col("p_type").alias("key"), F.explode(F.split(F.lower("p_name"), " ")).alias("w")).where("w = 'part'").groupBy("key").agg(F.count("*").alias("score"))
    prices = part.groupBy(F.col("p_type").alias("key")).agg(F.round(F.avg("p_retailprice"), 6).alias("score"))
    fused = search.fuse([(search.top(words, 50, "key"), 1.0), (search.top(prices, 50, "key"), 1.0)], "key")
    return fused.select("key", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "key").limit(10)


@query(
    f"""WITH m AS (SELECT * FROM {MENTIONS} WHERE doc_id IN (SELECT doc_id FROM {SCOPE})), d AS (SELECT entity_id, count(*) AS df FROM m GROUP BY 1), cap AS (SELECT round_even(count(DISTINCT l_orderkey) * 0.02::DOUBLE, 0) AS cap FROM lineitem),
ok AS (SELECT entity_id FROM {DF}, cap WHERE df <= cap)
SELECT a.entity_id AS src, b.entity_id AS dst, least(1.0, round(count(*) / min(least(x.df, y.df))::DOUBLE, 6)) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id JOIN d x ON x.entity_id = a.entity_id JOIN d y ON y.entity_id = b.entity_id
WHERE a.entity_id IN (SELECT entity_id FROM ok) AND b.entity_id IN (SELECT entity_id FROM ok) GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def themes_scope_edges(spark: SparkSession, sf: str) -> DataFrame:
    """In-scope edges of a person-like scope; genericity is judged on the whole corpus."""
    m = tables.mentions(spark, sf)
    scope = tables.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("doc_id"))
    cap = m.agg(graph.generic_cap(F.countDistinct("doc_id"), 0.02)).first()[0]
    fine = graph.document_frequency(m).where(F.col("df") <= int(cap)).select("entity_id")
    edges = graph.in_scope_edges(m, scope).where("co_docs >= 2")
    return edges.join(fine.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(fine.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select("src", "dst", "weight")


@query(f"SELECT p_type AS community, count(*) AS members, sha256(string_agg(p_partkey::VARCHAR, chr(10) ORDER BY p_partkey::VARCHAR)) AS members_hash, any_value(e.edges) AS edges, any_value(e.total_weight) AS total_weight FROM part LEFT JOIN (SELECT x.p_type AS t, count(*) AS edges, round(sum(weight), 6) AS total_weight FROM {LIFT} l JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst AND y.p_type = x.p_type WHERE co_docs >= 2 GROUP BY 1) e ON e.t = p_type GROUP BY 1")
def community_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Members, inner edges, their weight and the members' hash of each type's parts."""
    return graph.community_metrics(_strong(spark, sf), _types(spark, sf)).select("community", "members", "members_hash", "edges", "total_weight")


@query(
    """WITH o AS (SELECT p_partkey AS node, CASE WHEN p_size > 45 THEN 'x' ELSE p_type END AS c FROM part), n AS (SELECT p_partkey AS node, p_type AS c FROM part),
s AS (SELECT o.c AS o, n.c AS c, count(*) AS k FROM o JOIN n USING (node) GROUP BY 1, 2), a AS (SELECT c, count(*) AS k FROM o GROUP BY 1), b AS (SELECT c, count(*) AS k FROM n GROUP BY 1),
j AS (SELECT s.o, s.c, round(s.k / (a.k + b.k - s.k)::DOUBLE, 6) AS jaccard FROM s JOIN a ON a.c = s.o JOIN b ON b.c = s.c)
SELECT c AS new_community, o AS old_community, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY jaccard DESC, o) AS x, row_number() OVER (PARTITION BY o ORDER BY jaccard DESC, c) AS y FROM j WHERE jaccard >= 0.5) WHERE x = 1 AND y = 1"""
)
def stable_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Communities that keep their identity between two builds."""
    part = tables.table(spark, sf, "part")
    old = part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") > 45, "x").otherwise(F.col("p_type")).alias("community"))
    return graph.stable_matches(old, _types(spark, sf))


@query(
    f"""WITH l AS (SELECT src, dst, weight, sha256(src || '|' || dst || '|' || format('{{:.6f}}', weight)) AS h FROM {LIFT} WHERE co_docs >= 2)
SELECT sha256(concat_ws('|', count(*), {', '.join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT), 0)::HUGEINT" for k in range(8))})) AS fingerprint FROM l"""
)
def graph_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return themes.fingerprint(_strong(spark, sf))


@query(
    "SELECT label, other, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, other) AS k FROM (SELECT a.label AS label, b.vec_id AS other, round(list_cosine_similarity(a.m, b.embedding::DOUBLE[]), 6) AS score FROM (SELECT label, list(m ORDER BY place) AS m FROM (SELECT label, place, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY 1, 2) GROUP BY 1) a JOIN embeddings b ON a.label <> b.label)) WHERE k <= 5"
)
def mean_vector_related(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's mean vector searched among the other labels' vectors, the five nearest."""
    from pyspark.sql.window import Window

    from ..operators.similarity import mean_vectors

    v = tables.embeddings(spark, sf)
    means = mean_vectors(v, "label").collect()  # a vector for each of ten labels
    near = F.explode(F.array(*[F.struct(F.lit(r.label).alias("label"), F.round(scores.cosine(F.col("vector"), F.array(*map(F.lit, r.vector))), 6).alias("score")) for r in means]))
    rows = v.select(F.col("id").alias("other"), F.col("label").alias("own"), near.alias("x")).where("x.label <> own").select("x.label", "other", "x.score")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "other"))).where("k <= 5").drop("k")
