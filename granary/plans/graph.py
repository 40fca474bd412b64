"""Entity graph queries over orders (documents) and parts (entities)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, links
from ..sources import tables
from ..sources.shared import tasks_for
from .registry import MENTIONS, query

PAIRS = f"(SELECT a.entity_id AS src, b.entity_id AS dst, sum(least(a.mention_count, b.mention_count)) AS co_count, count(DISTINCT a.doc_id) AS co_docs FROM {MENTIONS} a JOIN {MENTIONS} b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"
DF = f"(SELECT entity_id, count(DISTINCT doc_id) AS df FROM {MENTIONS} GROUP BY 1)"
LIFT = f"(SELECT src, dst, round(co_docs / least(x.df, y.df)::DOUBLE, 6) AS weight, co_docs FROM {PAIRS} p JOIN {DF} x ON x.entity_id = src JOIN {DF} y ON y.entity_id = dst)"
STRONG = f"(SELECT src, dst, weight FROM {LIFT} WHERE co_docs >= 2)"
BOTH = f"(SELECT src AS a, dst AS b, weight FROM {STRONG} UNION ALL SELECT dst, src, weight FROM {STRONG})"


def _strong(spark: SparkSession, sf: str) -> DataFrame:
    m = tables.mentions(spark, sf)
    return graph.lift_edges(graph.cooccurrence(m), graph.document_frequency(m)).where("co_docs >= 2")


@query(f"SELECT * FROM {PAIRS}")
def cooccur_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cooccurrence(tables.mentions(spark, sf))


@query(f"SELECT * FROM {DF}")
def entity_df(spark: SparkSession, sf: str) -> DataFrame:
    return graph.document_frequency(tables.mentions(spark, sf))


@query(f"SELECT * FROM {LIFT}")
def lift_edges(spark: SparkSession, sf: str) -> DataFrame:
    m = tables.mentions(spark, sf)
    return graph.lift_edges(graph.cooccurrence(m), graph.document_frequency(m))


@query(f"SELECT src, dst, weight FROM {LIFT} l JOIN {DF} x ON x.entity_id = src JOIN {DF} y ON y.entity_id = dst WHERE x.df <= (SELECT round_even(count(DISTINCT l_orderkey) * 0.002::DOUBLE, 0) FROM lineitem) AND y.df <= (SELECT round_even(count(DISTINCT l_orderkey) * 0.002::DOUBLE, 0) FROM lineitem)")
def generic_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """Edges without generic ends; the cap rounds half to even."""
    m = tables.mentions(spark, sf)
    cap = m.agg(graph.generic_cap(F.countDistinct("doc_id"), 0.002)).first()[0]
    return graph.lift_edges(graph.cooccurrence(m), graph.document_frequency(m), int(cap)).select("src", "dst", "weight")


@query(
    f"""WITH e AS (SELECT * FROM {BOTH} WHERE weight >= 0.03), one AS (SELECT b AS entity_id, max(weight) AS affinity, 1 AS hops FROM e WHERE a = 1 GROUP BY 1),
two AS (SELECT e.b, max(one.affinity * e.weight), 2 FROM one JOIN e ON e.a = one.entity_id GROUP BY 1), u AS (SELECT * FROM one UNION ALL SELECT * FROM two)
SELECT entity_id, round(max(affinity), 6) AS affinity, CAST(arg_min(hops, (-affinity, hops)) AS INTEGER) AS hops FROM u WHERE entity_id <> 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200"""
)
def traverse_2hop(spark: SparkSession, sf: str) -> DataFrame:
    seeds = tables.entities(spark, sf).where("entity_id = 1").select("entity_id")
    return graph.traverse(_strong(spark, sf), seeds, floor=0.03)


@query(f"SELECT b.entity_id, count(DISTINCT b.doc_id) AS docs FROM orders JOIN {MENTIONS} b ON b.doc_id = o_orderkey WHERE o_custkey = 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def person_scope(spark: SparkSession, sf: str) -> DataFrame:
    """A person's documents and the entities in them, strongest first, up to the model's cap."""
    own = tables.table(spark, sf, "orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("doc_id"))
    return tables.mentions(spark, sf).join(own, "doc_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("doc_id").alias("docs")).orderBy(F.desc("docs"), "entity_id").limit(50)


@query(
    f"""WITH m AS (SELECT * FROM {MENTIONS} WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_custkey < 20)), d AS (SELECT entity_id, count(*) AS df FROM m GROUP BY 1)
SELECT a.entity_id AS src, b.entity_id AS dst, least(1.0, round(count(*) / min(least(x.df, y.df))::DOUBLE, 6)) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id JOIN d x ON x.entity_id = a.entity_id JOIN d y ON y.entity_id = b.entity_id GROUP BY 1, 2"""
)
def in_scope_lift(spark: SparkSession, sf: str) -> DataFrame:
    scope = tables.table(spark, sf, "orders").where("o_custkey < 20").select(F.col("o_orderkey").alias("doc_id"))
    return graph.in_scope_edges(tables.mentions(spark, sf), scope).select("src", "dst", "weight")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, s_suppkey + 1000000 AS b FROM customer JOIN supplier ON s_nationkey = c_nationkey UNION SELECT s_suppkey + 1000000, c_nationkey FROM customer JOIN supplier ON s_nationkey = c_nationkey),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT CAST(node AS BIGINT) AS node, CAST(min(seen) AS BIGINT) AS component FROM r GROUP BY 1"""
)
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all suppliers and the nations where they have customers."""
    held = tables.table(spark, sf, "customer").select(F.col("c_nationkey").alias("s_nationkey")).distinct()
    links = tables.table(spark, sf, "supplier").join(held, "s_nationkey").select(F.col("s_nationkey").cast("long").alias("src"), (F.col("s_suppkey") + 1_000_000).alias("dst"))
    return graph.components(links)


@query()
def components_all(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all orders' customers and suppliers."""
    lines = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    lines = lines.repartition(tasks_for(lines.count(), spark), "l_orderkey")
    orders = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return graph.components(orders.join(lines, "l_orderkey").select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst")))


@query()
def louvain(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of parts by lift."""
    return graph.louvain(_strong(spark, sf))


@query(f"SELECT doc_id, round(sum(affinity), 6) AS score FROM {MENTIONS} JOIN (SELECT b AS entity_id, max(weight) AS affinity FROM {BOTH} WHERE a = 1 GROUP BY 1) USING (entity_id) GROUP BY 1")
def documents_by_entity_weight(spark: SparkSession, sf: str) -> DataFrame:
    near = graph.both_ways(_strong(spark, sf)).where("a = 1").groupBy(F.col("b").alias("entity_id")).agg(F.max("weight").alias("affinity"))
    return graph.documents_by_weight(tables.mentions(spark, sf), near)


@query(
    f"""WITH g AS (SELECT doc_id, row_number() OVER (ORDER BY count(*) DESC, doc_id) - 1 AS rank FROM {MENTIONS} WHERE entity_id IN (1, 2, 3) GROUP BY 1 ORDER BY count(*) DESC, doc_id LIMIT 50),
h AS (SELECT o_orderkey AS doc_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
SELECT doc_id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score FROM (SELECT * FROM g UNION ALL SELECT * FROM h) GROUP BY 1"""
)
def fuse_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A graph ranking and another ranking of documents, fused by document."""
    from ..operators import search

    a = search.top(tables.mentions(spark, sf).where(F.col("entity_id").isin(1, 2, 3)).groupBy("doc_id").agg(F.count("*").alias("score")), 50, "doc_id")
    b = search.top(tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score")), 50, "doc_id")
    return search.fuse([(a, 1.0), (b, 1.0)], "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH m AS (SELECT DISTINCT doc_id, entity_id FROM {MENTIONS}), n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1)
SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, round(count(*) / min(least(x.n, y.n))::DOUBLE, 6) AS affinity FROM m a JOIN m b ON a.entity_id = b.entity_id AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def doc_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.affinity(tables.mentions(spark, sf), 2)


@query(f"SELECT e.p_partkey AS entity_id FROM part e WHERE NOT EXISTS (SELECT 1 FROM {MENTIONS} m WHERE m.entity_id = e.p_partkey)")
def orphan_entities(spark: SparkSession, sf: str) -> DataFrame:
    return tables.entities(spark, sf).join(tables.mentions(spark, sf), "entity_id", "left_anti").select("entity_id")


@query("SELECT p_name AS name, count(DISTINCT p_type) AS types, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS all_types FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def cross_type_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Names that stand for several types."""
    return tables.entities(spark, sf).groupBy("name").agg(F.countDistinct("entity_type").alias("types"), F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("all_types")).where("types > 1")


@query(
    f"""SELECT 'entities' AS what, p_type AS name, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'edges', 'all', count(*) FROM {LIFT} UNION ALL
SELECT * FROM (SELECT 'top', CAST(entity_id AS VARCHAR), df FROM {DF} ORDER BY df DESC, entity_id LIMIT 10)"""
)
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = tables.mentions(spark, sf)
    df = graph.document_frequency(m)
    kinds = tables.entities(spark, sf).groupBy(F.col("entity_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), "name", "n")
    edges = graph.lift_edges(graph.cooccurrence(m), df).agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.lit("all").alias("name"), "n")
    best = df.orderBy(F.desc("df"), "entity_id").limit(10).select(F.lit("top").alias("what"), F.col("entity_id").cast("string").alias("name"), F.col("df").alias("n"))
    return kinds.unionByName(edges).unionByName(best)


@query(f"SELECT DISTINCT a.doc_id AS old_doc, b.doc_id AS new_doc FROM {MENTIONS} a JOIN orders o ON o.o_orderkey = a.doc_id AND o.o_custkey = 11 JOIN {MENTIONS} b ON a.entity_id = b.entity_id JOIN orders p ON p.o_orderkey = b.doc_id AND p.o_orderdate > o.o_orderdate")
def newer_documents_sharing(spark: SparkSession, sf: str) -> DataFrame:
    """Newer documents that share an entity with a person's documents."""
    dates = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderdate")
    m = tables.mentions(spark, sf).join(dates, "doc_id")
    old = m.where("o_custkey = 11").select(F.col("doc_id").alias("old_doc"), "entity_id", F.col("o_orderdate").alias("d0"))
    return old.join(m.select(F.col("doc_id").alias("new_doc"), "entity_id", F.col("o_orderdate").alias("d1")), "entity_id").where("d1 > d0").select("old_doc", "new_doc").distinct()


@query(f"SELECT CASE WHEN src = 5 THEN dst ELSE src END AS partner, sum(co_count) AS n FROM {PAIRS} WHERE src = 5 OR dst = 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def co_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The three strongest other ends of an entity's edges."""
    edges = graph.cooccurrence(tables.mentions(spark, sf)).where("src = 5 OR dst = 5")
    return edges.groupBy(F.when(F.col("src") == 5, F.col("dst")).otherwise(F.col("src")).alias("partner")).agg(F.sum("co_count").alias("n")).orderBy(F.desc("n"), "partner").limit(3)


@query(f"SELECT entity_id, min(o_orderdate) AS first_seen FROM {MENTIONS} JOIN orders ON o_orderkey = doc_id GROUP BY 1 HAVING min(o_orderdate) >= TIMESTAMP '1995-03-01'")
def new_entities(spark: SparkSession, sf: str) -> DataFrame:
    dated = tables.mentions(spark, sf).join(tables.table(spark, sf, "orders"), F.col("doc_id") == F.col("o_orderkey"))
    return dated.groupBy("entity_id").agg(F.min("o_orderdate").alias("first_seen")).where(F.col("first_seen") >= F.lit("1995-03-01").cast("timestamp"))


@query(f"SELECT entity_id, count(*) AS docs, bool_and(o_orderstatus <> 'P') AS settled FROM {MENTIONS} JOIN orders ON o_orderkey = doc_id GROUP BY 1 HAVING count(*) >= 25")
def having_min_docs(spark: SparkSession, sf: str) -> DataFrame:
    dated = tables.mentions(spark, sf).join(tables.table(spark, sf, "orders"), F.col("doc_id") == F.col("o_orderkey"))
    return dated.groupBy("entity_id").agg(F.count("*").alias("docs"), F.bool_and(F.col("o_orderstatus") != "P").alias("settled")).where("docs >= 25")


@query(f"SELECT date_trunc('quarter', o_orderdate) AS bucket, count(DISTINCT doc_id) AS docs, sum(mention_count) AS mentions FROM {MENTIONS} JOIN orders ON o_orderkey = doc_id GROUP BY 1")
def entity_timeline(spark: SparkSession, sf: str) -> DataFrame:
    dated = tables.mentions(spark, sf).join(tables.table(spark, sf, "orders"), F.col("doc_id") == F.col("o_orderkey"))
    return dated.groupBy(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("bucket")).agg(F.countDistinct("doc_id").alias("docs"), F.sum("mention_count").alias("mentions"))


@query(
    f"""SELECT src, dst, sum(c) AS co_count FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, c FROM (SELECT coalesce(x.t, src) AS a, coalesce(y.t, dst) AS b, co_count AS c FROM {PAIRS}
LEFT JOIN (SELECT 2 AS k, 1 AS t UNION ALL SELECT 4, 3) x ON x.k = src LEFT JOIN (SELECT 2 AS k, 1 AS t UNION ALL SELECT 4, 3) y ON y.k = dst) WHERE a <> b) GROUP BY 1, 2"""
)
def alias_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after aliases are applied: re-ordered, self loops dropped, counts summed."""
    alias = spark.createDataFrame([(2, 1), (4, 3)], "k long, t long")
    rows = graph.cooccurrence(tables.mentions(spark, sf))
    for end in ("src", "dst"):
        rows = rows.join(alias.toDF("k", f"_{end}"), F.col(end) == F.col("k"), "left").drop("k").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return rows.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("co_count").alias("co_count"))


@query(
    """WITH RECURSIVE l AS (SELECT n_nationkey AS a, n_regionkey + 1000 AS b FROM nation UNION SELECT n_regionkey + 1000, n_nationkey FROM nation), r AS (SELECT 3 AS node, 0 AS hops UNION SELECT l.b, r.hops + 1 FROM r JOIN l ON l.a = r.node WHERE r.hops < 2)
SELECT CAST(node AS BIGINT) AS node, min(hops) AS hops FROM r GROUP BY 1"""
)
def breadth_first(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes within two links of a nation."""
    links = tables.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 1000).cast("long").alias("dst"))
    return graph.breadth_first(links, 3, 2)


@query(f"SELECT entity_id, doc_id FROM (SELECT entity_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY mention_count DESC, entity_id) AS k FROM {MENTIONS}) WHERE k <= 2")
def entity_cap(spark: SparkSession, sf: str) -> DataFrame:
    return graph.capped_entities(tables.mentions(spark, sf), 2).select("entity_id", "doc_id")


@query(
    """WITH t AS (SELECT doc_id, i AS place, w FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n\\f]+'), lambda x: x <> '') AS ws FROM documents)) WHERE w IN ('the', 'of', 'der', 'que'))
SELECT least(a.w, b.w) AS src, greatest(a.w, b.w) AS dst, count(*) AS co_count FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.place - b.place BETWEEN 0 AND 3 AND a.w <> b.w GROUP BY 1, 2"""
)
def positional_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Names within three words of each other."""
    from ..functions.text import tokens

    names = spark.createDataFrame([(w, w) for w in ("the", "of", "der", "que")], "entity_id string, word string")
    return graph.positional_cooccurrence(tables.documents(spark, sf).select("doc_id", tokens(F.col("text")).alias("words")), names)


@query(
    f"""SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM (SELECT src, dst, round((weight + coalesce(price, 0)) / 2, 7) AS score FROM {STRONG} LEFT JOIN (
SELECT x.p_partkey AS src, y.p_partkey AS dst, round(1 - abs(x.p_retailprice - y.p_retailprice) / greatest(x.p_retailprice, y.p_retailprice), 6) AS price FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey) USING (src, dst)) WHERE score >= 0.04) WHERE k <= 5"""
)
def link_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Blend of the graph's affinity and that of prices within a brand (none elsewhere), with a floor, the best five of each."""
    strong = _strong(spark, sf)
    part = tables.table(spark, sf, "part")
    x, y = (part.select(F.col("p_partkey").alias(e), F.col("p_brand").alias(f"b_{e}"), F.col("p_retailprice").alias(f"v_{e}")) for e in ("src", "dst"))
    like = F.round(1 - F.abs(F.col("v_src") - F.col("v_dst")) / F.greatest("v_src", "v_dst"), 6)
    prices = strong.join(x, "src").join(y, "dst").where("b_src = b_dst").select("src", "dst", like.alias("affinity"))
    none = strong.where("false").select("src", "dst")
    return links.suggestions(strong.select("src", "dst", F.col("weight").alias("affinity")), prices, none, 0.04, 5)
