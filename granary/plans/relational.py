"""Plain relational operators over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import records
from ..sources import tables
from .registry import query


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query("SELECT n_name, r_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def dimension_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension with its counts; nations without customers stay."""
    counts = tables.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    nations = tables.table(spark, sf, "nation").join(tables.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(counts, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("n", F.lit(0)).alias("customers"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_not_in(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "customer").join(tables.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n.n_nationkey, count(*) AS n FROM nation n JOIN (SELECT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey) e ON n.n_nationkey = e.a OR n.n_nationkey = e.b GROUP BY 1")
def or_condition_join(spark: SparkSession, sf: str) -> DataFrame:
    """Either end of an edge, as two ends of each edge without doubles."""
    edges = tables.table(spark, sf, "customer").join(tables.table(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    ends = edges.select(F.explode(F.array_distinct(F.array("c_nationkey", "s_nationkey"))).alias("n_nationkey"))
    return ends.join(tables.table(spark, sf, "nation"), "n_nationkey", "left_semi").groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, x.n_name AS name_a, y.n_name AS name_b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey JOIN nation x ON x.n_nationkey = a.s_nationkey JOIN nation y ON y.n_nationkey = b.s_nationkey")
def two_sided_join(spark: SparkSession, sf: str) -> DataFrame:
    s, n = tables.table(spark, sf, "supplier"), tables.table(spark, sf, "nation").select("n_nationkey", "n_name")
    a = s.select(F.col("s_suppkey").alias("a"), "s_nationkey").join(n.toDF("s_nationkey", "name_a"), "s_nationkey")
    b = s.select(F.col("s_suppkey").alias("b"), "s_nationkey").join(n.toDF("s_nationkey", "name_b"), "s_nationkey")
    return a.join(b, "s_nationkey").where("a < b").select("a", "b", "name_a", "name_b")


@query("SELECT CAST(coalesce(a.d, b.d) AS VARCHAR) AS day, coalesce(a.n, 0) AS ordered, coalesce(b.n, 0) AS shipped FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1) b ON a.d = b.d")
def full_outer_merge(spark: SparkSession, sf: str) -> DataFrame:
    a = tables.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("ordered"))
    b = tables.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("shipped"))
    return a.join(b, "day", "full_outer").select(F.col("day").cast("string").alias("day"), F.coalesce("ordered", F.lit(0)).alias("ordered"), F.coalesce("shipped", F.lit(0)).alias("shipped"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_three_per_key(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return tables.table(spark, sf, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey")
def distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of each order."""
    rows = tables.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    return rows.select("l_orderkey", "x.l_linenumber", "x.l_partkey")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS of_customer FROM orders")
def partition_count(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "orders").select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey")).alias("of_customer"))


@query("SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS total FROM orders WHERE o_orderstatus = 'P'")
def global_count(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with the count of all, as one joined row instead of one window."""
    orders = tables.table(spark, sf, "orders")
    return orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus", F.lit(orders.count()).cast("long").alias("total"))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).union(tables.table(spark, sf, "customer").select("c_custkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(tables.table(spark, sf, "orders").select("o_custkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(tables.table(spark, sf, "lineitem").where("l_quantity > 48").select("l_partkey"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping_id(o_orderpriority, o_orderstatus) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE year(o_orderdate) = 1996) AS y1996, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS y1997 FROM orders GROUP BY 1")
def pivot_years(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")).groupBy("o_orderstatus").pivot("year", [1996, 1997]).count()
    return rows.select("o_orderstatus", F.coalesce("1996", F.lit(0)).alias("y1996"), F.coalesce("1997", F.lit(0)).alias("y1997"))


@query("SELECT r.status, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) r(status) LEFT JOIN (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1) USING (status)")
def zero_filled_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Known kinds with zero rows stay."""
    counts = tables.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string").join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def array_agg_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("SELECT o_custkey, o_orderkey, o_orderdate - lag(o_orderdate) OVER w > INTERVAL 365 DAY AS long_gap, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS status_rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_ranks(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gap = F.datediff("o_orderdate", F.lag("o_orderdate").over(w)) > 365
    return tables.table(spark, sf, "orders").select("o_custkey", "o_orderkey", gap.alias("long_gap"), F.ntile(4).over(w).cast("long").alias("quarter"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")).cast("long").alias("status_rank"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders")
def moving_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return tables.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("last_three"))


@query("SELECT c_custkey, c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE k <= 10")
def people_roster(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent people."""
    top = tables.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_custkey").limit(10)
    return tables.table(spark, sf, "customer").join(top, "c_custkey").select("c_custkey", "c_name", "n")


@query("SELECT id, text, collections FROM (SELECT c_custkey AS id, arg_min(c_name, c_custkey) AS text, list_sort(list_distinct(list(c_mktsegment))) AS collections FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_name, 'ARCHIVE' FROM customer WHERE c_acctbal > 5000) GROUP BY 1)")
def merged_posts(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.array("c_mktsegment").alias("collections"), F.lit(0).alias("seq"))
    more = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.array(F.lit("ARCHIVE")).alias("collections"), F.lit(1).alias("seq"))
    return records.merged_posts(rows.unionByName(more))


@query("SELECT url, visits, first, last, title, b AS bookmarked FROM (SELECT 'u' || o_custkey AS url, sum(o_orderkey % 3) AS visits, min(o_orderdate) AS first, max(o_orderdate) AS last, max_by(o_orderpriority, (o_orderdate, o_orderpriority)) AS title, bool_or(o_orderstatus = 'P' AND o_totalprice > 400000) AS b FROM orders GROUP BY 1) WHERE b OR visits >= 12")
def merged_visits(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "orders").select(F.concat(F.lit("u"), "o_custkey").alias("url"), (F.col("o_orderkey") % 3).alias("visits"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("title"), ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)).alias("bookmarked"))
    return records.merged_visits(rows, 12)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'confidential' ELSE 'normal' END AS sensitivity, CASE WHEN c_acctbal < 0 THEN ['a', 'b'] WHEN c_acctbal > 9000 THEN ['b'] ELSE ['a'] END AS tags FROM customer")
def merge_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows, with updates of some: tags are united, sensitivity only rises, and drafts are ignored."""
    c = tables.table(spark, sf, "customer")
    common = [F.col("c_name").alias("text"), F.lit(None).cast("string").alias("summary")]
    stored = c.where("c_acctbal <= 9000").select(F.col("c_custkey").alias("id"), F.array(F.lit("a")).alias("tags"), F.lit(False).alias("draft"), F.lit("normal").alias("sensitivity"), *common)
    new = c.where("c_acctbal < 0 OR c_acctbal > 9000 OR c_acctbal BETWEEN 100 AND 200").select(F.col("c_custkey").alias("id"), F.array(F.lit("b")).alias("tags"), F.col("c_acctbal").between(100, 200).alias("draft"), F.when(F.col("c_acctbal") < 0, "confidential").otherwise("normal").alias("sensitivity"), *common)
    return records.merged_documents(stored, new).select(F.col("id").alias("c_custkey"), "sensitivity", "tags")
