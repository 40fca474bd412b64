"""Usage, gap, timeline and engagement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..operators import usage
from ..sources import tables
from .registry import ACTS, query

AS_OF = f"(SELECT max(acted) AS as_of FROM {ACTS})"
AGE = "(date_diff('microsecond', acted, as_of) / 86400000000.0::DOUBLE)"


def _as_of(acts: DataFrame):
    return F.lit(acts.agg(F.max("at")).first()[0])


@query(
    f"""SELECT count(*) AS events, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'error') AS errors, count(DISTINCT session_id) AS sessions,
round(sum(value) FILTER (WHERE action = 'purchase'), 4) AS purchase_value, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) FILTER (WHERE action = 'view') AS view_p50,
percentile_disc(0.95) WITHIN GROUP (ORDER BY value) FILTER (WHERE action = 'view') AS view_p95 FROM {ACTS}"""
)
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return usage.totals(tables.interactions(spark, sf))


@query(f"SELECT CAST(CAST(acted AS DATE) AS VARCHAR) AS day, count(*) AS events, count(*) FILTER (WHERE action = 'error') AS errors, count(DISTINCT session_id) AS sessions FROM {ACTS} GROUP BY 1")
def usage_daily(spark: SparkSession, sf: str) -> DataFrame:
    return usage.daily(tables.interactions(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT session_id AS value, count(*) FILTER (WHERE action = 'view') AS searches, count(*) FILTER (WHERE action = 'click') AS clicks FROM {ACTS} WHERE action IN ('view', 'click') GROUP BY 1")
def usage_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    acts = tables.interactions(spark, sf)
    return usage.by_dimension({"searches": acts.where("action = 'view'"), "clicks": acts.where("action = 'click'")}, "session_id")


@query(f"SELECT action, round(sum(value), 4) AS payload, round(sum(value * 2), 4) AS baseline, round(1 - sum(value) / nullif(sum(value * 2), 0), 6) AS saved FROM {ACTS} GROUP BY 1")
def token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Payload and baseline sums over one population, and the rate saved; null without a baseline."""
    rows = tables.interactions(spark, sf).groupBy("action").agg(F.sum("value").alias("p"), F.sum(F.col("value") * 2).alias("b"))
    return rows.select("action", F.round("p", 4).alias("payload"), F.round("b", 4).alias("baseline"), F.round(1 - F.col("p") / F.nullif("b", F.lit(0.0)), 6).alias("saved"))


@query(f"SELECT doc_id, count(*) AS n FROM {ACTS} WHERE action = 'error' GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 20")
def failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty documents of most failures."""
    return tables.interactions(spark, sf).where("action = 'error'").groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


@query(f"SELECT a.event_id, a.session_id, a.doc_id FROM {ACTS} a WHERE a.action = 'view' AND a.session_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {ACTS} b WHERE b.action = 'click' AND b.session_id = a.session_id AND b.doc_id = a.doc_id AND b.acted > a.acted)")
def no_click_views(spark: SparkSession, sf: str) -> DataFrame:
    return usage.documents_without_later(tables.interactions(spark, sf), "view", "click").select("event_id", "session_id", "doc_id")


@query(f"SELECT session_id, count(*) AS n FROM {ACTS} a WHERE action = 'signup' AND CAST(acted AS DATE) = DATE '2024-01-05' AND NOT EXISTS (SELECT 1 FROM {ACTS} b WHERE b.session_id = a.session_id AND b.action = 'purchase' AND CAST(b.acted AS DATE) = DATE '2024-01-05') GROUP BY 1")
def no_purchase_sessions(spark: SparkSession, sf: str) -> DataFrame:
    day = tables.interactions(spark, sf).where(F.to_date("at") == F.lit("2024-01-05").cast("date"))
    return usage.sessions_without(day, "signup", "purchase")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1")
def timeline_month(spark: SparkSession, sf: str) -> DataFrame:
    return usage.timeline(tables.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "doc_id"), "o_orderdate", "month")


@query("SELECT strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS bucket, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1")
def timeline_quarter(spark: SparkSession, sf: str) -> DataFrame:
    return usage.timeline(tables.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "doc_id"), "o_orderdate", "quarter")


@query("SELECT strftime(o_orderdate, '%Y') AS bucket, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1")
def timeline_auto(spark: SparkSession, sf: str) -> DataFrame:
    """The coarsest granularity with three buckets."""
    rows = tables.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "doc_id")
    return usage.timeline(rows, "o_orderdate", usage.auto_granularity(rows, "o_orderdate"))


@query("SELECT bucket, n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) ORDER BY bucket DESC LIMIT 12")
def timeline_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    """The newest twelve buckets: the oldest are trimmed."""
    return timeline_month(spark, sf).orderBy(F.desc("bucket")).limit(12)


@query(
    f"""SELECT doc_id, round(greatest(0.8, least(1.25, 1 + 0.05 * ln(1 + opens) + 0.1 * (useful - irrelevant))), 6) AS multiplier FROM (
SELECT doc_id, sum(CASE WHEN action = 'view' AND {AGE} <= 30 THEN pow(0.5, greatest({AGE}, 0) / 30.0) ELSE 0 END) AS opens,
sum(CASE WHEN action = 'purchase' THEN 1.0::DOUBLE ELSE 0 END) AS useful, sum(CASE WHEN action = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS irrelevant FROM {ACTS}, {AS_OF} GROUP BY 1)"""
)
def engagement_rerank(spark: SparkSession, sf: str) -> DataFrame:
    acts = tables.interactions(spark, sf)
    return usage.engagement(acts, _as_of(acts)).select("doc_id", F.round("multiplier", 6).alias("multiplier"))


@query(f"SELECT doc_id, count(*) AS n, max(acted) AS last FROM {ACTS}, {AS_OF} WHERE acted > as_of - INTERVAL 7 DAY AND acted <= as_of GROUP BY 1")
def activity_per_document(spark: SparkSession, sf: str) -> DataFrame:
    acts = tables.interactions(spark, sf)
    return usage.trailing(acts, _as_of(acts), 7).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("at").alias("last"))


@query(f"SELECT doc_id, max(acted) AS last, round({AGE.replace('acted,', 'max(acted),').replace('as_of', 'max(as_of)')}, 6) AS age_days FROM {ACTS}, {AS_OF} GROUP BY 1")
def last_access(spark: SparkSession, sf: str) -> DataFrame:
    acts = tables.interactions(spark, sf)
    as_of = _as_of(acts)
    return acts.groupBy("doc_id").agg(F.max("at").alias("last")).withColumn("age_days", F.round(scores.age_days(as_of, F.col("last")), 6))


@query(
    f"""SELECT doc_id, round((1 - pow(0.5, greatest(age, 0) / 180.0)) * (1 - pow(0.5, greatest(seen, 0) / 90.0)) * (1 + 0.1 * 2 + 0.2 * 0), 6) AS score FROM (
SELECT d.doc_id, date_diff('microsecond', d.ingested_at, as_of) / 86400000000.0::DOUBLE AS age, date_diff('microsecond', a.last, as_of) / 86400000000.0::DOUBLE AS seen
FROM (SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS ingested_at FROM documents) d JOIN (SELECT doc_id, max(acted) AS last FROM {ACTS} GROUP BY 1) a USING (doc_id), {AS_OF})
ORDER BY 2 DESC, doc_id LIMIT 10"""
)
def resurface(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents that are due to be seen again."""
    acts = tables.interactions(spark, sf)
    as_of = _as_of(acts)
    last = acts.groupBy("doc_id").agg(F.max("at").alias("last"))
    rows = tables.documents(spark, sf).join(last, "doc_id")
    score = scores.resurface(scores.age_days(as_of, F.col("ingested_at")), scores.age_days(as_of, F.col("last")), F.size("tags"), F.lit(0))
    return rows.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(
    f"""SELECT session_id, min(acted) AS start, max(acted) AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY acted, event_id) AS run FROM (
SELECT *, CASE WHEN lag(acted) OVER (PARTITION BY session_id ORDER BY acted, event_id) IS NULL OR acted - lag(acted) OVER (PARTITION BY session_id ORDER BY acted, event_id) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS fresh FROM {ACTS})) GROUP BY session_id, run"""
)
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return usage.sessionised(tables.interactions(spark, sf), 60)


@query(f"SELECT date_trunc('day', acted) AS start, action, count(*) AS n, round(sum(value), 4) AS total FROM {ACTS} GROUP BY 1, 2")
def tumbling_daily(spark: SparkSession, sf: str) -> DataFrame:
    return tables.interactions(spark, sf).groupBy(F.window("at", "1 day").alias("w"), "action").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "action", "n", "total")


@query(f"SELECT doc_id, acted AS pinned_at FROM (SELECT doc_id, acted, row_number() OVER (PARTITION BY doc_id ORDER BY acted DESC, event_id) AS k FROM {ACTS} WHERE action = 'purchase') WHERE k = 1 ORDER BY acted DESC, doc_id LIMIT 10")
def pinned_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The latest pin of each document, ten newest."""
    acts = tables.interactions(spark, sf).where("action = 'purchase'")
    return acts.groupBy("doc_id").agg(F.max("at").alias("pinned_at")).orderBy(F.desc("pinned_at"), "doc_id").limit(10)


@query(
    f"""SELECT d.doc_id, count(a.event_id) AS views FROM documents d LEFT JOIN {ACTS} a ON a.doc_id = d.doc_id AND a.action IN ('view', 'click') GROUP BY 1"""
)
def left_join_extra_condition(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their views; the action filter stands in the join, so that documents without views stay."""
    acts = tables.interactions(spark, sf).where(F.col("action").isin("view", "click")).groupBy("doc_id").agg(F.count("*").alias("views"))
    return tables.documents(spark, sf).select("doc_id").join(acts, "doc_id", "left").select("doc_id", F.coalesce("views", F.lit(0)).alias("views"))


@query(
    f"""SELECT target, round(score / max(score) OVER (), 6) AS score FROM (SELECT target, sum(1.0::DOUBLE / (rank + 61)) AS score FROM (
SELECT target, row_number() OVER (PARTITION BY signal ORDER BY score / m DESC, target) - 1 AS rank FROM (SELECT *, max(score) OVER (PARTITION BY signal) AS m FROM (
SELECT action AS signal, doc_id AS target, count(*)::DOUBLE AS score FROM {ACTS} WHERE action IN ('error', 'view') GROUP BY 1, 2))) GROUP BY 1)"""
)
def gap_fusion(spark: SparkSession, sf: str) -> DataFrame:
    signals = tables.interactions(spark, sf).where(F.col("action").isin("error", "view")).groupBy(F.col("action").alias("signal"), F.col("doc_id").alias("target")).agg(F.count("*").cast("double").alias("score"))
    return usage.gap_fusion(signals).select("target", F.round("score", 6).alias("score"))


@query(f"SELECT action, session_id, n, extra FROM (SELECT action, session_id, count(*) AS n, row_number() OVER (PARTITION BY action ORDER BY count(*) DESC, session_id) AS k, greatest(count(*) OVER (PARTITION BY action) - 5, 0) AS extra FROM {ACTS} GROUP BY 1, 2) WHERE k <= 5")
def per_watch_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The first five of each group, with the number of the rest."""
    rows = tables.interactions(spark, sf).groupBy("action", "session_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("action")
    ranked = rows.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "session_id"))).withColumn("extra", F.greatest(F.count("*").over(w) - 5, F.lit(0)))
    return ranked.where("k <= 5").select("action", "session_id", "n", "extra")


@query(f"SELECT a.event_id, b.event_id AS other FROM {ACTS} a JOIN {ACTS} b ON a.session_id = b.session_id AND a.action = 'signup' AND b.action = 'purchase' AND b.acted >= a.acted AND b.acted < a.acted + INTERVAL 1 HOUR")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases within an hour after a sign-up of the same session, by hour bins and their next."""
    acts = tables.interactions(spark, sf)
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    a = acts.where("action = 'signup'").select("event_id", "session_id", F.col("at").alias("t0"), F.explode(F.array(hour("at"), hour("at") + 1)).alias("bin"))
    b = acts.where("action = 'purchase'").select(F.col("event_id").alias("other"), "session_id", F.col("at").alias("t1"), hour("at").alias("bin"))
    return a.join(b, ["session_id", "bin"]).where("t1 >= t0 AND unix_micros(t1) < unix_micros(t0) + 3600000000").select("event_id", "other")


@query(f"SELECT a.event_id, max_by(b.event_id, (b.acted, b.event_id)) AS previous FROM {ACTS} a JOIN {ACTS} b ON b.session_id = a.session_id AND a.action = 'purchase' AND b.action = 'view' AND b.acted <= a.acted GROUP BY 1")
def as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    """The last view before each purchase in its session, by one ordered pass over both."""
    acts = tables.interactions(spark, sf).where(F.col("action").isin("view", "purchase"))
    w = Window.partitionBy("session_id").orderBy("at", F.when(F.col("action") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = acts.withColumn("previous", F.last(F.when(F.col("action") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("action = 'purchase' AND previous IS NOT NULL").select("event_id", "previous")
