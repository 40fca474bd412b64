"""Tables of a folder, and the knowledge model's views over them.

Documents have no title, tags or time of their own, so these are derived in one place: the tags are language and source, and a document is
ingested one minute after the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tasks_for


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text, lang, source, n_chars, title, tags, ingested_at``."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 60)
    return table(spark, folder, "documents").select("*", F.substring_index("text", "\n", 1).alias("title"), F.array("lang", "source").alias("tags"), at.alias("ingested_at"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the fields of notes: draft, sensitivity, updated_at, sent_at, doc_date, thread_id, participants, path, summary."""
    hours = lambda n: F.timestamp_micros(F.unix_micros("ingested_at") + n * 3_600_000_000)
    rows = documents(spark, folder).select(
        "*",
        (F.col("n_chars") < 200).alias("draft"),
        F.when(F.col("source").isin("src1", "src2"), "confidential").otherwise("normal").alias("sensitivity"),
        hours(F.col("n_chars") % 24).alias("updated_at"),
        F.when(F.col("lang") != "en", hours(F.lit(-24))).alias("sent_at"),
        F.concat_ws("-", "source", F.floor(F.col("n_chars") / 40).cast("string")).alias("thread_id"),
        F.slice(F.split(F.lower("title"), " ", 3), 1, 2).alias("participants"),
        F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".md")).alias("path"),
        F.when(F.col("n_chars") >= 1000, F.col("title")).alias("summary"),
    )
    return rows.withColumn("doc_date", F.coalesce("sent_at", "ingested_at"))


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as interactions: ``event_id, at, session_id, action, value, doc_id``; the document is the number in the event's properties."""
    return table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("session_id"), F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").cast("long").alias("doc_id"))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as documents that mention parts: ``doc_id, entity_id, mention_count``."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("entity_id")).agg(F.count("*").alias("mention_count"))


def mentions_by_document(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> DataFrame:
    """``mentions``, of some documents (``doc_id``) if given, in tasks of a bounded number of rows that each hold whole documents."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("entity_id"))
    spread = lines.repartition(tasks_for(lines.count(), spark), "doc_id")
    spread = spread if docs is None else spread.join(docs.select("doc_id"), "doc_id", "left_semi")
    return spread.groupBy("doc_id", "entity_id").agg(F.count("*").alias("mention_count"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as entities: ``entity_id, entity_type, name``."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("name"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """``id, vector, label`` with doubles."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
