"""Structured Streaming counterparts: continuous queries, day rollups, sessions, drop folders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

LATE = "1 hour"


def stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def daily_rollup(events: DataFrame, at: str = "at", late: str = LATE) -> DataFrame:
    """Tumbling days with late rows up to a watermark: ``day, action, n, total``."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), "action").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("date").alias("day"), "action", "n", "total")


def sliding_counts(events: DataFrame, width: str, step: str, at: str = "at", late: str = LATE) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width, step).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def sessions(events: DataFrame, gap: str, key: str = "session_id", at: str = "at", late: str = LATE) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def new_hits(documents: DataFrame, searches: list[tuple[str, Column]], key: str = "doc_id", at: str = "updated_at", late: str = LATE) -> DataFrame:
    """``search, doc_id``: each saved search's hits, each once however often its document comes again inside the watermark."""
    names = F.filter(F.array(*[F.when(where, F.lit(name)) for name, where in searches]), lambda x: x.isNotNull())
    return documents.withWatermark(at, late).select(F.explode(names).alias("search"), key, at).dropDuplicatesWithinWatermark(["search", key])


def remembered_hits(documents: DataFrame, searches: list[tuple[str, Column]], key: str = "doc_id") -> DataFrame:
    """``search, doc_id``: each saved search's hits, each once however late its document comes again.

    The state keeps every hit (two values each) and no watermark drops late documents; ``new_hits`` is for streams whose state must stay bounded.
    """
    names = F.filter(F.array(*[F.when(where, F.lit(name)) for name, where in searches]), lambda x: x.isNotNull())
    return documents.select(F.explode(names).alias("search"), key).dropDuplicates(["search", key])


def recorded_hits(hits: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Append hits to a ledger table (folders by stream and batch); a hit that the ledger has stays as it is.

    A batch that runs again replaces its own folder only, so that it changes nothing, and another stream's batches are all known to it.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("search", "doc_id").dropDuplicates()
        if _exists(spark, ledger):
            schema = f"search {rows.schema['search'].dataType.simpleString()}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, run string, batch long"
            known = spark.read.schema(schema).parquet(ledger).where((F.col("run") != run) | (F.col("batch") != number))
            rows = rows.join(known, ["search", "doc_id"], "left_anti")
        rows.write.mode("overwrite").parquet(f"{ledger}/run={run}/batch={number}")

    return hits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).limit(1).count()
    except AnalysisException:
        return False
    return True


def dropped_files(spark: SparkSession, folder: str, late: str = "30 days") -> DataFrame:
    """``path, sha256, content`` of files put into a folder, one for equal contents inside the watermark."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"]).select("path", "sha256", "content")


def debounced(changes: DataFrame, quiet_seconds: int, late: str = "10 seconds") -> DataFrame:
    """``path, kind, at``: the last change of each path after a quiet gap.  ``changes`` has path, kind, at."""
    ready = changes.withWatermark("at", late)
    return ready.groupBy(F.session_window("at", f"{quiet_seconds} seconds"), "path").agg(F.max(F.struct("at", "kind")).alias("x")).select("path", "x.kind", "x.at")


def latest_per_key(changes: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``key, at, value`` updates: a key's newest value so far, held as explicit state; rows older than the state emit nothing."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        best = None
        for frame in frames:
            row = frame.sort_values("at").iloc[-1]
            best = row if best is None or row["at"] > best["at"] else best
        if best is not None and (known is None or best["at"].value > known[0]):
            state.update((best["at"].value,))
            yield pd.DataFrame({"key": [k[0]], "at": [best["at"]], "value": [best["value"]]})

    rows = changes.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, at timestamp, value double", "at long", "update", "NoTimeout")
