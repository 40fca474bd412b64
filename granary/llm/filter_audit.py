"""Audit of document filters in all their orders, from a stream that retracts what later rows prove wrong.

All files pass as available-now micro-batches.  Four filters look at a row alone; the fifth drops a text that a smaller id has too, which no row
can tell by itself.  State keyed by the text, in buckets of keys, holds the smallest id so far and the counters its rows stand in: a smaller id that arrives later
takes them back and puts them among the duplicates.  Every batch writes the sum of its changes under its own number, so a repeated batch replaces
itself, and the report is made of the sums alone.

A copied text would send all its rows to one task, so each task first merges the rows of a text: only those of the smallest id there can matter
to the state, the others are duplicates whatever comes.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .shared import bounded_batches, deleted_at_exit, shared_folder, stash

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
#: Micro-batches that the files are dealt to, rows that a task merges at once, and texts of a bucket of states.
BATCHES, MERGED_ROWS, TEXTS = 4, 1 << 16, 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "part string, cell int, n long"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (null: empty) fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def bits(words: Column) -> Column:
        n = F.size(words)
        capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        fails = [n < 50, 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
        return sum((fails[k].cast("int") * (1 << k) for k in range(1, 4)), fails[0].cast("int"))

    return F.get(F.transform(F.array(words), bits), F.lit(0))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one text as those of its smallest id; the others, as certain duplicates, and rows without an id lose their id and are counted."""

    def merge(rows: pa.Table) -> pa.RecordBatch:
        d = rows.to_pandas()
        least = d.groupby("key")["id"].transform("min")
        past = d["id"].notna() & (d["id"] > least)
        d.loc[past, "cell"] |= DUPLICATE
        d["id"] = d["id"].where(~past).astype("Int64")
        d.loc[d["id"].isna(), "key"] = d["key"].iloc[0]  # counted only, under any key
        d = d.groupby(["key", "id", "part", "cell"], dropna=False, sort=False, as_index=False)["n"].sum()
        return pa.RecordBatch.from_pandas(d, rows.schema, preserve_index=False)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= MERGED_ROWS:
            yield merge(pa.Table.from_batches(held))
            held = []
    if sum(b.num_rows for b in held):
        yield merge(pa.Table.from_batches(held))


def _changes(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by the new rows of a bucket's texts.

    The state has, for each text's key, the smallest id so far and the counters of its rows: ``key: [id, [[part, cell, n], ...]]``.
    """
    fresh: dict[str, list[tuple]] = {}
    out: Counter[tuple[str, int]] = Counter()
    for f in frames:
        for key, i, part, cell, n in zip(*(f[c].tolist() for c in ("key", "id", "part", "cell", "n"))):
            if i is None or i != i:  # counted only
                out[part, cell] += n
            else:
                fresh.setdefault(key, []).append((int(i), part, int(cell), n))
    if fresh:
        known = json.loads(state.get[0]) if state.exists else {}
        for key, rows in fresh.items():
            old, held = known.get(key, (None, []))
            least = min(r[0] for r in rows) if old is None else min(old, *(r[0] for r in rows))
            if old is not None and least < old:
                for part, cell, n in held:
                    out[part, cell] -= n
                    out[part, cell | DUPLICATE] += n
                held = []
            for i, part, cell, n in rows:
                out[part, cell | (0 if i == least else DUPLICATE)] += n
            known[key] = (least, held + [r[1:] for r in rows if r[0] == least])
        state.update((json.dumps(known),))
    yield pd.DataFrame([(part, cell, n) for (part, cell), n in out.items() if n], columns=["part", "cell", "n"])


def file_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """A stream of the Parquet files of ``path``, a folder or one file, in about as many micro-batches as asked for."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches)))
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # streams read folders
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def counters(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 12, provider: str | None = None) -> DataFrame:
    """``part, mask, good, toxic, n``: rows of a stream of documents (doc_id integer, text, source) by the filters they fail.

    The texts' states lie in ``buckets`` by their keys, as calls of Python cost more than their work; about ``TEXTS`` texts a bucket are fine.
    ``provider`` names the class that stores states, such as ``ROCKSDB`` for more texts than the executors' memory holds (about 150 bytes a text);
    without one it is the session's own.

    A null source is the empty string, a null text an empty one.  A row without an id is no duplicate and makes none.  Rows of the smallest id
    of a text, repeated ones too, are no duplicates.  Several labels of an id count as the best quality and the worst toxicity, missing or null
    ones as neither.  Other columns are ignored; an empty stream gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg((one("quality") * GOOD + one("toxic") * TOXIC).alias("flags"))
    flags = stash(flags.where("flags > 0"), "flags")
    text = F.coalesce("text", F.lit(""))
    # a checksum of 256 bits is the text's key
    rows = docs.select(F.sha2(text.cast("binary"), 256).alias("key"), F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), failures(F.col("text")).alias("mask"))
    rows = rows.join(flags, "id", "left").select("key", "id", "part", (F.col("mask") + F.coalesce("flags", F.lit(0))).alias("cell"), F.lit(1).cast("long").alias("n"))
    merged = rows.mapInArrow(_merged, "key string, id long, part string, cell int, n long").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    changes = merged.groupBy("bucket").applyInPandasWithState(_changes, CHANGES, "known string", "update", GroupStateTimeout.NoTimeout)

    place = f"{shared_folder(spark)}/granary/audit-{uuid.uuid4().hex}"
    deleted_at_exit(spark, place)
    spark.createDataFrame([], CHANGES).write.parquet(f"{place}/changes/batch=-1")

    def add(batch: DataFrame, k: int) -> None:
        batch.groupBy("part", "cell").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{place}/changes/batch={k}")

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, provider or before)
    try:
        stream = changes.writeStream.outputMode("update").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).foreachBatch(add).start()
    finally:
        spark.conf.set(setting, before)
    stream.awaitTermination()
    found = spark.read.schema(CHANGES).parquet(f"{place}/changes").groupBy("part", "cell").agg(F.sum("n").alias("n")).where("n <> 0")
    bit = lambda b: F.col("cell").bitwiseAND(F.lit(b)) != 0
    return found.select("part", F.col("cell").bitwiseAND(F.lit(GOOD - 1)).alias("mask"), bit(GOOD).alias("good"), bit(TOXIC).alias("toxic"), "n")


def report(counted: DataFrame) -> DataFrame:
    """One row a part, filter order and step: rows kept, removed, redundant, failing this filter only, good and toxic ones lost, and the filter's removals over all orders.

    A part's 32 masks are one row of sums, and each figure is a fold over them.  No counters give no rows.
    """
    masks = range(1 << len(FILTERS))
    sums = lambda of: F.array(*[F.coalesce(F.sum(F.when(of & (F.col("mask") == m), F.col("n"))), F.lit(0)).cast("long") for m in masks])
    parts = counted.groupBy("part").agg(sums(F.lit(True)).alias("n"), sums(F.col("good")).alias("good"), sums(F.col("toxic")).alias("toxic"))
    steps = []
    for order in map("".join, itertools.permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            here = 1 << FILTERS.index(name)
            steps.append({"filter_order": order, "step": step, "before": before, "here": here})
            before |= here
    each = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,here:int>>")).alias("s")
    rows = parts.select("*", each).select("part", "s.*", "n", "good", "toxic")
    fails = lambda m, bits: m.bitwiseAND(F.col(bits)) != 0

    def total(of: str, which, times=lambda m: F.lit(1).cast("long")) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(masks) - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(which(m), F.get(F.col(of), m) * times(m)).otherwise(F.lit(0).cast("long")))

    here = lambda m: fails(m, "here")
    removed = lambda m: here(m) & ~fails(m, "before")
    orders = len(steps) // len(FILTERS)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~here(m) & ~fails(m, "before")).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: here(m) & fails(m, "before")).alias("redundant"),
        F.get("n", F.col("here")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # of a row that fails k filters, each comes first in one k-th of the orders
        total("n", here, lambda m: F.floor(F.lit(orders) / F.bit_count(m))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """The report of a stream of about so many documents."""
    return report(counters(docs, labels, max(1, rows // TEXTS)))
