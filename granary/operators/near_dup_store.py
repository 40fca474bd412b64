"""Stored near-duplicate state: changed texts alone are shingled, signed and probed against band folders.

Copies are one class, by a digest of their shingles, and everything after that is a matter of classes: signatures, bands, sets and pairs.  Pairs
are of classes, never of all their documents; a listing leaves out pairs whose documents all lie in one thread.  Folders of a state:

* ``members``: each document's class, thread and checksum, one version an update;
* ``sets``: the changed documents with their classes and the band keys of their sets, one segment an update, written by the task that reads the text;
* ``bands``: the band keys of every class that came, one segment an update;
* ``pairs``: classes over the threshold, one segment an update.  A class without members stays, and is probed again if its text comes back.

Shingles aren't stored: those of candidates are made again from the texts, as each class that counts has a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.shared import folder_for, stored
from . import similarity

#: Documents (or band keys) that are broadcast at most, so that what they are found in isn't exchanged, and candidates of a side that meet at once.
AT_ONCE, HELD = 1 << 20, 256


@dataclass
class NearDupState:
    spark: SparkSession
    folder: str
    least: float = 0.85
    least_words: int = similarity.LEAST_WORDS
    updates: int = 0


def started(spark: SparkSession, least: float = 0.85, least_words: int = similarity.LEAST_WORDS) -> NearDupState:
    return NearDupState(spark, folder_for(spark, "near-dups"), least, least_words)


MEMBERS = "doc_id long, thread string, checksum string, class binary"


def _read(state: NearDupState, name: str, schema: str) -> DataFrame:
    return state.spark.read.schema(schema).parquet(f"{state.folder}/{name}")


def members(state: NearDupState) -> DataFrame:
    """``doc_id, thread, checksum, class``: a null class has too few words."""
    return state.spark.read.schema(MEMBERS).parquet(f"{state.folder}/members/version={state.updates}")


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= AT_ONCE else rows


def _shingles(words: str, least_words: int) -> Column:
    """Sorted shingles; null with too few words."""
    return F.when(F.size(words) >= least_words, F.array_sort(similarity.hashed_runs(words)))


def updated(state: NearDupState, docs: DataFrame) -> dict[str, int]:
    """Bring the state up to ``doc_id, text, thread`` (ids unique, whole, not null; null texts are empty), and say how many texts and classes were new.

    Only documents whose text changed are read in full, and what they give is written where it is read; no text is exchanged.  Only classes that no
    document had before are kept by band, and they meet only the rows of their own band keys.
    """
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("thread").cast("string").alias("thread"))
    checksum = F.sha2(F.col("text").cast("binary"), 256).alias("checksum")
    kept, changed, version = None, now, state.updates + 1
    if state.updates:
        # checksums are compared without texts
        before = members(state)
        same = F.coalesce(F.col("checksum") == F.col("_before"), F.lit(False)).alias("same")
        compared = now.select("doc_id", "thread", checksum).join(before.select("doc_id", F.col("checksum").alias("_before"), "class"), "doc_id", "left")
        compared = stored(compared.select("doc_id", "thread", "checksum", "class", same), "compared")
        kept, moved = compared.where("same").drop("same"), compared.where("NOT same").select("doc_id")
        changed = now.join(_few(moved, moved.count()), "doc_id", "left_semi")
    digest = F.unhex(F.substring(F.sha2(F.array_join("shingles", " ").cast("binary"), 256), 1, 32)).alias("class")  # 128 bits
    rows = changed.select("doc_id", "thread", checksum, tokens(F.col("text")).alias("words")).select("doc_id", "thread", "checksum", _shingles("words", state.least_words).alias("shingles"))
    n = similarity.BAND_ROWS
    keys = F.array(*[F.xxhash64(F.lit(k), F.slice("signature", k * n + 1, n)) for k in range(similarity.BANDS)])
    signed = similarity.signatures(rows.select("doc_id", "shingles", "thread", "checksum", digest), kept=["thread", "checksum", "class"])
    _write(signed.select("doc_id", "thread", "checksum", "class", F.when(F.col("class").isNotNull(), keys).alias("bands")), f"{state.folder}/sets/segment={version}")
    fresh = _read(state, "sets", f"{MEMBERS}, bands array<long>, segment int").where(F.col("segment") == version)
    every = fresh.select("doc_id", "thread", "checksum", "class")
    _write(every if kept is None else kept.unionByName(every), f"{state.folder}/members/version={version}")

    held = fresh.where(F.col("class").isNotNull())
    new = held.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    if state.updates:
        new = new.join(before.select("class"), "class", "left_anti")
    new = stored(new.select("doc_id"), "new")
    counts = {"texts": held.count(), "classes": new.count()}
    few = counts["classes"] * similarity.BANDS
    _write(held.join(_few(new, counts["classes"]), "doc_id", "left_semi").select("class", F.explode("bands").alias("band")), f"{state.folder}/bands/segment={version}")

    # new classes against all classes of their bands: the rest of a band hangs on few of them, so nothing pairs old with old
    bands = _read(state, "bands", "class binary, band long, segment int").select("band", "class", (F.col("segment") == version).alias("new"))
    if state.updates:
        bands = bands.join(_few(bands.where("new").select("band"), few), "band", "left_semi")
    bands = bands.repartition("band")
    over = Window.partitionBy("band")
    shared = bands.withColumn("_n", F.count("*").over(over)).withColumn("_new", F.max("new").over(over)).where("_n > 1 AND _new").select("band", "class", "new")
    x, y = shared.where("new").select("band", F.col("class").alias("x")), shared.select("band", F.col("class").alias("y"), "new")
    pairs = x.join(y, "band").where((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & ~F.col("new")))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    state.updates = version
    _write(_verified(state, pairs, now), f"{state.folder}/pairs/segment={version}")
    return counts


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _verified(state: NearDupState, pairs: DataFrame, now: DataFrame) -> DataFrame:
    """``a, b, similarity`` of candidate classes ``a, b`` whose full sets reach the threshold; a pair needs a document of each class.

    Candidates that hang on one another share a cell, and a set is sent once to each of its cells, however many of their pairs it is in; a cell of
    many documents is dealt to parts of about ``HELD`` of them a side.
    """
    alive = members(state).where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("id"))
    pairs = stored(pairs, "candidates")
    of = stored(alive.join(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class", "left_semi"), "candidate-ids")
    i, j = (of.select(F.col("class").alias(c), F.col("id").alias(f"i{c}")) for c in "ab")
    pairs = stored(pairs.join(i, "a").join(j, "b"), "candidate-pairs")
    both = F.explode(F.array("ia", "ib"))
    label = pairs.select(both.alias("ia"), F.least("ia", "ib").alias("cell")).groupBy("ia").agg(F.min("cell").alias("cell"))
    celled = pairs.join(label, "ia")
    sized = celled.select("cell", both.alias("doc_id")).distinct().groupBy("cell").agg(F.ceil(F.count("*") / HELD).cast("int").alias("_parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("_parts")).cast("int")
    celled = stored(celled.join(sized, "cell").select("a", "b", "ia", "ib", F.struct(F.col("cell").alias("c"), part("ia").alias("i"), part("ib").alias("j")).alias("cell")), "candidate-cells")
    cells = stored(celled.select(both.alias("doc_id"), "cell").groupBy("doc_id").agg(F.collect_set("cell").alias("cells")), "cells-of")
    texts = now.join(_few(cells, cells.count()), "doc_id").select("doc_id", "cells", tokens(F.col("text")).alias("words"))
    sets = texts.select("doc_id", "cells", _shingles("words", state.least_words).alias("shingles")).select("doc_id", "shingles", F.explode("cells").alias("cell"))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        lists = y["shingles"].combine_chunks() if y.num_rows else None
        held = {d: lists[k].values.to_numpy() for k, d in enumerate(y["doc_id"].to_pylist())}
        p, q = ([held[d] for d in x[c].to_pylist()] for c in ("ia", "ib"))
        common = [len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(p, q)]
        every = [len(u) + len(v) - n for u, v, n in zip(p, q, common)]
        return pa.table({"a": x["a"], "b": x["b"], "common": pa.array(common, pa.int64()), "every": pa.array(every, pa.int64())})

    key = ["c", "i", "j"]
    left, right = celled.select("cell.*", "a", "b", "ia", "ib"), sets.select("cell.*", "doc_id", "shingles")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "a binary, b binary, common long, every long")
    return found.select("a", "b", F.round(F.col("common") / F.col("every"), 6).alias("similarity")).where(F.col("similarity") >= state.least)


def listing(state: NearDupState) -> tuple[DataFrame, DataFrame]:
    """``a, b, similarity``: pairs of classes by their smallest documents, a < b, and ``doc_id, class_id, thread``: every document's class.

    Only classes with members count, and only pairs with documents of different threads; a null thread is no one's.
    """
    alive = members(state).where(F.col("class").isNotNull())
    # two threads are enough to tell; a document without a thread is a thread of its own
    thread = F.coalesce("thread", F.concat(F.lit("\0"), F.col("doc_id").cast("string")))
    classes = alive.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min(thread).alias("t1"), F.max(thread).alias("t2"))
    pairs = _read(state, "pairs", "a binary, b binary, similarity double, segment int").select("a", "b", "similarity").distinct()
    x, y = (classes.select(F.col("class").alias(k), F.col("class_id").alias(f"i{k}"), F.col("t1").alias(f"t{k}"), F.col("t2").alias(f"u{k}")) for k in "ab")
    joined = pairs.join(x, "a").join(y, "b").where(~((F.col("ta") == F.col("ua")) & (F.col("tb") == F.col("ub")) & (F.col("ta") == F.col("tb"))))
    found = joined.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
    return found, alive.join(classes.select("class", "class_id"), "class").select("doc_id", "class_id", "thread")
