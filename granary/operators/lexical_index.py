"""A stored index of text fields: lexemes with their positions, in segments that follow a table's changes.

An index is a folder: ``postings`` (packed, an item a row of the table, field and word of a lexeme, in folders by segment and the lexeme's hash, sorted by lexeme)
and ``live`` (which segment holds each row, and a checksum of its fields).  A query reads the postings of its lexemes and no texts.  An update
compares checksums, indexes the rows that are new or changed as another segment, and writes ``live`` again; rows whose segment has passed are
left out of results until the segments are merged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import STOP_WORDS, with_stems, words_of
from ..sources.shared import folder_for, version
from .packed import packed, unpacked

BUCKETS, MOST_SEGMENTS = 64, 8
WEIGHTS = {"title": 1.0, "tags": 0.4, "content": 0.2}


@dataclass
class TextIndex:
    """Handle of an index: where it lies, its key columns and fields, whether words are stemmed, and its segments so far."""

    spark: SparkSession
    folder: str
    keys: list[str]
    fields: list[str]
    english: bool = True
    segments: int = 0
    live: str = ""
    seen: str = ""
    merges: int = field(default=0)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_of(term: str) -> int:
    """The folder of a lexeme, without a job: the same hash as the column function's."""
    return xxhash.xxh64_intdigest(term.encode(), 42) % BUCKETS


def _postings(rows: DataFrame, index: TextIndex) -> DataFrame:
    """Packed postings of rows by ``term``; positions count all words of the field from 1, stop words too.

    A lexeme's words lie in rows of their own, each stemmed once a stretch of rows, and meet when they are read.
    """
    parts = F.array(*[F.struct(F.lit(f).alias("field"), words_of(F.col(f)).alias("words")) for f in index.fields])
    held = packed(rows.select(*index.keys, F.explode_outer(parts).alias("x")).select(*index.keys, "x.field", "x.words"), "words", positions=True)
    if not index.english:
        return held.withColumnRenamed("word", "term")
    return with_stems(held.where(~F.col("word").isin(*STOP_WORDS)), "word", "term").drop("word")


def _checksums(rows: DataFrame, index: TextIndex) -> DataFrame:
    """``keys, checksum`` of the rows' fields."""
    return rows.select(*index.keys, F.sha2(F.to_json(F.struct(*index.fields), {"ignoreNullFields": "false"}), 256).alias("checksum"))


def _write(rows: DataFrame, index: TextIndex) -> None:
    path = f"{index.folder}/postings/segment={index.segments}"
    _spread(_postings(rows, index).withColumn("bucket", _bucket(F.col("term"))), index, path)


def _spread(postings: DataFrame, index: TextIndex, path: str) -> None:
    """Write packed postings in folders by bucket; a common lexeme's lie in several files of its folder."""
    part = F.pmod(F.xxhash64(*[F.col(k)[0] for k in index.keys]), F.lit(4))
    postings.repartition(F.col("bucket"), part).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(path)


def updated(index: TextIndex, rows: DataFrame) -> int:
    """Bring an index up to a table of key and text columns, and return how many rows it had to read into postings.

    Keys are unique and not null.  An empty table gives an empty index.  Null fields hold no words.
    """
    now = _checksums(rows, index)
    if not index.segments:
        changed, kept = rows, None
    else:
        before = index.spark.read.parquet(index.live)
        kept = before.join(now, [*index.keys, "checksum"], "left_semi")
        changed = rows.join(kept, index.keys, "left_anti")
    n = changed.count()
    if index.segments and not n and kept.count() == index.spark.read.parquet(index.live).count():
        return 0
    if n or not index.segments:
        _write(changed, index)
    fresh = _checksums(changed, index).withColumn("segment", F.lit(index.segments))
    live = f"{index.folder}/live/version={index.segments}-{index.merges}"
    (fresh if kept is None else kept.unionByName(fresh)).write.mode("overwrite").parquet(live)
    index.live, index.segments = live, index.segments + 1
    if index.segments > MOST_SEGMENTS:
        merged(index)
    return n


def merged(index: TextIndex) -> None:
    """All live postings as one segment in a folder of its own."""
    rows, index.merges = all_postings(index), index.merges + 1
    live = index.spark.read.parquet(index.live)
    index.folder = f"{index.folder}/merged-{index.merges}"
    ones = rows.select("term", *[F.array(c).alias(c) for c in (*index.keys, "field")], F.array(F.size("positions")).alias("tf"), F.array(F.size("positions")).alias("ends"), "positions", "bucket")
    _spread(ones, index, f"{index.folder}/postings/segment=0")
    live.withColumn("segment", F.lit(0)).write.mode("overwrite").parquet(f"{index.folder}/live/version=0-{index.merges}")
    index.live, index.segments = f"{index.folder}/live/version=0-{index.merges}", 1


def all_postings(index: TextIndex) -> DataFrame:
    """``keys, field, term, positions, bucket, segment`` of live rows; a lexeme comes once for each of its words in a field."""
    kinds = ", ".join(f"`{k}` array<{index.spark.read.parquet(index.live).schema[k].dataType.simpleString()}>" for k in index.keys)
    stored = index.spark.read.schema(f"{kinds}, field array<string>, term string, tf array<int>, ends array<int>, positions array<int>, segment int, bucket int").parquet(f"{index.folder}/postings")
    found = unpacked(stored, [*index.keys, "field"], "term", "segment", "bucket").select(*index.keys, "field", "term", "positions", "bucket", "segment")
    if index.segments == 1:
        return found
    return found.join(index.spark.read.parquet(index.live).select(*index.keys, "segment"), [*index.keys, "segment"], "left_semi")


def postings_of(index: TextIndex, terms: list[str]) -> DataFrame:
    """Live postings of some lexemes, one a row, field and lexeme; only their folders are read."""
    found = all_postings(index).where(F.col("bucket").isin(*{bucket_of(t) for t in terms}) & F.col("term").isin(*terms))
    return found.groupBy(*index.keys, "field", "term").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


_current: dict[tuple[str, str, bool], TextIndex] = {}


def current(rows: DataFrame, name: str, keys: list[str], fields: list[str], english: bool = True) -> TextIndex:
    """The session's index of a table, brought up to date if the files behind it have changed since."""
    spark = rows.sparkSession
    key, now = (spark.sparkContext.applicationId, name, english), version(rows)
    if key not in _current:
        _current[key] = TextIndex(spark, folder_for(spark, "text-index"), keys, fields, english)
    index = _current[key]
    if index.seen != now:
        updated(index, rows)
        index.seen = now
    return index


def query_words(spark: SparkSession, text: str, english: bool = True) -> list[tuple[int, str]]:
    """``(place, lexeme)`` of a query's words but stop words; places count all words from 0."""
    words = spark.sql("SELECT :text AS text", {"text": text}).select(words_of(F.col("text")).alias("words")).first().words
    if not english:
        return list(enumerate(words))
    asked = spark.sql("SELECT explode(:words) AS word", {"words": F.array(*map(F.lit, words))}) if words else None
    stems = {r.word: r.stem for r in with_stems(asked.distinct()).collect()} if words else {}
    return [(k, stems[w]) for k, w in enumerate(words) if w not in STOP_WORDS]


def compact_word(text: str) -> str | None:
    """A query of two or more words written as one."""
    import re

    parts = re.findall(r"[A-Za-z][A-Za-z0-9]*", text)
    return "".join(parts).lower() if len(parts) > 1 else None


def scores(index: TextIndex, text: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``keys, score`` of the rows that hold all lexemes of a query in any fields, or its compact spelling; a query without any matches nothing.

    A lexeme counts tf / (tf + 1) by its field's weight.
    """
    asked = list(dict.fromkeys(t for _, t in query_words(index.spark, text, index.english)))
    compact = compact_word(text)
    one = [t for _, t in query_words(index.spark, compact, index.english)] if compact else []
    if not asked:
        return index.spark.read.parquet(index.live).select(*index.keys, F.lit(0.0).alias("score")).where("false")
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("field")]
    tf = F.size("positions")
    held = F.count_distinct(F.when(F.col("term").isin(*asked), F.col("term")))
    found = postings_of(index, [*asked, *one]).groupBy(*index.keys).agg(held.alias("_n"), F.max(F.col("term").isin(*one) if one else F.lit(False)).alias("_one"), F.round(F.sum(weight * tf / (tf + 1)), 6).alias("score"))
    return found.where((F.col("_n") == len(asked)) | F.col("_one")).select(*index.keys, "score")


def phrases(index: TextIndex, text: str) -> DataFrame:
    """``keys, field, n``: how often a field holds a query's words one after the other, stop words' places kept free."""
    asked = query_words(index.spark, text, index.english)
    if not asked:
        return all_postings(index).select(*index.keys, "field", F.lit(0).cast("long").alias("n")).where("false")
    held = postings_of(index, [t for _, t in asked]).groupBy(*index.keys, "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

    def start(place: int, term: str) -> Column:
        return F.transform(F.coalesce(F.col("at")[term], F.array().cast("array<int>")), lambda p: p - place)

    starts = [start(place, term) for place, term in asked]
    both = starts[0]
    for other in starts[1:]:
        both = F.array_intersect(both, other)
    return held.select(*index.keys, "field", F.size(both).cast("long").alias("n")).where("n > 0")
