"""The shared search predicate and the filters built from it."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def search_predicate(
    *,
    source: str | None = None,
    source_missing: bool = False,
    tag: str | None = None,
    not_tag: str | None = None,
    since_days: int | None = None,
    as_of: Column | None = None,
    persons: Iterable[str] = (),
    after: datetime | str | None = None,
    before: datetime | str | None = None,
    kind: str | None = None,
    confidential: bool | None = None,
    thread: str | None = None,
    draft: bool | None = None,
    updated_after: datetime | str | None = None,
    updated_before: datetime | str | None = None,
    date: str = "ingested_at",
) -> Column:
    """One conjunction for every search leg, count and facet; dates are inclusive below and exclusive above.

    It reads the columns source, tags, ingested_at (``date`` for the range), participants, lang, sensitivity, thread_id, draft and updated_at,
    each only if its argument is given.  Times without a zone are in the session's, which is UTC.
    """
    parts: list[Column] = [F.lit(True)]
    if source_missing:
        parts.append(F.col("source").isNull())
    elif source is not None:
        parts.append(F.col("source") == source)
    if tag is not None:
        parts.append(F.array_contains("tags", tag))
    if not_tag is not None:
        parts.append(~F.array_contains("tags", not_tag))
    if since_days is not None:
        now = as_of if as_of is not None else F.current_timestamp()
        parts.append(F.col("ingested_at") >= F.timestamp_micros(F.unix_micros(now) - F.lit(since_days * 86_400_000_000)))
    if keys := [p.lower() for p in persons]:
        parts.append(F.exists("participants", lambda x: F.lower(x).isin(*keys)))
    for column, low, high in ((date, after, before), ("updated_at", updated_after, updated_before)):
        if low is not None:
            parts.append(F.col(column) >= F.lit(low).cast("timestamp"))
        if high is not None:
            parts.append(F.col(column) < F.lit(high).cast("timestamp"))
    if thread is not None:
        parts.append(F.col("thread_id") == thread)
    if draft is not None:
        parts.append(F.col("draft") == draft)
    if kind is not None:
        parts.append(F.col("lang") == kind)
    if confidential is not None:
        parts.append((F.col("sensitivity") == "confidential") == confidential)
    return reduce(lambda a, b: a & b, parts)


def discoverable(confidential: bool = False) -> Column:
    """Notes that a browser may list: no drafts, with a path, not an index, not under people, and not confidential unless asked for."""
    fine = ~F.col("draft") & F.col("path").isNotNull() & ~F.col("path").endswith("index.md") & ~F.col("path").startswith("people/")
    return fine if confidential else fine & (F.col("sensitivity") != "confidential")


def mentioning(docs: DataFrame, mentions: DataFrame, entities: Iterable[object]) -> DataFrame:
    """The documents that mention one of some entities."""
    return docs.join(mentions.where(F.col("entity_id").isin(*entities)).select("doc_id"), "doc_id", "left_semi")


def in_public_record(names: DataFrame, docs: DataFrame) -> DataFrame:
    """The names (``name``, of one or two words) that a text which is neither confidential nor a draft holds as words.

    Texts' words and pairs of words meet the names by equality, so that no name is searched in every text.
    """
    words = F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    held = docs.where("sensitivity <> 'confidential' AND NOT draft").select(F.explode(F.array_distinct(F.concat(words, pairs))).alias("_word"))
    return names.join(held, F.lower("name") == F.col("_word"), "left_semi")


def resolve_person(people: DataFrame, query: str) -> DataFrame:
    """``outcome, person``: by address, else by name, else by a part of the name; ambiguous if several persons fit a level.

    ``people`` has email, name and person, the key of one person's rows.
    """
    needle = query.strip().lower()
    level = F.when(F.lower("email") == needle, 0).when(F.lower("name") == needle, 1).when(F.contains(F.lower("name"), F.lit(needle)), 2)
    found = people.select("person", level.alias("level")).where("level IS NOT NULL").groupBy("level").agg(F.countDistinct("person").alias("n"), F.min("person").alias("person"))
    best = found.agg(F.min(F.struct("level", "n", "person")).alias("x"))
    return best.select(F.when(F.col("x.n") == 1, "found").when(F.col("x.n") > 1, "ambiguous").otherwise("missing").alias("outcome"), F.when(F.col("x.n") == 1, F.col("x.person")).alias("person"))


def newest(docs: DataFrame, n: int, date: str = "ingested_at", key: str = "doc_id") -> DataFrame:
    """The first ``n`` by date descending, nulls last, then by key."""
    return docs.orderBy(F.col(date).desc_nulls_last(), F.col(key)).limit(n)


def keyset_page(rows: DataFrame, key: str, last: object, n: int) -> DataFrame:
    """The page after ``last`` in the order of ``key``."""
    return rows.where(F.col(key) > last).orderBy(key).limit(n)


def prefix_lookup(rows: DataFrame, key: str, prefix: str, least: int = 2) -> DataFrame:
    """``outcome, id``: found, missing or ambiguous for an id prefix; a prefix that is too short is ambiguous."""
    hits = rows.where(F.col(key).startswith(prefix) if len(prefix) >= least else F.lit(True)).agg(F.count("*").alias("n"), F.min(key).alias("id"))
    outcome = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return hits.select(outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def resolve(names: DataFrame, candidates: DataFrame, levels: list[Column], name: str = "name", target: str = "id") -> DataFrame:
    """``name, id``: the one candidate of the first level that fits a name; null if that level has several.

    Levels are equalities on a key made of the candidate's columns; each is tried only where the one before found nothing.
    """
    hits = None
    for k, level in enumerate(levels):
        keyed = candidates.where(level.isNotNull()).select(F.lower(level).alias("_key"), F.col(target).alias("_id"))
        found = names.select(F.col(name)).distinct().join(keyed, F.lower(F.col(name)) == F.col("_key")).select(name, F.lit(k).alias("_level"), "_id")
        hits = found if hits is None else hits.unionByName(found)
    counted = hits.groupBy(name, "_level").agg(F.countDistinct("_id").alias("_n"), F.min("_id").alias("_id"))
    first = counted.withColumn("_rank", F.row_number().over(Window.partitionBy(name).orderBy("_level"))).where("_rank = 1")
    best = first.select(name, F.when(F.col("_n") == 1, F.col("_id")).alias(target))
    return names.select(name).distinct().join(best, name, "left")
