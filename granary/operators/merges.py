"""Merging of entities: aliases, types, names, and what hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens

#: Types from the strongest to the weakest.
TYPES = ("person", "org", "project", "topic", "tool")


def checked_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Alias rules (from, to), a bounded list of a file; a source named twice, and one that is a target too, are errors."""
    sources = [a for a, _ in rules]
    twice = sorted({a for a in sources if sources.count(a) > 1})
    chained = sorted(set(sources) & {b for _, b in rules})
    if twice or chained:
        raise ValueError(f"alias rules name a source twice: {twice}; or a source is a target: {chained}")
    return rules


def repointed_mentions(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """``doc_id, entity_id, mention_count, source`` after aliases ``k, t``: joined mentions take the largest count if one is from people, else the sum."""
    rows = mentions.join(aliases, F.col("entity_id") == F.col("k"), "left").withColumn("entity_id", F.coalesce("t", "entity_id"))
    people = F.bool_or(F.col("source") == "people")
    return rows.groupBy("doc_id", "entity_id").agg(F.when(people, F.max("mention_count")).otherwise(F.sum("mention_count")).alias("mention_count"), F.when(people, "people").otherwise(F.min("source")).alias("source"))


def repointed_edges(edges: DataFrame, aliases: DataFrame, persons: DataFrame) -> DataFrame:
    """``doc_id, src, dst, n`` after aliases: ordered again, no self loops; joined edges take the largest count between persons, else the sum."""
    rows = edges
    for end in ("src", "dst"):
        rows = rows.join(aliases.select(F.col("k").alias("_k"), F.col("t").alias("_t")), F.col(end) == F.col("_k"), "left").withColumn(end, F.coalesce("_t", end)).drop("_k", "_t")
    tidy = rows.where("src <> dst").select("doc_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "n")
    joined = tidy.groupBy("doc_id", "src", "dst").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    known = persons.select("entity_id", F.lit(True).alias("_p"))
    a, b = (known.select(F.col("entity_id").alias(e), F.col("_p").alias(f"_{e}")) for e in ("src", "dst"))
    both = F.coalesce(F.col("_src") & F.col("_dst"), F.lit(False))
    return joined.join(a, "src", "left").join(b, "dst", "left").select("doc_id", "src", "dst", F.when(both, F.col("most")).otherwise(F.col("all")).alias("n"))


def type_rank(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, TYPES)), kind), F.lit(len(TYPES) + 1))


def one_type(entities: DataFrame) -> DataFrame:
    """``key, entity_type, types``: the strongest type of each key, and how many it had."""
    return entities.groupBy("key").agg(F.min_by("entity_type", F.struct(type_rank(F.col("entity_type")), "entity_type")).alias("entity_type"), F.countDistinct("entity_type").alias("types"))


def best_surface(variants: DataFrame) -> DataFrame:
    """``key, name``: each key's best spelling: not all capitals, more capitals, more documents, longer, then by text."""
    capitals = F.length(F.regexp_replace("name", "[^A-Z]", ""))
    shouting = (F.upper("name") == F.col("name")) & (F.lower("name") != F.col("name"))
    order = Window.partitionBy("key").orderBy(shouting, F.desc(capitals), F.desc("df"), F.desc(F.length("name")), "name")
    return variants.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("key", "name")


def subsumed(names: DataFrame) -> DataFrame:
    """``doc_id, name``: a document's names whose words stand in order inside a longer name of the same document.

    Each name is sent to its runs of words, which meet the shorter names by equality.
    """
    words = F.split(F.lower("name"), " +")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(F.lit(1), n - a + 1), lambda k: F.concat_ws(" ", F.slice(words, a, k)))))
    longer = names.select("doc_id", F.lower("name").alias("_whole"), F.explode(F.array_distinct(runs)).alias("_part")).where("_part <> _whole")
    return names.join(longer.select(F.col("doc_id").alias("_d"), "_part"), (F.col("doc_id") == F.col("_d")) & (F.lower("name") == F.col("_part")), "left_semi").distinct()


def present(rows: DataFrame, text: str, names: Column) -> DataFrame:
    """The rows' columns but ``text``, and ``name``: one row each time that ``names`` has a name which stands in the text, in either case.

    The text is read where it lies; no row that leaves has it, so that what is exchanged grows with the names and not with names times text.
    A name that is one of the text's words is found by a hash, and only the others are searched for.
    """
    kept = [c for c in rows.columns if c != text]
    held = rows.select(*kept, F.lower(text).alias("_low"), tokens(F.col(text)).alias("_words"), names.alias("_names"))
    absent = F.filter(F.array_except(F.transform("_names", F.lower), "_words"), lambda x: ~F.contains("_low", x))
    told = held.select(*kept, "_names", absent.alias("_absent"))
    found = F.when(F.size("_absent") == 0, F.col("_names")).otherwise(F.filter("_names", lambda x: ~F.array_contains("_absent", F.lower(x))))
    # the outer form, as Spark makes a filter of what the other one explodes and finds the words again for it
    return told.select(*kept, F.explode_outer(found).alias("name")).where("name IS NOT NULL")


def finalised(candidates: DataFrame, most: int, least_length: int = 2) -> DataFrame:
    """``doc_id, key, name, entity_type, mention_count`` of candidates: noise goes (short keys, digits only), one type a key, the ``most`` frequent.

    ``candidates`` has doc_id, name, key, entity_type and mention_count; ``present`` leaves out names that aren't in the text.
    """
    fine = candidates.where((F.length("key") >= least_length) & ~F.col("key").rlike("^[0-9]+$"))
    best = fine.groupBy("doc_id", "key").agg(F.min_by(F.struct("name", "entity_type"), F.struct(type_rank(F.col("entity_type")), "name")).alias("x"), F.sum("mention_count").alias("mention_count"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("mention_count"), "key")
    return best.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("doc_id", "key", "x.name", "x.entity_type", "mention_count")


def rewritten(stored: DataFrame, fresh: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored rows without those of the rewritten documents, and their fresh rows."""
    return stored.join(docs.select("doc_id"), "doc_id", "left_anti").unionByName(fresh.join(docs.select("doc_id"), "doc_id", "left_semi"))
