"""Ingest decisions, merges and other changes of stored tables, as joins that make a new version."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import ranges


def ingest_actions(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows with ``action`` (insert, skip, update) and ``matched_id``.

    The first key in order that finds a stored row decides; an equal content hash there means skip.  Incoming and stored rows have ``id``,
    ``content_hash`` and the keys; a stored key value stands for its smallest id.
    """
    rows, found = incoming, []
    for key in keys:
        side = stored.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.min(F.struct(F.col("id").alias("id"), F.col("content_hash").alias("hash"))).alias(f"_by_{key}"))
        rows = rows.join(side, F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
        found.append(F.col(f"_by_{key}"))
    hit = F.coalesce(*found)
    action = F.when(hit.isNull(), "insert").when(hit["hash"] == F.col("content_hash"), "skip").otherwise("update")
    return rows.select(*incoming.columns, action.alias("action"), hit["id"].alias("matched_id"))


def merged_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows updated by incoming ones of the same id, and the new ones.

    A draft never overwrites what isn't one; tags are united; a new text drops the summary; sensitivity only rises to confidential.  Both have
    id, text, tags, draft, sensitivity, summary.
    """
    s, n = stored.alias("s"), incoming.alias("n")
    both = s.join(n, F.col("s.id") == F.col("n.id"), "full_outer")
    held = F.col("s.id").isNotNull() & (F.col("n.id").isNull() | (F.col("n.draft") & ~F.col("s.draft")))
    new = F.col("s.id").isNull()
    pick = lambda c: F.when(held, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}"))
    tags = F.when(held, F.col("s.tags")).when(new, F.col("n.tags")).otherwise(F.array_union("s.tags", "n.tags"))
    secret = (F.col("s.sensitivity") == "confidential") | (~held & (F.col("n.sensitivity") == "confidential"))
    summary = F.when(held | (F.col("s.text") == F.col("n.text")), F.col("s.summary"))
    return both.select(F.coalesce("s.id", "n.id").alias("id"), pick("text").alias("text"), tags.alias("tags"), pick("draft").alias("draft"), F.when(F.coalesce(secret, F.lit(False)), "confidential").otherwise("normal").alias("sensitivity"), summary.alias("summary"))


def upsert_undirected(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``a, b, score, status`` with one row an unordered pair: a decided row stays, a pending one takes a higher score."""
    tidy = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "status")
    rows = tidy(stored).withColumn("old", F.lit(1)).unionByName(tidy(incoming).withColumn("old", F.lit(0)))
    decided = (F.col("status") != "pending").cast("int")
    order = Window.partitionBy("a", "b").orderBy(F.desc(decided), F.desc("score"), F.desc("old"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("a", "b", "score", "status")


def assembled_threads(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, n, participants, content``: a thread's messages oldest first, all but the last marked as collapsed."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, role, text))), lambda x: x)
    grouped = turns.groupBy(conv).agg(parts.alias("ms"), F.count("*").alias("n"))
    line = F.transform("ms", lambda m, k: F.concat(F.when(k < F.size("ms") - 1, F.lit("> ")).otherwise(F.lit("")), m[role], F.lit(": "), m[text]))
    return grouped.select(conv, "n", F.array_join(F.array_sort(F.array_distinct(F.transform("ms", lambda m: F.lower(m[role])))), ",").alias("participants"), F.array_join(line, "\n").alias("content"))


def merged_posts(posts: DataFrame) -> DataFrame:
    """``id, text, collections``: one row an id, collections united, the first text that isn't null."""
    first = F.min(F.when(F.col("text").isNotNull(), F.struct("seq", "text")))
    return posts.groupBy("id").agg(first["text"].alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("collections")))).alias("collections"))


def merged_visits(rows: DataFrame, least: int = 3) -> DataFrame:
    """``url, visits, first, last, title``: history per normalised URL; bookmarks stay, others need ``least`` visits."""
    out = rows.where(F.col("url").isNotNull()).groupBy("url").agg(F.sum("visits").alias("visits"), F.min("at").alias("first"), F.max("at").alias("last"), F.max(F.struct("at", "title"))["title"].alias("title"), F.bool_or("bookmarked").alias("bookmarked"))
    return out.where(F.col("bookmarked") | (F.col("visits") >= least))


def retagged(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Documents with tags renamed or merged by ``tag, target``; a null target drops the tag.  Order is kept, doubles go."""
    rows = docs.select("doc_id", F.posexplode("tags").alias("k", "tag")).join(mapping.withColumn("_known", F.lit(True)), "tag", "left")
    now = rows.withColumn("now", F.when(F.col("_known"), F.col("target")).otherwise(F.col("tag"))).where("now IS NOT NULL")
    tags = now.groupBy("doc_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "now"))), lambda x: x["now"])).alias("tags"))
    return docs.select("doc_id").join(tags, "doc_id", "left").select("doc_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def cascaded(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Each table without the rows whose document is gone."""
    return {name: rows.join(gone.select(F.col(key).alias("_gone")), F.col(column) == F.col("_gone"), "left_anti") for name, (rows, column) in tables.items()}


def packed_prefix(rows: DataFrame, group: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose running token sum fits; each row counts one token at least, and nothing is skipped."""
    return ranges.running(rows, group, order, F.greatest(F.col(tokens), F.lit(1))).where(F.col("running") <= budget)


def patched(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """Stored rows (id, title, text, tags, metadata map) with field-level patches: null fields stay, metadata keys are set one by one.

    ``rechunk`` says whether the text changed.
    """
    s, n = stored.alias("s"), patches.alias("n")
    rows = s.join(n, F.col("s.id") == F.col("n.id"), "left")
    kept = F.map_filter("s.metadata", lambda k, v: ~F.coalesce(F.map_contains_key("n.metadata", k), F.lit(False)))
    metadata = F.when(F.col("n.metadata").isNull(), F.col("s.metadata")).otherwise(F.map_concat(kept, "n.metadata"))
    pick = lambda c: F.coalesce(f"n.{c}", f"s.{c}").alias(c)
    return rows.select(F.col("s.id").alias("id"), pick("title"), pick("text"), pick("tags"), metadata.alias("metadata"), F.coalesce(F.col("n.text") != F.col("s.text"), F.lit(False)).alias("rechunk"))


def upserted_sources(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored sources (kind, external_id, metadata) and the new ones, one a kind and external id; those without an external id share one a kind."""
    tidy = incoming.groupBy("kind", "external_id").agg(F.min("metadata").alias("metadata"))
    fresh = tidy.alias("i").join(stored.alias("s"), (F.col("i.kind") == F.col("s.kind")) & F.col("i.external_id").eqNullSafe(F.col("s.external_id")), "left_anti")
    return stored.unionByName(fresh.select("kind", "external_id", "metadata"))


def chunk_rows(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with the fields of their document that search reads: title, tags as text, and the parts of addresses in the chunk."""
    fields = docs.select("doc_id", F.col("title").alias("title_text"), F.array_join("tags", " ").alias("tags_text"))
    return chunks.join(fields, "doc_id").withColumn("search_extras", F.array_join(tx.sub_tokens(F.col("content")), " "))


def stale_chunk_fields(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The chunks whose stored title or tags differ from their document's, with the new values; equal nulls are equal."""
    now = docs.select("doc_id", F.col("title").alias("new_title"), F.array_join("tags", " ").alias("new_tags"))
    return chunks.join(now, "doc_id").where(~F.col("title_text").eqNullSafe(F.col("new_title")) | ~F.col("tags_text").eqNullSafe(F.col("new_tags")))


def merged_occurrences(stored: Column, incoming: Column, first: Column, last: Column, most: int) -> Column:
    """Starts of a series after a run over ``[first, last]``: stored ones inside it count only if they were seen again; the last ``most``."""
    outside = F.filter(stored, lambda x: (x < first) | (x > last))
    merged = F.array_sort(F.array_distinct(F.concat(outside, incoming)))
    return F.slice(merged, F.greatest(F.lit(1), F.size(merged) - most + 1), F.lit(most))


def item_documents(items: DataFrame, events: DataFrame) -> DataFrame:
    """``item_id, title, content``: one text an item, its sections (kind, at, body) in order of time, then kind; ``updated`` chooses among repeated items."""
    newest = items.groupBy("item_id").agg(F.max_by("title", "updated").alias("title"))
    section = F.struct("at", "kind", "body")
    parts = events.groupBy("item_id").agg(F.array_sort(F.collect_list(section)).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x["kind"], F.lit("\n"), x["body"])), "\n")
    return newest.join(parts, "item_id", "left").select("item_id", "title", F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), text).alias("content"))


def export_plan(paths: Column, databases: bool = True) -> Column:
    """What an export's file is: page, database, or why it is skipped (attachment, index, database)."""
    low = F.lower(paths)
    return F.when(low.endswith(".md"), "page").when(low.endswith("_all.csv"), "skip: index").when(low.endswith(".csv"), "database" if databases else "skip: database").otherwise("skip: attachment")


def selected_posts(posts: DataFrame, since: Column | None, most: int) -> DataFrame:
    """The newest posts (undated last, then by id), with the number of those beyond the limit; undated ones don't count where ``since`` is set."""
    rows = posts if since is None else posts.where(F.col("at") >= since)
    total = rows.count()
    return rows.orderBy(F.col("at").desc_nulls_last(), "id").limit(most).withColumn("remaining", F.lit(max(0, total - most)).cast("long"))


def sync_actions(listed: DataFrame, stored: DataFrame, prune: bool = True) -> DataFrame:
    """``path, action`` of a folder against what is stored: insert, update, keep, and prune (or missing)."""
    rows = listed.select("path", F.col("content_hash").alias("_new")).join(stored.select("path", F.col("content_hash").alias("_old")), "path", "full_outer")
    return rows.select("path", F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "prune" if prune else "missing").when(F.col("_new") == F.col("_old"), "keep").otherwise("update").alias("action"))


def stale_aspects(docs: DataFrame, state: DataFrame, version: int) -> DataFrame:
    """``doc_id, reason`` of documents whose stored state (content_hash, inputs_hash, version) isn't that of now: new, content, inputs or version."""
    s = state.select("doc_id", F.col("content_hash").alias("_c"), F.col("inputs_hash").alias("_i"), F.col("version").alias("_v"))
    reason = F.when(F.col("_v").isNull(), "new").when(~F.col("content_hash").eqNullSafe(F.col("_c")), "content").when(~F.col("inputs_hash").eqNullSafe(F.col("_i")), "inputs").when(F.col("_v") != version, "version")
    return docs.join(s, "doc_id", "left").select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")


def directory_index(entries: DataFrame) -> DataFrame:
    """``email, name``: each address's name, curated entries first, then the most frequent, then the first by text."""
    counted = entries.groupBy("email", "name").agg(F.sum("n").alias("n"), F.bool_or("curated").alias("curated"))
    order = Window.partitionBy("email").orderBy(F.desc("curated"), F.desc("n"), "name")
    return counted.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("email", "name")


def over_fetch(budget: int, item_tokens: int = 120, least: int = 5, most: int = 50) -> int:
    """How many candidates a token budget is worth."""
    return max(least, min(most, -(-budget // item_tokens)))


def without_repeated_lines(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """``doc_id, text`` from ``doc_id, page, text``: lines on over half of a document's pages (of at least ``least_pages``) are headers and go."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    sized = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages")).where(F.col("_pages") >= least_pages)
    often = lines.groupBy("doc_id", "line").agg(F.countDistinct("page").alias("_on")).join(sized, "doc_id").where("_on * 2 > _pages").select("doc_id", "line")
    kept = lines.join(often, ["doc_id", "line"], "left_anti")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def chunked(docs: DataFrame, most: int = 600, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk_index, content, tokens``: paragraphs (lines) packed up to ``most`` words, each chunk led by the tail of the one before.

    Paragraphs over the bound are cut at sentence ends, else at words.  A text without words gives no chunks.
    """

    def units(text: str) -> Iterator[list[str]]:
        for paragraph in text.split("\n"):
            words = paragraph.split()
            while len(words) > most:
                stop = next((k for k in range(most, most // 2, -1) if words[k - 1][-1] in ".!?"), most)
                yield words[:stop]
                words = words[stop:]
            if words:
                yield words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                now: list[str] = []
                fresh, index = 0, 0
                for unit in units(text or ""):
                    if fresh and len(now) + len(unit) > most:
                        out.append((key, index, " ".join(now), len(now)))
                        room = max(0, min(overlap, most - len(unit)))
                        now, fresh, index = now[len(now) - room :] if room else [], 0, index + 1
                    now = now + unit
                    fresh += len(unit)
                if fresh:
                    out.append((key, index, " ".join(now), len(now)))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "content", "tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, chunk_index long, content string, tokens long")


def promoted(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """Typed columns from JSON metadata; values of a wrong type are null."""
    text = lambda k: F.when(F.expr(f"schema_of_variant(try_variant_get(try_parse_json({column}), '$.{k}', 'variant'))") == "STRING", F.get_json_object(column, f"$.{k}"))
    number = F.expr(f"try_cast(get_json_object({column}, '$.duration_min') AS double)").cast("int")
    people = F.expr(f"from_json(get_json_object({column}, '$.participants'), 'array<string>')")
    at = F.expr(f"try_to_timestamp(get_json_object({column}, '$.date'))")
    return rows.select("*", text("thread_id").alias("thread_id"), at.alias("sent_at"), people.alias("participants"), number.alias("duration_min"))


def email_parts(address: Column) -> tuple[Column, Column]:
    """Display name and lower-case address of ``Name <a@b>`` or a bare address."""
    mail = F.lower(F.regexp_extract(address, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1))
    return tx.person_name(F.trim(F.regexp_replace(F.trim(F.regexp_replace(address, r"<[^>]*>", "")), r'^"|"$', ""))), F.when(mail != "", mail)
