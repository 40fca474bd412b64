"""Readers and writers of files, as declared Spark sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``path, text`` of whole text files."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """Header and body of a note that may begin with a ``---`` fence; the header is empty without one."""
    fence = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
    return F.regexp_extract(text, fence, 1), F.regexp_replace(text, fence, "")


def header_value(header: Column, name: str) -> Column:
    """A plain ``name: value`` line of a header; null if absent."""
    found = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(found != "", F.regexp_replace(found, r"^['\"]|['\"]$", ""))


def header_list(header: Column, name: str) -> Column:
    """A list in flow (``[a, b]``) or block (``- a``) form; empty if absent."""
    flow = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*\[(.*?)\]", 1)
    block = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[ \t].*(?:\n|$))+)", 1)
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")), lambda x: x != "")
    return F.when(flow != "", clean(F.split(flow, ","))).otherwise(clean(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-[ \t]*", ""))))


def markdown_notes(spark: SparkSession, path: str) -> DataFrame:
    """``path, title, tags, body, content_hash`` of Markdown notes; without a title in the header the first heading or file name counts."""
    notes = text_files(spark, path, "*.{md,markdown}")
    header, body = front_matter(F.col("text"))
    heading = F.regexp_extract(body, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1)
    title = F.coalesce(header_value(header, "title"), F.when(heading != "", heading), stem)
    return notes.select("path", title.alias("title"), header_list(header, "tags").alias("tags"), body.alias("body"), F.sha2(body, 256).alias("content_hash"))


def csv_rows(spark: SparkSession, path: str) -> int:
    """Data rows of CSV files; blank lines don't count."""
    return spark.read.option("header", True).option("multiLine", True).csv(path).count()


def archive_posts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of archive files that assign a JSON array to a script variable (``window.x = [...]``)."""
    raw = text_files(spark, path, "*.js").select(F.regexp_replace("text", r"^[^=\[]*=\s*", "").alias("json"))
    return raw.select(F.explode(F.from_json("json", f"array<{schema}>")).alias("post")).select("post.*")


def export_notes(documents: DataFrame, path: str) -> None:
    """Documents as Markdown notes with a header, one line-delimited text file set a source."""
    note = F.concat(F.lit("---\ntitle: "), F.regexp_replace("title", r"[\r\n]+", " "), F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n"), F.col("text"))
    documents.select(note.alias("value"), "source").write.mode("overwrite").partitionBy("source").option("lineSep", "\n␞\n").text(path)


def prune_plan(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored paths that a listing no longer has."""
    return stored.join(listed, "path", "left_anti")


#: Readers by file ending: functions of session and folder that give ``path`` and ``text`` or ``body``, and what else they find.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_reader(endings: tuple[str, ...], reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Name the reader of some endings; an ending that has one is an error."""
    for ending in endings:
        if READERS.get(ending):
            raise ValueError(f"{ending} has a reader")
        READERS[ending] = reader


register_reader((".txt",), text_files)
register_reader((".md", ".markdown"), markdown_notes)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``path, title, text, tags`` of all files in a folder that a reader knows."""
    found = None
    for reader in dict.fromkeys(READERS.values()):
        rows = reader(spark, path)
        if "body" in rows.columns:
            rows = rows.withColumnRenamed("body", "text")
        title = F.col("title") if "title" in rows.columns else F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1)
        tags = F.col("tags") if "tags" in rows.columns else F.array().cast("array<string>")
        rows = rows.select("path", title.alias("title"), "text", tags.alias("tags"))
        found = rows if found is None else found.unionByName(rows)
    return found
