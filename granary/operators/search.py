"""Retrieval: lexical and vector legs, rank fusion, recency, facets."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..functions.text import tokens
from ..sources.shared import stored, version
from . import ranges
from .blocks import PART_BYTES, best_rows
from .packed import packed, unpacked

CANDIDATES, CAP, FLOOR, HALF_LIFE = 50, 3, 0.25, 180.0


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk_index, content``: the lines of each text, without blank ones."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("chunk_index", "content"))
    return lines.where(F.trim("content") != "")


def inverted_index(rows: DataFrame, keys: list[str], text_col: str, weight: float = 1.0) -> DataFrame:
    """``keys, term, tf, weight`` of each row's terms."""
    terms = rows.select(*keys, F.explode(tokens(F.col(text_col))).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf")).withColumn("weight", F.lit(weight))


BUCKETS = 64
_indexes: dict[tuple[str, str], DataFrame] = {}


def stored_index(rows: DataFrame, keys: list[str], text_col: str, name: str) -> DataFrame:
    """``keys, term, tf, bucket``: an inverted index in folders by the term's hash, sorted by term, built once a session for ``name`` and the state of the files behind the rows.

    Keys are unique.  Postings are packed before they are exchanged and stay so in the files.  ``name`` says which rows it holds, such as a table's path.  A common term's postings lie in several files of its folder.
    """
    key = (rows.sparkSession.sparkContext.applicationId, f"{name} {version(rows)}")
    if key not in _indexes:
        index = packed(rows.select(*keys, tokens(F.col(text_col)).alias("words")), "words").withColumnRenamed("word", "term").withColumn("bucket", term_bucket(F.col("term")))
        spread = index.repartition(F.col("bucket"), F.pmod(F.xxhash64(*[F.col(k)[0] for k in keys]), F.lit(4))).sortWithinPartitions("bucket", "term")
        _indexes[key] = unpacked(stored(spread, "index", "bucket"), keys, "term", "bucket")
    return _indexes[key]


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """The index's rows of some terms; only their folders are read."""
    buckets = {xxhash.xxh64_intdigest(t.encode(), 42) % BUCKETS for t in terms}  # as ``term_bucket``
    return index.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))


def index_scores(index: DataFrame, keys: list[str], terms: list[str], every: bool = True) -> DataFrame:
    """``keys, score`` of what holds all (or any) of the terms: the sum over terms of tf / (tf + 1)."""
    found = postings(index, terms).groupBy(*keys).agg(F.count("*").alias("_n"), F.round(F.sum(F.col("tf") / (F.col("tf") + 1)), 6).alias("score"))
    return (found.where(F.col("_n") == len(set(terms))) if every else found).drop("_n")


def lexical_scores(rows: DataFrame, terms: list[str], text_col: str = "content", every: bool = True) -> DataFrame:
    """The rows that hold all (or any) of the terms, with ``score``: the sum over terms of the weight tf / (tf + 1).

    For rows without a stored index: the terms' counts are expressions over each row's tokens, so nothing is shuffled.
    """
    words = tokens(F.col(text_col))
    count = lambda term: F.size(F.filter(words, lambda x: x == term))
    counted = rows.withColumn("_tf", F.array(*map(count, terms)))
    fits = F.forall("_tf", lambda n: n > 0) if every else F.exists("_tf", lambda n: n > 0)
    return counted.where(fits).withColumn("score", F.round(F.aggregate("_tf", F.lit(0.0), lambda s, n: s + n / (n + 1)), 6)).drop("_tf")


def cap_per_document(scored: DataFrame, cap: int = CAP, doc: str = "doc_id", order: list[Column] | None = None) -> DataFrame:
    """The best ``cap`` rows of each document."""
    order = order or [F.desc("score"), F.col("chunk_index")]
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def top(scored: DataFrame, n: int, *ties: str) -> DataFrame:
    """``n`` best rows by score, with ``rank`` from 0; only these few rows are numbered in one task."""
    order = [F.desc("score"), *ties]
    return scored.orderBy(*order).limit(n).withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def vector_leg(vectors: DataFrame, query: Column, n: int = CANDIDATES, floor: float | None = FLOOR, id_col: str = "id") -> DataFrame:
    """``id, score, rank`` of the nearest rows by cosine; the floor is applied after the limit, and undefined cosines never pass."""
    scored = vectors.select(F.col(id_col), F.round(scores.cosine(F.col("vector"), query), 6).alias("score"))
    best = top(scored.where(F.col("score").isNotNull() & ~F.isnan("score")), n, id_col)
    return best if floor is None else best.where(F.col("score") >= floor)


QUERY_BLOCK = 4096


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, n: int, floor: float = -1.0) -> DataFrame:
    """``query_id, id, score, rank``: each query's ``n`` nearest other rows.

    A stated query set against all rows, in blocks: queries are dealt to blocks of about ``QUERY_BLOCK`` rows and vectors to parts of a bounded
    size in bytes, each block meets each part in one group, and a group keeps only ``n`` rows a query before anything is exchanged.  Nothing goes
    through the driver.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    size = vectors.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)) * 8).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    dealt = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = queries.select(F.col("id").cast("long").alias("query_id"), F.col("vector").alias("query"), dealt(blocks).alias("q_block"), each(parts).alias("q_part"))
    held = vectors.select(F.col("id").cast("long").alias("id"), "vector", each(blocks).alias("block"), dealt(parts).alias("part"))
    found = asked.groupBy("q_block", "q_part").cogroup(held.groupBy("block", "part")).applyInArrow(best_rows(n, floor), "query_id long, id long, score double").withColumn("score", F.round("score", 6))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)


def fuse(legs: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """``key, score``: weighted reciprocal rank fusion of rankings with ``rank`` from 0."""
    parts = None
    for leg, weight in legs:
        part = leg.select(key, (scores.rrf(F.col("rank")) * weight).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.sum("part").alias("score"))


def best_chunk(fused: DataFrame, doc: str = "doc_id", chunk: str = "chunk_index") -> DataFrame:
    """A document's best chunk stands for it."""
    order = Window.partitionBy(doc).orderBy(F.desc("score"), chunk)
    return fused.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_recency(rows: DataFrame, date: str, as_of: Column, half_life: float = HALF_LIFE) -> DataFrame:
    """The score times the decay of the row's age."""
    return rows.withColumn("score", F.col("score") * scores.decay(scores.age_days(as_of, F.col(date)), half_life))


def facets(matched: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``facet, value, n``: distinct documents of each facet's value over the whole match set, in one pass.

    An array facet counts a document for each of its elements.
    """

    def named(facet: str) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))

    pairs = F.flatten(F.array(*[F.transform(c, named(k)) for k, c in columns.items()]))
    return matched.select("doc_id", F.explode(F.array_distinct(pairs)).alias("x")).groupBy("x.facet", "x.value").agg(F.countDistinct("doc_id").alias("n"))


def snippet(chunk_rows: DataFrame, best: DataFrame, reach: int = 2) -> DataFrame:
    """``doc_id, snippet``: the best chunk with up to ``reach`` neighbours on each side, in order."""
    near = best.select("doc_id", F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index"))
    parts = near.join(chunk_rows, ["doc_id", "chunk_index"])
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n").alias("snippet"))


def slot_rerank(ranked: DataFrame, side_scores: DataFrame, key: str, weight: float) -> DataFrame:
    """Rows that have a side score are re-sorted by the blend among their own slots; the others keep theirs.

    Slots are numbered over ranges, so that either kind may be a whole table.
    """
    joined = ranked.join(side_scores.select(key, F.col("score").alias("_side")), key, "left").withColumn("_has", F.col("_side").isNotNull())
    held = ranges.numbered(joined.where("_has"), [], [F.col("rank")], "_slot")
    blend = F.col("score") * (1 - weight) + F.col("_side") * weight
    wanted = ranges.numbered(held.withColumn("_blend", -blend), [], [F.col("_blend"), F.col(key)], "_want")
    places = held.select(F.col("_slot").alias("_want"), F.col("rank").alias("new_rank"))
    names = [c for c in ranked.columns if c != "rank"]
    moved = wanted.drop("_slot", "rank").join(places, "_want").select(*names, F.col("new_rank").alias("rank"))
    return moved.unionByName(joined.where("NOT _has").select(*names, "rank"))


FIELD_WEIGHTS = {"title": 1.0, "tags": 0.4, "content": 0.2}


def field_index(rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """``key, field, term, tf`` over several text fields of each row."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), tokens(text).alias("terms")) for name, text in fields.items()])
    held = rows.select(key, F.explode(parts).alias("x")).select(key, "x.field", F.explode("x.terms").alias("term"))
    return held.groupBy(key, "field", "term").agg(F.count("*").alias("tf"))


def query_terms(text: str) -> tuple[list[str], str | None]:
    """The words of a plain query, all of which must match, and their compact spelling, which may match instead if there are several."""
    words = list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))
    return words, "".join(words) if len(words) >= 2 else None


def field_scores(index: DataFrame, key: str, text: str, weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """``key, score`` of the rows that hold all of a query's words in any fields, or its compact spelling; terms count by their field's weight."""
    words, compact = query_terms(text)
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("field")]
    found = index.where(F.col("term").isin(*words, *([compact] if compact else [])))
    scored = found.groupBy(key).agg(F.countDistinct(F.when(F.col("term").isin(*words), F.col("term"))).alias("_n"), F.max(F.col("term") == F.lit(compact or "")).alias("_compact"), F.round(F.sum(weight * F.col("tf") / (F.col("tf") + 1)), 6).alias("score"))
    return scored.where((F.col("_n") == len(words)) | F.col("_compact")).select(key, "score")


def explained(lexical: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    """One row a result of either leg: its ranks from 1, scores and contributions, and their sum."""
    part = lambda d, x: d.select(key, F.col("rank").alias(f"_{x}"), F.col("score").alias(f"{x}_score"))
    rows = part(lexical, "fts").join(part(vector, "vec"), key, "full_outer")
    told = lambda x: [(F.col(f"_{x}") + 1).alias(f"{x}_rank"), f"{x}_score", F.round(scores.rrf(F.col(f"_{x}")), 9).alias(f"{x}_part")]
    return rows.select(key, *told("fts"), *told("vec"), F.round(scores.rrf(F.col("_fts")) + scores.rrf(F.col("_vec")), 9).alias("score"))


class Stage(NamedTuple):
    """A step after the search: its name, how many rows it must see for a page of ``limit``, and what it makes of ranked rows."""

    name: str
    reach: Callable[[int], int]
    apply: Callable[[DataFrame], DataFrame]


def engagement_reach(limit: int, least: float = 0.8, most: float = 1.25, k: int = scores.RRF_K) -> int:
    """The rows that can reach the first ``limit`` if every one of those has the least multiplier and a later row the most."""
    return max(limit, int((k + limit) * most / least) - k)


def piped(search: Callable[[int], DataFrame], stages: list[Stage], limit: int) -> DataFrame:
    """The search over as many rows as any stage needs, the stages in order, then the first ``limit`` rows by rank.

    Stages that can't be planned are left out, with a warning that names them, and keep the order as it was.
    """
    import warnings

    from pyspark.errors import AnalysisException

    rows = search(max([limit, *(s.reach(limit) for s in stages)]))
    for stage in stages:
        try:
            changed = stage.apply(rows)
            changed.schema  # noqa: B018  analyses the plan
        except AnalysisException as error:
            warnings.warn(f"stage {stage.name} is left out: {error.getCondition()}", stacklevel=2)
            continue
        rows = changed
    return rows.where(F.col("rank") < limit)


def with_fallback(search: Callable[[Column | None], DataFrame], embed: Callable[[], Column]) -> DataFrame:
    """The search with the query's vector, or text alone if the embedder fails; ``text_only`` says which."""
    try:
        vector = embed()
    except (ConnectionError, TimeoutError):
        vector = None
    return search(vector).withColumn("text_only", F.lit(vector is None))


def engaged(ranked: DataFrame, multipliers: DataFrame, key: str) -> DataFrame:
    """The rows re-sorted by multiplier / (60 + place), places from 1; rows without a multiplier have 1."""
    rows = ranked.join(multipliers.select(key, F.col("multiplier").alias("_m")), key, "left")
    now = F.coalesce("_m", F.lit(1.0)) / (F.col("rank") + scores.RRF_K + 1)
    return rows.withColumn("_now", F.round(now, 9)).withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("_now"), "rank")) - 1).cast("long")).drop("_m", "_now")


#: Title words that one part of the titles holds at most on average, and asked titles that meet a part at once.
HELD_WORDS, ASKED_TITLES = 1 << 21, 1 << 14


def most_shared(asked: DataFrame, titles: DataFrame, n: int, asked_count: int, held_count: int) -> DataFrame:
    """``doc_id, other, n, rank`` (from 0): for every asked row the ``n`` other rows that share the most words, ties by id.

    Both have doc_id and words, an array of distinct whole numbers.  Asked rows are dealt to blocks and all rows to parts; each block meets each
    part in a task that counts a row's words from the part's postings, and only its best ``n`` leave the task, so that no pair is exchanged.
    """
    blocks = max(1, -(-asked_count // ASKED_TITLES))
    parts = max(-(-asked.sparkSession.sparkContext.defaultParallelism // blocks), -(-held_count // HELD_WORDS))
    dealt = lambda k: F.pmod(F.xxhash64("doc_id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.select(dealt(blocks).alias("_block"), each(parts).alias("_part"), "doc_id", "words")
    right = titles.select(each(blocks).alias("_block"), dealt(parts).alias("_part"), "doc_id", "words")
    schema = pa.schema([("doc_id", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, others, counts = [], [], []
        if x.num_rows and y.num_rows:
            known, words, starts, rows = _postings(y)
            for key, held in zip(x["doc_id"].to_pylist(), x["words"]):
                asked_words = held.values.to_numpy()
                at = np.searchsorted(words, asked_words)
                spans = [rows[starts[k] : starts[k + 1]] for k in at[words[np.minimum(at, len(words) - 1)] == asked_words].tolist()] if len(words) else []
                if not spans:
                    continue
                shared = np.bincount(np.concatenate(spans))
                own = np.searchsorted(known, key)
                if own < len(shared) and known[own] == key:
                    shared[own] = 0
                found = np.flatnonzero(shared)  # in the order of ids
                if len(found) > n:
                    c = shared[found]
                    least = np.partition(c, len(c) - n)[len(c) - n]
                    more = found[c > least]
                    found = np.concatenate([more, found[c == least][: n - len(more)]])
                ids.append(np.full(len(found), key))
                others.append(known[found])
                counts.append(shared[found])
        flat = lambda a: np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64)
        return pa.table({"doc_id": flat(ids), "other": flat(others), "n": flat(counts)}, schema)

    key = ["_block", "_part"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "doc_id long, other long, n long")
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "other")
    return best.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < n)


def _postings(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the rows, ascending, their distinct words, where each word's rows begin, and those rows by their places among the ids."""
    rows = rows.sort_by("doc_id").combine_chunks()
    column = rows["words"].combine_chunks() if isinstance(rows["words"], pa.ChunkedArray) else rows["words"]
    flat, parent = column.flatten().to_numpy(), pc.list_parent_indices(column).to_numpy()
    order = np.argsort(flat, kind="stable")
    words, starts = np.unique(flat[order], return_index=True)
    return rows["doc_id"].to_numpy(), words, np.append(starts, len(flat)), parent[order].astype(np.int32)


def related(asked: DataFrame, titles: DataFrame, neighbours: DataFrame, common_share: float = 0.025, candidates: int = 10, floor: float = 0.02) -> DataFrame:
    """``doc_id, other, score``: each asked document's related ones, by shared title words that aren't common and by near vectors, fused.

    ``titles`` has doc_id and words; words of more than ``common_share`` of the titles (and more than two) say nothing.  Words that two titles
    hold, one of them asked, become numbers.  ``neighbours`` has query_id, id and rank from 1.
    """
    total = titles.count()
    known = asked.select("doc_id", F.lit(True).alias("_asked")).distinct()
    words = titles.select("doc_id", F.explode(F.array_distinct("words")).alias("word")).join(known, "doc_id", "left")
    counted = words.groupBy("word").agg(F.count("*").alias("_n"), F.count("_asked").alias("_a")).where((F.col("_n") > 1) & (F.col("_n") <= max(2, int(total * common_share))) & (F.col("_a") > 0))
    numbers = stored(counted.select("word", F.monotonically_increasing_id().alias("_id")), "title-words")  # stored, so that numbers stay
    held = stored(words.where("doc_id IS NOT NULL").join(numbers, "word").groupBy("doc_id", "_asked").agg(F.collect_set("_id").alias("words")), "title-sets")
    sizes = held.agg(F.count("_asked"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    lexical = most_shared(held.where("_asked").select("doc_id", "words"), held.select("doc_id", "words"), candidates, *sizes).select("doc_id", "other", "rank")
    near = neighbours.select(F.col("query_id").alias("doc_id"), F.col("id").alias("other"), (F.col("rank") - 1).alias("rank"))
    fused = lexical.unionByName(near).groupBy("doc_id", "other").agg(F.round(F.sum(scores.rrf(F.col("rank"))), 9).alias("score"))
    return fused.where(F.col("score") >= floor)


def top_terms(terms: DataFrame, most_docs: int, n: int) -> DataFrame:
    """``doc_id, word``: each document's ``n`` terms of most documents, among those of ``most_docs`` at most; ``terms`` is an inverted index."""
    known = terms.groupBy("term").agg(F.count("*").alias("_d")).where(F.col("_d") <= most_docs)
    order = Window.partitionBy("doc_id").orderBy(F.desc("_d"), F.desc("tf"), "term")
    return terms.join(known, "term").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).select("doc_id", F.col("term").alias("word"))
