"""Retrieval evaluation over ranked rows and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..sources.shared import stored


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5, recall_k: int = 20) -> DataFrame:
    """``query_id, ndcg, mrr, recall`` of rankings (query_id, id, rank from 1) against relevant ids; a repeated id counts at its best rank.

    A query without a hit scores zero; the ideal gain has as many relevant rows as fit in ``k``.
    """
    rows = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    judged = relevant.select("query_id", "id").distinct()
    totals = judged.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = rows.join(judged, ["query_id", "id"])
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, scores.dcg_gain(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.min("rank").alias("first"), F.count_if(F.col("rank") <= recall_k).alias("found")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + scores.dcg_gain(r))
    out = totals.join(got, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("query_id", zero(F.col("dcg") / ideal).alias("ndcg"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("found") / F.col("n")).alias("recall"))


def category_means(per_query: DataFrame, categories: DataFrame) -> DataFrame:
    """``category, queries, ndcg, mrr, recall`` means, with ``all`` over everything."""
    rows = per_query.join(categories, "query_id")
    mean = [F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "mrr", "recall")]]
    return rows.rollup("category").agg(*mean).withColumn("category", F.coalesce("category", F.lit("all")))


def regressions(before: DataFrame, after: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """``category, metric, delta`` of means that fell by more than the tolerance."""
    tall = lambda d: d.select("category", F.expr("stack(3, 'ndcg', ndcg, 'mrr', mrr, 'recall', recall) AS (metric, value)"))
    both = tall(before).withColumnRenamed("value", "old").join(tall(after), ["category", "metric"])
    return both.select("category", "metric", F.round(F.col("value") - F.col("old"), 6).alias("delta")).where(F.col("delta") < -tolerance)


def micro_f1(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """``tp, fp, fn, f1`` of two sets of rows."""
    a, b = found.select(*keys).distinct().withColumn("_f", F.lit(1)), gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = a.join(b, keys, "full_outer").agg(F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    return both.withColumn("f1", F.round(F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(1.0), 6))


def fact_recall(answers: DataFrame, facts: DataFrame, least: float = 0.6) -> DataFrame:
    """``id, recall``: share of a question's facts that its answer holds, as a substring or by the share of the fact's words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    rows = facts.join(answers, "id", "left")
    share = F.size(F.array_intersect(words(F.col("fact")), words(F.coalesce("answer", F.lit(""))))) / F.greatest(F.size(words(F.col("fact"))), F.lit(1))
    hit = F.coalesce(F.contains(F.lower("answer"), F.lower("fact")), F.lit(False)) | (share >= least)
    return rows.groupBy("id").agg(F.round(F.avg(hit.cast("int")), 6).alias("recall"))


def set_matches(actual: DataFrame, expected: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``precision, recall, f1`` of sets (``set_id, member``) matched one to one: pairs by falling Jaccard similarity from ``threshold`` up, mutual best first.

    Only sets that share a member meet, and each round matches all pairs that are the best of both sides, which is what taking one pair after
    the other does; the matched ones leave.
    """
    a, b = actual.select(F.col("set_id").alias("a"), "member").distinct(), expected.select(F.col("set_id").alias("b"), "member").distinct()
    na, nb = a.groupBy("a").agg(F.count("*").alias("na")), b.groupBy("b").agg(F.count("*").alias("nb"))
    both = a.join(b, "member").groupBy("a", "b").agg(F.count("*").alias("n")).join(na, "a").join(nb, "b")
    pairs = stored(both.select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j")).where(F.col("j") >= threshold), "pairs")
    hits = 0
    while True:
        best = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("j"), "a", "b")) == 1
        taken = stored(pairs.withColumn("_x", best("a")).withColumn("_y", best("b")).where("_x AND _y").select("a", "b"), "taken")
        found = taken.count()
        if not found:
            break
        hits += found
        pairs = stored(pairs.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"), "pairs")
    of, wanted = na.count(), nb.count()
    p, r = hits / of if of else 0.0, hits / wanted if wanted else 0.0
    return actual.sparkSession.createDataFrame([(round(p, 6), round(r, 6), round(2 * p * r / (p + r), 6) if hits else 0.0)], "precision double, recall double, f1 double")
