"""Evaluation queries: vectors of a label as relevant rows of the label's first vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, search
from ..sources import tables
from .registry import query

RANKED = "(SELECT query_id, label, id, hit, rank FROM (SELECT q.vec_id AS query_id, q.label, e.vec_id AS id, e.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) q WHERE e.vec_id <> q.vec_id) WHERE rank <= 20)"
PER = f"""(SELECT query_id, label, round(coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE hit AND rank <= 5), 0) / (SELECT sum(1 / log2(r + 1)) FROM range(1, 6) t(r)), 6) AS ndcg, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE hit), 0), 6) AS mrr,
round(count(*) FILTER (WHERE hit) / (SELECT count(*) - 1 FROM embeddings z WHERE z.label = g.label)::DOUBLE, 6) AS recall FROM {RANKED} g GROUP BY 1, 2)"""


def _ranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = tables.embeddings(spark, sf)
    firsts = vectors.groupBy("label").agg(F.min("id").alias("id"))
    queries = vectors.join(firsts, ["label", "id"], "left_semi")
    ranked = search.nearest_neighbours(queries, vectors, 20)
    relevant = vectors.join(firsts.select("label", F.col("id").alias("query_id")), "label").where("id <> query_id").select("query_id", "id")
    return ranked, relevant, firsts.select(F.col("id").alias("query_id"), F.col("label").cast("string").alias("category"))


@query(f"SELECT query_id, ndcg, mrr, recall FROM {PER}")
def ndcg_mrr_recall(spark: SparkSession, sf: str) -> DataFrame:
    ranked, relevant, _ = _ranked(spark, sf)
    return evaluation.metrics(ranked, relevant)


@query(f"SELECT coalesce(CAST(label AS VARCHAR), 'all') AS category, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall FROM {PER} GROUP BY ROLLUP (label)")
def category_means(spark: SparkSession, sf: str) -> DataFrame:
    ranked, relevant, categories = _ranked(spark, sf)
    return evaluation.category_means(evaluation.metrics(ranked, relevant), categories)


@query(
    f"""WITH a AS (SELECT CAST(label AS VARCHAR) AS category, ndcg, mrr, recall FROM {PER})
SELECT category, metric, round(-0.01 * v, 6) AS delta FROM (SELECT category, 'ndcg' AS metric, ndcg AS v FROM a UNION ALL SELECT category, 'mrr', mrr FROM a UNION ALL SELECT category, 'recall', recall FROM a) WHERE round(-0.01 * v, 6) < -0.0001"""
)
def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics that fell, against a run one percent worse."""
    ranked, relevant, categories = _ranked(spark, sf)
    before = evaluation.metrics(ranked, relevant).join(categories, "query_id").select("category", "ndcg", "mrr", "recall")
    after = before.select("category", *[(F.col(c) * 0.99).alias(c) for c in ("ndcg", "mrr", "recall")])
    return evaluation.regressions(before, after)


@query(
    """SELECT count(*) FILTER (WHERE f AND g) AS tp, count(*) FILTER (WHERE f AND NOT g) AS fp, count(*) FILTER (WHERE NOT f AND g) AS fn,
round(2 * count(*) FILTER (WHERE f AND g) / (2 * count(*) FILTER (WHERE f AND g) + count(*) FILTER (WHERE f <> g))::DOUBLE, 6) AS f1 FROM (SELECT quality = 1 AS f, toxic = 0 AS g FROM labels) WHERE f OR g"""
)
def micro_f1(spark: SparkSession, sf: str) -> DataFrame:
    labels = tables.table(spark, sf, "labels")
    return evaluation.micro_f1(labels.where("quality = 1"), labels.where("toxic = 0"), ["doc_id"])


@query(
    """SELECT conv_id AS id, round(avg(CASE WHEN contains(lower(answer), lower(fact)) THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM (SELECT conv_id, split_part(text, ' ', 1) AS fact FROM conversations WHERE role = 'user') JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1) USING (conv_id) GROUP BY 1"""
)
def answer_fact_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the users' first words the answers hold."""
    turns = tables.table(spark, sf, "conversations")
    facts = turns.where("role = 'user'").select(F.col("conv_id").alias("id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("fact"))
    answers = turns.where("role = 'assistant'").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("answer"))
    return evaluation.fact_recall(answers, facts.join(answers.select("id"), "id", "left_semi"), 1.01)
