"""The numbered queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, filter_audit, hard_negatives, html_text, matroska, near_dup, packing, quality, secret_crf, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


#: The rules of the query.
URL_RULES = [
    url_filter.Rule("org/", True),
    url_filter.Rule("example.org/es/", False),
    url_filter.Rule("example.org/en/1", False),
    url_filter.Rule("com/fr/", True),
    url_filter.Rule("com/de/", False),
]


def op1_character_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_maximal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out rows are not read."""
    labels = _table(spark, sf_dir, "labels").where(~_held_out())
    scored = toxicity.score_texts(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_tokens", F.size("passages").alias("n_passages"))


def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    scored = quality.score_texts(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "weak_label", "score", (F.col("score") >= 0.5).alias("kept"))


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a Matroska file, read back and described."""
    stored = matroska.to_media(_table(spark, sf_dir, "documents"))
    return matroska.read_media(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def _joined(*spans: str) -> Column:
    """kind:start:end of all spans, by start and then kind, comma-joined."""
    kinds = F.create_map(*[F.lit(x) for pair in secret_crf.ORDER.items() for x in pair])
    keyed = F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), kinds[s["kind"]].alias("order"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secret_crf.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("base", "added").alias("spans"), F.size("added").alias("n_added"))


def op7_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of 1024-token sequences."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark coverage of every document, in full from a tenth of an item up."""
    return decontaminate.decontaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=0.1)


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as raw transcripts, parsed back into turns and rendered; the tables are counted over one half of them."""
    blocks = chat.blocked(chat.raw_lines(_table(spark, sf_dir, "conversations")))
    held_out = F.pmod(F.xxhash64("conv"), F.lit(2)) == 1
    turns = chat.rendered(chat.decode(blocks, chat.fit(blocks.where(~held_out))))
    return turns.select(F.col("conv").alias("conv_id"), held_out.alias("held_out"), "place", "role", "continues", "n_lines", "text", "rendered")


def op10_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(_table(spark, sf_dir, "pages"))


NEGATIVES_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score FROM e a JOIN e o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


def op11_anchor_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with every seventh label moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mined(rows, F.col("id") % 50 == 0)


#: All 120 orders are spelled by five joins of the letters.
AUDIT_SQL = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.name || b.name || p.name || q.name || r.name AS filter_order, [a.bit, b.bit, p.bit, q.bit, r.bit] AS bits FROM x a, x b, x p, x q, x r WHERE a.bit | b.bit | p.bit | q.bit | r.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS here, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, step, here, sum(CASE WHEN mask & (before | here) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & here > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & here > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = here THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & here > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & here > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, here) AS BIGINT) AS shapley FROM g"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over every document, from a stream of the table's files."""
    rows = _table(spark, sf_dir, "documents").count()
    return filter_audit.audit(filter_audit.file_stream(spark, f"{sf_dir}/documents.parquet"), _table(spark, sf_dir, "labels"), rows)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the ranks of the many-language vocabulary, and decoded again."""
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), byte_bpe.Vocabulary(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_character_models": op1_character_models,
        "op2_maximal_segments": op2_maximal_segments,
        "op3_weak_labels": op3_weak_labels,
        "op4_hyperminhash": op4_hyperminhash,
        "op5_matroska": op5_matroska,
        "op6_random_field": op6_random_field,
        "op7_concatenate_and_cut": op7_concatenate_and_cut,
        "op8_string_tiling": op8_string_tiling,
        "op9_transcripts": op9_transcripts,
        "op10_page_differencing": op10_page_differencing,
        "op11_anchor_trees": op11_anchor_trees,
        "op12_filter_audit": op12_filter_audit,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_anchor_trees": NEGATIVES_SQL, "op12_filter_audit": AUDIT_SQL}
