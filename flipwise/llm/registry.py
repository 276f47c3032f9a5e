"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .alignment import alignment_digest
from .common import table
from .exact_dedup import exact_groups
from .near_dedup import near_classes
from .packing import pack
from .pii import personal_data
from .quality_model import judged
from .quality_rules import apply_policy, ledger
from .spelling import spelling_sql, spelling_variants
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .token_index import token_shards
from .warc import archive


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(spark, table(spark, sf_dir, "documents"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", F.col("__expected_grade").alias("expected_grade"), F.col("__tail").alias("tail_probability"), F.col("__kept").alias("kept"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    levels = mixing.document_levels()
    taken = mixing.mix(docs, levels, mixing.WEIGHTS, fraction=mixing.FRACTION, max_epochs=mixing.EPOCHS, seed=mixing.SEED)
    named = {n: F.coalesce(c, F.lit(mixing.NONE)) for n, c in levels.items()}
    return taken.select("doc_id", *(c.alias(n) for n, c in named.items()), F.col("__n_tokens").alias("n_tokens"),
                        F.col("__epochs").alias("n_epochs"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "fail_bits", "policy")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_personal_data": op3_personal_data,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {i + 1}, 5))::INT >> {s}) & 31) + 1, 1)"
                      for i in range(0, 40, 5) for s in (15, 10, 5, 0))
_WORD = r"[^\x20\x09-\x0D]+"
SQL: dict[str, str] = {
    "op2_warc_bundles": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY h, payload_bytes) AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to FROM d""",
    "op6_mixing": mixing.mixing_sql(),
    "op7_exact_dedup": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d""",
    "op11_spelling_variants": spelling_sql(),
    "op12_suffix_dedup": """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS o, hex(coalesce(text, '')) AS x, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
ch AS (SELECT o, n_bytes, unnest(list_transform(range((n_bytes + 199) // 200), lambda j: x[400 * j + 1:400 * j + 598])) AS y,
  unnest(range((n_bytes + 199) // 200)) AS j FROM d),
w AS (SELECT o, unnest(list_transform(range(least(200, n_bytes - 200 * j)), lambda k: CASE WHEN 200 * j + k + 100 <= n_bytes THEN md5(y[2 * k + 1:2 * k + 200]) END)) AS h,
  unnest(list_transform(range(least(200, n_bytes - 200 * j)), lambda k: 200 * j + k)) AS i,
  unnest(list_transform(range(least(200, n_bytes - 200 * j)), lambda k: y[2 * k + 1:2 * k + 2])) AS byte FROM ch),
s AS (SELECT o, i, byte, CASE WHEN h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY o, i) > 1 THEN 1 ELSE 0 END AS again FROM w),
c AS (SELECT o, i, byte, max(again) OVER (PARTITION BY o ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM s),
e AS (SELECT o, i, byte, gone, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY o ORDER BY i) AS opens FROM c),
k AS (SELECT o, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY o)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (o)""",
}
