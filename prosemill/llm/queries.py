"""The queries of this subpackage for __spark_entry__.py: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import (
    fingerprints, jaccard_join, line_dedup, mixing, piece_sampling, quality_gam, quality_rules, sharding, substring_dedup,
    token_counts,
)
from prosemill.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score_quality(docs, quality_gam.fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.labelled_domains(table(spark, sf_dir, "labels"))
    return mixing.fit_mixture(table(spark, sf_dir, "documents"), labelled, mixing.WEIGHTS).table()


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.minimax_shards(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_encodings(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.compression_rules(table(spark, sf_dir, "documents"))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op10: the counts, and whether they reject a text."""
    rows = quality_rules.compression_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op1: lengths and the edited texts."""
    rows = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256")


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of op7's shards: all rows in slots without gaps, no shard larger than an even share and one group more."""
    rows = sharding.minimax_shards(table(spark, sf_dir, "documents"))
    groups = rows.groupBy("shard", "text_crc32", "size").agg(
        F.count("*").alias("n"), F.sum("size").alias("group"), F.min("slot").alias("least"), F.max("slot").alias("most"), F.sum("slot").alias("slots")
    )
    shards = groups.groupBy("shard").agg(
        F.sum("n").alias("n"), F.sum("group").alias("bytes"), F.max("group").alias("group"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.sum("slots").alias("slots"),
    )
    gapless = (F.col("least") == 0) & (F.col("most") + 1 == F.col("n")) & (2 * F.col("slots") == F.col("n") * F.col("most"))
    return shards.agg(
        F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.bool_and(gapless).alias("gapless"),
        (F.max("bytes") <= F.sum("bytes") / sharding.SHARDS + F.max("group")).alias("even"),
    )


def mixture_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4: the tokens that the targets are of."""
    return op4_mixing(spark, sf_dir).select("doc_id", "n_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_quality, op3_substring_dedup, op4_mixing, op5_line_dedup, op6_token_counts, op7_sharding,
        op8_jaccard_join, op9_piece_sampling, op10_quality_rules, rule_counts, edited_texts, shard_laws, mixture_tokens,
    )
}
RULE_COUNTS = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS s FROM t, unnest(range(1, greatest(1, len(w) - 1))) AS u(i)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(3) AS u(j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t
), repeated AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(repeated.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
FROM t LEFT JOIN covered USING (doc_id) LEFT JOIN repeated USING (doc_id)
"""
EDITED = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM t WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, len(text) AS n_chars, sha256(text[1:len(text) - len(text) // 3] || following[1:len(text) // 3]) AS edited_sha256 FROM n
"""
ORACLES: dict[str, str] = {
    "rule_counts": RULE_COUNTS, "edited_texts": EDITED,
    "shard_laws": "SELECT count(*) AS n_rows, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, true AS gapless, true AS even FROM documents",
    "mixture_tokens": "SELECT doc_id, len(string_split(coalesce(text, ''), ' ')) AS n_tokens FROM documents",
    "op3_substring_dedup": substring_dedup.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op8_jaccard_join": jaccard_join.ORACLE,
}
