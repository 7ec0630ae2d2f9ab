"""Token counts: the exact histogram of encoded lengths.

Documents are encoded whole and counted by length. Suffix sums over the histogram, whose size is bounded by
the longest document and not by their number, answer totals, quantiles and truncated totals for every limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm.common import col, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern of that vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoded_lengths(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """doc_id, n_tokens for each row of docs. A null text has none. Special tokens' strings are plain text.

    The vocabulary file is read on the driver and sent to the executors; its size is fixed.
    """
    spark: SparkSession = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for batch in slices(batches):
            counts = [len(encoding.encode_ordinary(x)) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long"
    )


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """A row for each length: its documents, and what the suffix sums say for a context limit of that length.

    docs_at_least and tokens_at_least count documents of this length or more; fitting_share is the share of
    documents that fit whole; truncated_tokens is the total when every document is cut at this length. Null
    lengths count as 0; documents of the same length, repeated rows among them, are one row. An empty table gives no rows.
    """
    hist = (
        lengths.select(F.coalesce(col(column), F.lit(0)).cast("long").alias("length"))
        .groupBy("length")
        .agg(F.count("*").alias("docs"))
        .withColumn("tokens", F.col("length") * F.col("docs"))
    )
    up = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    docs, tokens = F.sum("docs").over(whole), F.sum("tokens").over(whole)
    return (
        hist.withColumns({
            "docs_at_least": F.sum("docs").over(up), "tokens_at_least": F.sum("tokens").over(up),
            "all_docs": docs, "all_tokens": tokens,
        })
        .select(
            "length", "docs", "tokens", "docs_at_least", "tokens_at_least",
            ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("fitting_share"),
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        )
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """length: the smallest length that at least the share q of the documents doesn't exceed."""
    return histogram.where(F.col("fitting_share") >= q).agg(F.min("length").alias("length"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """tokens: the total when every document is cut at limit, a recorded length or not."""
    capped = F.least("length", F.lit(limit))
    return histogram.agg(F.coalesce(F.sum(capped * F.col("docs")), F.lit(0)).alias("tokens"))
