"""The corpus pipeline: raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import table, written
from prosemill.llm.jaccard_join import keep_one
from prosemill.llm.line_dedup import drop_boilerplate
from prosemill.llm.mixing import WEIGHTS, fit_mixture, labelled_domains
from prosemill.llm.piece_sampling import sample_encodings
from prosemill.llm.quality_rules import keep_by_rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and the counts reject go, null and empty texts with them. Equal rows fare alike."""
    return keep_by_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites carry go, but for their first occurrence; documents left without a word go.

    n_chars follows the text. A null source is a site of its own; null texts have no lines; equal rows lose the same lines.
    """
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of equal rows one.

    A null id counts as the smallest; documents without words stay.
    """
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken at the rates that bring the domains to their target weights.

    Null ids and labels teach nothing, a null text counts as empty, equal rows get the same decision. Without labels all stay.
    """
    return fit_mixture(docs, labelled_domains(table(spark, sf_dir, "labels")), WEIGHTS).apply(docs)


def piece_sampling(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with their pieces' ids. A null or empty text has one, without pieces."""
    return sample_encodings(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("piece_sampling", piece_sampling),
]

#: SQL can express neither the compression ratios nor the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
