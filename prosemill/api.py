"""The tools as functions of DataFrames, and the scalar ones as SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prosemill.operators.compose import rank_within_language, same_language
from prosemill.operators.lexical import mattr_of, mtld_of, vocd_of
from prosemill.operators.report import generate_report
from prosemill.plans.pipeline import (
    Providers, score_documents, with_complexity_band, with_gate, with_iq, with_language, with_language_errors, with_lexical, with_mental_age,
    with_preprocess, with_readability, with_semantic, with_style_index, with_syntactic,
)
from prosemill.policy import Policy

#: The twelve tools and the stage that each is. A stage reads the structs of those before it and adds its own, so each
#: can be called by itself on rows that have what it needs.
TOOLS = {
    "detect_language": with_language, "preprocess": with_preprocess, "evaluate_gates": with_gate, "analyze_lexical": with_lexical,
    "analyze_syntactic": with_syntactic, "analyze_semantic": with_semantic, "analyze_readability": with_readability,
    "style_index": with_style_index, "predict_iq": with_iq, "predict_mental_age": with_mental_age, "complexity_band": with_complexity_band,
    "generate_report": generate_report,
}

__all__ = ["TOOLS", "Policy", "Providers", "rank_within_language", "register_sql", "same_language", "score_documents", "with_language_errors"]


class ExplainDocument:
    """Rows of (kind, idx, sentence, words) for the sentences of a text: a table function."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str, int]]:
        import re

        for i, s in enumerate(re.split(r"(?<=[.!?])\s+", (text or "").strip())):
            if s:
                yield i, s, len(re.findall(r"[^\W\d_]+", s))


def register_sql(spark: SparkSession) -> None:
    """SQL functions mattr, mtld, vocd (of a text's letter runs) and the table function explain_document."""

    def measured(f):
        @F.pandas_udf("double")
        def of(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else f([w.lower() for w in pd.Series([t]).str.findall(r"[^\W\d_]+")[0]])).astype("float64")

        return of

    for name, f in (("mattr", mattr_of), ("mtld", mtld_of), ("vocd", vocd_of)):
        spark.udf.register(name, measured(f))
    spark.udtf.register("explain_document", F.udtf(ExplainDocument, returnType="idx int, sentence string, words int"))
