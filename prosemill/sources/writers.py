"""Where results go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FractionalType, MapType, StructType

from prosemill.operators.integrity import input_sha256


def json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON, a line each, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def golden(scored: DataFrame, path: str, key: str = "doc_id") -> None:
    """Results in the order of their keys, in one file, to compare later runs with. For small sets."""
    scored.coalesce(1).sortWithinPartitions(key).write.json(path)


def differing(found: DataFrame, golden: DataFrame, key: str = "doc_id", tolerance: float = 0.5) -> DataFrame:
    """key, field, wanted, got of what differs from golden results: numbers with a fraction by more than tolerance.

    All else must be equal, and null where it is null. A row that only one side has differs in every field that isn't null.
    """
    fields = [(f.name, f.dataType) for f in golden.schema if f.name != key]
    both = golden.select(key, F.struct(*[F.col(n) for n, _ in fields]).alias("wanted")).join(
        found.select(key, F.struct(*[F.col(n).cast(t).alias(n) for n, t in fields]).alias("got")), key, "full"
    )

    def differs(name: str, kind: DataType) -> Column:
        a, b = F.col("wanted")[name], F.col("got")[name]
        if isinstance(kind, FractionalType):
            return F.when(a.isNull() | b.isNull(), a.isNotNull() | b.isNotNull()).otherwise(F.abs(a - b) > tolerance)
        return ~a.eqNullSafe(b)

    def text(side: str, name: str, kind: DataType) -> Column:
        value = F.col(side)[name]
        return F.to_json(value) if isinstance(kind, (ArrayType, MapType, StructType)) else value.cast("string")

    rows = [
        F.when(differs(n, t), F.struct(F.lit(n).alias("field"), text("wanted", n, t).alias("wanted"), text("got", n, t).alias("got"))) for n, t in fields
    ]
    return both.select(key, F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))


def audit_log(scored: DataFrame, event: str = "score") -> DataFrame:
    """One JSON line for each document: sizes, codes and flags, never its text. Fields are in the order of names."""

    def field(name: str, value: Column) -> Column:
        return value.alias(name)

    return scored.select(
        F.to_json(
            F.struct(
                field("error", F.col("error.error")), field("event", F.lit(event)), field("flags", F.col("flags")),
                field("input_sha256", input_sha256(F.col("text"))), field("lang", F.col("language.lang")), field("n_chars", F.length("text")),
                field("status", F.col("gate.status")), field("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")),
                field("warnings", F.col("lexical.warnings")),
            ),
            {"ignoreNullFields": "false"},
        ).alias("line")
    )


def observed(scored: DataFrame, name: str = "scored") -> tuple[DataFrame, object]:
    """The rows, with counts that Spark takes as they pass: documents, errors, passed gates."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return scored.observe(
        seen, F.count("*").alias("documents"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("gate.status") == "OK").alias("passed")
    ), seen
