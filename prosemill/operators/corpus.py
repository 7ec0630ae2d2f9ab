"""Statistics of a scored corpus: correlations, effective weights, the share of length, group means."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.policy import COMPONENTS, Policy


def settled(df: DataFrame) -> DataFrame:
    """df, whose computed columns are worked out once a row: no expression above reaches through the generator."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def complete(scored: DataFrame, columns: tuple[str, ...] = tuple(COMPONENTS)) -> DataFrame:
    """Rows that have every component."""
    return scored.dropna(subset=list(columns))


def nominal_index(policy: Policy = Policy()) -> Column:
    return reduce(Column.__add__, [F.col(k) * w for k, w in policy.weights.items()])


def correlations(scored: DataFrame, columns: tuple[str, ...] = tuple(COMPONENTS)) -> DataFrame:
    """a, b, r for each pair of components over complete rows; null where one of them is constant. One pass."""
    pairs = list(combinations(columns, 2))
    row = complete(scored, columns).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return row.select(F.inline(items))


def effective_weights(scored: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """component, weight: nominal weight times the component's covariance with the index over the index's variance."""
    rows = complete(scored).withColumn("__index", nominal_index(policy))
    row = rows.agg(F.var_pop("__index").alias("v"), *[F.covar_pop(k, "__index").alias(k) for k in policy.weights])
    items = F.array(*[F.struct(F.lit(k).alias("component"), F.try_divide(w * F.col(k), F.col("v")).alias("weight")) for k, w in policy.weights.items()])
    return row.select(F.inline(items))


def length_share(scored: DataFrame, sentence_length: str, word_length: str, policy: Policy = Policy()) -> DataFrame:
    """r2 of the index on mean sentence and word length, in closed form from three correlations."""
    rows = complete(scored).dropna(subset=[sentence_length, word_length]).withColumn("__index", nominal_index(policy))
    row = rows.agg(F.corr("__index", sentence_length).alias("a"), F.corr("__index", word_length).alias("b"), F.corr(sentence_length, word_length).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return row.select(F.try_divide(a * a + b * b - 2 * a * b * c, 1 - c * c).alias("r2"))


def group_means(scored: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return scored.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def study_markdown(scored: DataFrame, sentence_length: str, word_length: str, policy: Policy = Policy()) -> str:
    """The study as Markdown, from a dozen aggregates."""
    rows = complete(scored)
    lines = ["# Components", "", f"Documents: {rows.count()}", "", "| a | b | r |", "|-|-|-|"]
    number = lambda x: "-" if x is None else f"{x:.3f}"
    lines += [f"| {r['a']} | {r['b']} | {number(r['r'])} |" for r in correlations(rows).collect()]
    lines += ["", "| component | effective weight |", "|-|-|"]
    lines += [f"| {r['component']} | {number(r['weight'])} |" for r in effective_weights(rows, policy).collect()]
    share = length_share(rows, sentence_length, word_length, policy).first()["r2"]
    return "\n".join([*lines, "", f"Share of the index that lengths explain: {number(share)}", ""])


def status_counts(gated: DataFrame, lang: str = "lang", status: str = "status") -> DataFrame:
    """Documents by language and status, with subtotals (nulls)."""
    return gated.rollup(lang, status).agg(F.count("*").alias("n"))
