"""Connected components by alternating large stars and small stars; nothing but aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prosemill.llm.common import dropped, written


def _observed(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """edges written, and what tells whether they change: their number and a sum of hashes, taken along the way."""
    seen = Observation(name)
    total = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    out = written(edges.observe(seen, F.count("*").alias("n"), total.alias("total")), name)
    return out, (seen.get["n"], seen.get["total"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp for each node of edges (columns a, b, of any ordered type): comp is its component's least node.

    The nodes of an edge may be equal; such edges and edges with a null say nothing. Repeated edges count once. Without
    edges there are no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now, state = _observed(pairs.distinct(), "edges")
    before = None
    while state[0] and state != before:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, "large-star")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(down, "hi")
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(down)
        old, before = now, state
        now, state = _observed(small.distinct(), "small-star")
        dropped(large, old)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct()
    )
