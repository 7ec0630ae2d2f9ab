"""Line dedup by distinct-site spread.

A line that many sites carry is boilerplate. HyperLogLog sketches of the sites are kept for each line hash
and merge in the aggregation; lines whose estimate lies near the threshold get an exact distinct count. Of a
boilerplate line the first occurrence stays (smallest doc_id, then position); the others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import col, columns_of, order_id, text_key, unused, written

#: Sites from which on a line is boilerplate; so far from it (as a share) an estimate needs no exact count.
MIN_SITES, NEAR = 10, 0.35
#: log2 of the sketches' buckets: a relative error of about 3 %, ten times less than NEAR.
LOG_BUCKETS = 10
SECOND_SEED = "prosemill-line"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row for each line with a word: a 128-bit hash, site, document and position."""
    line = F.col("line")
    # sketches pass over empty strings, so a site's name gets a letter in front
    site = F.coalesce(F.concat(F.lit("s"), col(site_col).cast("string")), F.lit("n"))
    return (
        docs.select(
            order_id(id_col).alias("dk"), text_key(text_col).alias("th"), site.alias("site"),
            F.posexplode(F.split(F.coalesce(col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"),
        )
        .where(line.rlike("[^ \\t-\\r]"))
        .select(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(SECOND_SEED), line).alias("h2"), "site", "dk", "th", "pos")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """The hashes of lines on at least min_sites sites, each with its first occurrence."""
    spread = (
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS))).alias("estimate"),
            F.min(F.struct("dk", "th", "pos")).alias("first"),
        )
        .where(F.col("estimate") >= min_sites * (1 - near))
    )
    spread = written(spread, "line-spread")
    doubtful = spread.where(F.col("estimate") < min_sites * (1 + near)).select("h1", "h2")
    exact = (
        lines.select("h1", "h2", "site")
        .join(doubtful, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2")
        .agg(F.count_distinct("site").alias("sites"))
    )
    return (
        spread.join(exact, ["h1", "h2"], "left")
        .where(F.coalesce("sites", "estimate") >= min_sites)
        .select("h1", "h2", "first")
    )


def _marked(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int) -> tuple[DataFrame, Column, Column, Column]:
    """docs with the positions of the lines that go; that column, all lines, and the lines that stay."""
    dk, th, gone_at = unused(docs, "line_id", "line_text", "line_gone")
    lines = _lines(docs, id_col, text_col, site_col)
    found = written(boilerplate(lines, min_sites), "boilerplate")
    gone = (
        lines.join(found, ["h1", "h2"])
        .where(F.struct("dk", "th", "pos") != F.col("first"))
        .groupBy(F.col("dk").alias(dk), F.col("th").alias(th))
        .agg(F.collect_set("pos").alias(gone_at))  # as many as the text has lines
    )
    out = docs.withColumns({dk: order_id(id_col), th: text_key(text_col)}).join(gone, [dk, th], "left")
    every = F.split(col(text_col), "\n", -1)
    stays = F.filter(every, lambda _, i: ~F.array_contains(gone_at, i))
    return out, F.col(gone_at), every, F.when(F.col(gone_at).isNull(), every).otherwise(stays)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for each row of docs.

    Lines are what stands between line feeds; a line without a word is never removed. A null site is a site
    of its own. A null text has no lines and stays null; so does a null id, which counts as the smallest.
    Repeated rows (same id and text) are one occurrence and lose the same lines. Without rows there are none.
    """
    plain = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(site_col).alias("source"))
    marked, gone, every, stays = _marked(plain, "doc_id", "text", "source", min_sites)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(every))
    return marked.select(
        F.col("doc_id").cast("long"), n.cast("long").alias("n_lines"), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("kept_text"),
    )


def drop_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """docs, with all their columns, whatever their names, without boilerplate lines.

    Texts that lose their last word go; null and empty texts, which have none to lose, stay as they are. Nulls, repeated
    rows and empty tables are as in line_dedup().
    """
    marked, gone, _, stays = _marked(docs, id_col, text_col, site_col, min_sites)
    left = F.when(gone.isNull(), col(text_col)).otherwise(F.array_join(stays, "\n"))
    emptied = gone.isNotNull() & ~left.rlike("[^ \\t-\\r]")
    kept = [left.alias(c) if c == text_col else col(c) for c in docs.columns]
    return marked.where(~emptied).select(*kept)


ORACLE = f"""
WITH lines AS (
  SELECT coalesce(doc_id, -9223372036854775808) AS dk, coalesce(source, '') AS site,
         unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), spread AS (
  SELECT line, min(struct_pack(dk := dk, pos := pos)) AS first FROM lines
  WHERE regexp_matches(line, '[^ \\t-\\r]') GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), kept AS (
  SELECT dk, pos, line, s.first IS NOT NULL AND s.first <> struct_pack(dk := dk, pos := pos) AS gone
  FROM lines l LEFT JOIN spread s USING (line)
), texts AS (
  SELECT dk, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
  FROM kept GROUP BY dk
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept_text) AS kept_sha256
FROM documents LEFT JOIN texts ON dk = doc_id
"""
