"""The catalogue of queries over the driver's tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.functions import sanitize, text as T
from prosemill.operators import boundary, compose, corpus, integrity, language, lexical, readability, semantic, syntactic
from prosemill.operators.report import generate_report
from prosemill.plans.pipeline import score_documents, with_gate, with_language, with_lexical, with_preprocess
from prosemill.policy import Policy
from prosemill.sources.readers import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
POLICY = Policy()
#: The limit of the size guard's query, low enough for some texts to exceed it.
GUARD_CHARS = 10_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a small table read as one file would use one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(tables(spark, sf_dir, "documents").select("doc_id", *columns))


# SQL of the text primitives.
CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'http\\S+|www\\S+', '', 'g'), "
    "'[@#][\\p{L}\\p{M}\\p{N}_]+', '', 'g'), '\\s+', ' ', 'g'))"
)
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: len(x) > 0)"
WORDS = "list_transform(regexp_extract_all(c, '\\p{L}+'), lambda x: lower(x))"
BASE = f"""cleaned AS (SELECT doc_id, lang, source, text, {CLEAN} AS c FROM documents),
base AS (SELECT doc_id, lang, source, text, c, {WORDS} AS w, {SENTENCES} AS s FROM cleaned)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, c (clean text), w (words), s (sentences)."""
    rows = documents(spark, sf_dir, "lang", "text").withColumn("c", T.cleaned("text"))
    return rows.select("doc_id", "lang", "text", "c", T.words("c").alias("w"), T.sentences("c").alias("s"))


@query(f"""WITH {BASE} SELECT doc_id, len(text) AS n_chars, len(w) AS n_words,
  len(regexp_extract_all(c, '\\p{{L}}+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{N}}\\p{{P}}]')) AS n_tokens, len(regexp_extract_all(c, '[.!?…]+')) AS n_marks,
  round(len(w) / greatest(1, len(regexp_extract_all(c, '[.!?…]+'))), 6) AS words_per_mark FROM base""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "text").withColumn("c", T.cleaned("text"))
    marks = T.terminal_marks("c")
    return rows.select(
        "doc_id", F.length("text").alias("n_chars"), T.word_count("c").alias("n_words"), T.token_count("c").alias("n_tokens"),
        marks.alias("n_marks"), F.round(T.word_count("c") / F.greatest(F.lit(1), marks), 6).alias("words_per_mark"),
    )


@query(f"SELECT doc_id, sha256({CLEAN}) AS clean_sha256, len({CLEAN}) AS clean_length FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "text").withColumn("c", T.cleaned("text"))
    return rows.select("doc_id", F.sha2(F.col("c").cast("binary"), 256).alias("clean_sha256"), F.length("c").alias("clean_length"))


@query(f"SELECT doc_id, CASE WHEN len(text) > {GUARD_CHARS} THEN 'INPUT_TOO_LARGE' END AS error FROM documents")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = boundary.too_large(F.col("text"), POLICY, GUARD_CHARS)
    return documents(spark, sf_dir, "text").select("doc_id", error["error"].alias("error"))


@query(f"WITH {BASE} SELECT doc_id, len(s) AS n_sentences, round(len(w) / greatest(1, len(s)), 6) AS mean_words FROM base")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("s")
    return base(spark, sf_dir).select("doc_id", n.alias("n_sentences"), F.round(F.size("w") / F.greatest(F.lit(1), n), 6).alias("mean_words"))


GATES = f"""{BASE}, marks AS (SELECT *, len(w) AS n, len(w) / greatest(1, len(regexp_extract_all(c, '[.!?…]+'))) AS per FROM base),
found AS (SELECT doc_id, lang, unnest(list_filter([
  CASE WHEN lang IS NULL OR lang NOT IN ('en', 'id') THEN 'UNSUPPORTED_LANGUAGE' END, CASE WHEN n < 250 THEN 'INSUFFICIENT_TEXT' END,
  CASE WHEN n > 0 AND per > 40 THEN 'INSUFFICIENT_STRUCTURE' END, 'UNVERIFIED_PROVENANCE', 'UNVALIDATED',
  CASE WHEN lang IN ('en', 'id') THEN 'UNVALIDATED' END], lambda x: x IS NOT NULL)) AS status FROM marks),
ranked AS (SELECT *, list_position(['UNSUPPORTED_LANGUAGE', 'MIXED_LANGUAGE', 'INSUFFICIENT_TEXT', 'INSUFFICIENT_STRUCTURE',
  'UNVERIFIED_PROVENANCE', 'UNVALIDATED'], status) AS p FROM found)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "lang", "text").withColumn("c", T.cleaned("text"))
    none, unknown = F.lit(None), F.lit("unknown")
    found = language.issues(
        F.col("lang"), F.lit(1.0), F.lit(0.0), none.cast("double"), none.cast("string"), T.word_count("c"), T.terminal_marks("c"), unknown, unknown, POLICY
    )
    return rows.select("doc_id", "lang", found.alias("issues")).select(
        "doc_id", "lang", "issues", language.gate(F.col("issues"), F.col("lang"), unknown, unknown, POLICY).alias("gate")
    )


@query(f"WITH {GATES} SELECT doc_id, arg_min(status, p) AS status, count(*) AS n_reasons FROM ranked GROUP BY doc_id")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("doc_id", "gate.status", F.size("gate.reasons").alias("n_reasons"))


@query(f"WITH {GATES} SELECT doc_id, status FROM found")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("doc_id", F.inline("issues")).select("doc_id", "status")


@query(f"""WITH {GATES}, one AS (SELECT doc_id, lang, arg_min(status, p) AS status FROM ranked GROUP BY doc_id, lang)
  SELECT lang, status, count(*) AS n FROM one GROUP BY ROLLUP (lang, status)""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.status_counts(_gated(spark, sf_dir).select("lang", F.col("gate.status").alias("status")))


@query(f"""WITH {BASE}, v AS (SELECT lang, unnest(list_transform(regexp_extract_all(text, '\\p{{L}}+'), lambda x: lower(x))) AS word FROM base),
  k AS (SELECT lang, word, count(*) AS n FROM v GROUP BY lang, word), t AS (SELECT lang, sum(n) AS total FROM k GROUP BY lang)
  SELECT lang, word, n, round(log10(n / total * 1e9), 6) AS zipf FROM k JOIN t USING (lang)""")
def lexicon_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_lexicon(documents(spark, sf_dir, "lang", "text"))


STOP = " ".join(sorted({w for v in language.FUNCTION_WORDS.values() for w in v.split()})).split()
SHARES = f"""d AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '\\p{{L}}+'), lambda x: lower(x))) AS word FROM documents),
b AS (SELECT unnest(list_transform(regexp_extract_all(text, '\\p{{L}}+'), lambda x: lower(x))) AS word FROM benchmark),
k AS (SELECT word, count(*) AS n FROM b GROUP BY word), z AS (SELECT word, round(log10(n / (SELECT sum(n) FROM k) * 1e9), 6) AS zipf FROM k)
SELECT doc_id, count(*) AS alpha_token_count, count(zipf) AS known_token_count, round(1 - count(zipf) / count(*), 6) AS oov_rate,
  round(count(*) FILTER (zipf < 3.5) / nullif(count(zipf), 0), 6) AS rare_word_share,
  round(count(*) FILTER (zipf > 0 AND d.word NOT IN ({', '.join(repr(w) for w in STOP)})) / nullif(count(zipf), 0), 6) AS lexical_density
FROM d LEFT JOIN z USING (word) GROUP BY doc_id"""


@query("WITH " + SHARES)
def lexicon_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by a dictionary that isn't the documents' own: the words of benchmark."""
    one = F.lit("all").alias("lang")
    known = lexical.corpus_lexicon(tables(spark, sf_dir, "benchmark").select(one, "text"))
    known = known.withColumn("is_stop", F.col("word").isin(STOP))
    return lexical.with_lexicon(documents(spark, sf_dir, "text").withColumn("lang", F.lit("all")), known).drop("known", "rare_once")


MATTR_SQL = """CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 50 THEN len(list_distinct(w)) / len(w)
  ELSE list_sum([len(list_distinct(w[i:i+49])) FOR i IN range(1, len(w) - 48)]) / (50 * (len(w) - 49)) END"""


@query(f"WITH {BASE} SELECT doc_id, round({MATTR_SQL}, 6) AS mattr FROM base WHERE len(w) > 0")
def mattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).where(F.size("w") > 0)
    return rows.select("doc_id", F.round(lexical.mattr(F.array_join("w", " ")), 6).alias("mattr"))


@query(f"WITH {BASE} SELECT doc_id, round({MATTR_SQL}, 6) AS mattr FROM base WHERE len(w) > 0")
def mattr_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a window function over words, without Python."""
    rows = lexical.mattr_relational(base(spark, sf_dir).select("doc_id", F.col("c").alias("text")))
    return rows.select("doc_id", F.round("mattr", 6).alias("mattr"))


ZIPF_SHIFT = 1.5


def benchmark_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of benchmark as a dictionary of English; as it is small, zipf is lowered by ZIPF_SHIFT, for some to be rare."""
    known = lexical.corpus_lexicon(tables(spark, sf_dir, "benchmark").select(F.lit("en").alias("lang"), "text"))
    return known.withColumns({"zipf": F.col("zipf") - ZIPF_SHIFT, "is_stop": F.col("word").isin(language.FUNCTION_WORDS["en"].split())})


def _by_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_gate(with_preprocess(with_language(documents(spark, sf_dir, "lang", "text"), POLICY, "lang"), False, POLICY), POLICY)
    return with_lexical(rows, benchmark_lexicon(spark, sf_dir), POLICY).where("lexical IS NOT NULL")


KNOWN = f"""{BASE}, bw AS (SELECT unnest(list_transform(regexp_extract_all(text, '\\p{{L}}+'), lambda x: lower(x))) AS word FROM benchmark),
bk AS (SELECT word, count(*) AS n FROM bw GROUP BY word), bz AS (SELECT word, round(log10(n / (SELECT sum(n) FROM bk) * 1e9), 6) - {ZIPF_SHIFT} AS zipf FROM bk),
en AS (SELECT * FROM base WHERE lang = 'en' AND len(w) > 0), dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM en),
dk AS (SELECT doc_id, list(word ORDER BY p) AS w FROM dw JOIN bz USING (word) GROUP BY doc_id),
ds AS (SELECT doc_id, count(*) AS alpha, count(zipf) AS known, count(*) FILTER (zipf < 3.5) AS rare,
  count(*) FILTER (zipf > 0 AND dw.word NOT IN ({', '.join(repr(w) for w in language.FUNCTION_WORDS['en'].split())})) AS content
  FROM dw LEFT JOIN bz USING (word) GROUP BY doc_id)"""


@query(f"""WITH {KNOWN} SELECT doc_id, alpha AS alpha_token_count, known AS known_token_count, round(1 - known / alpha, 3) AS oov_rate,
  round(rare / nullif(known, 0), 3) AS rare_word_share, round(content / nullif(known, 0), 3) AS lexical_density, round({MATTR_SQL}, 3) AS mattr,
  CASE WHEN known = 0 THEN 'INSUFFICIENT_TEXT' END AS error FROM ds LEFT JOIN dk USING (doc_id)""")
def lexical_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures over the words that a dictionary has, of documents in the dictionary's language."""
    rows = _by_lexicon(spark, sf_dir)
    return rows.select("doc_id", *[f"lexical.{k}" for k in ("alpha_token_count", "known_token_count", "oov_rate", "rare_word_share", "lexical_density", "mattr", "error")])


@query(f"""WITH {KNOWN}, once AS (SELECT doc_id, word FROM dw JOIN bz USING (word) WHERE zipf < 3.5 AND len(word) > 5 GROUP BY doc_id, word HAVING count(*) = 1),
  sn AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS idx FROM en JOIN ds USING (doc_id) WHERE known > 0),
  sw AS (SELECT doc_id, idx, list_transform(list_filter(string_split_regex(t, '\\s+'), lambda x: regexp_full_match(x, '\\p{{L}}+')), lambda x: lower(x)) AS v FROM sn),
  sr AS (SELECT doc_id, idx, v, coalesce(list_filter(v, lambda x: list_contains(o, x)), []) AS r FROM sw LEFT JOIN (SELECT doc_id, list(word) AS o FROM once GROUP BY doc_id) USING (doc_id) WHERE len(v) > 0),
  h AS (SELECT doc_id, idx, round(len(r) / len(v), 3) AS c, array_to_string(r[1:3], ' ') AS rare FROM sr),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, idx) AS down FROM h),
  u AS (SELECT *, CASE WHEN down > 2 THEN row_number() OVER (PARTITION BY doc_id, down > 2 ORDER BY c, idx) END AS up FROM k)
  SELECT doc_id, idx::INT AS sentence_idx, c AS contribution, coalesce(rare, '') AS rare, CASE WHEN down <= 2 THEN 'strongest' ELSE 'weakest' END AS rank
  FROM u WHERE down <= 2 OR up <= 2""")
def lexical_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences with the largest and the smallest shares of rare words, by the dictionary's frequencies."""
    rows = _by_lexicon(spark, sf_dir).select("doc_id", F.inline("lexical.evidence"))
    words = F.transform(F.filter("triggered_by", lambda x: x.startswith("rare:")), lambda x: F.substr(x, F.lit(6)))
    return rows.select("doc_id", "sentence_idx", "contribution", F.array_join(words, " ").alias("rare"), "rank")


def _factors_sql(words: str) -> str:
    """Factors of a direction: whole runs, and the part that the last one has come."""
    run = f"list_reduce(list_transform({words}, lambda x: {{'f': 0, 'run': [x]}}), lambda a, b: CASE WHEN len(list_distinct(a.run || b.run)) / len(a.run || b.run) <= 0.72 THEN {{'f': a.f + 1, 'run': []::VARCHAR[]}} ELSE {{'f': a.f, 'run': a.run || b.run}} END, {{'f': 0, 'run': []::VARCHAR[]}})"
    return f"(SELECT z.f + CASE WHEN len(z.run) > 0 THEN (1 - len(list_distinct(z.run)) / len(z.run)) / 0.28 ELSE 0 END FROM (SELECT {run} AS z))"


@query(f"""WITH {BASE}, f AS (SELECT doc_id, len(w) AS n, {_factors_sql('w')} AS a, {_factors_sql('list_reverse(w)')} AS b FROM base)
  SELECT doc_id, CASE WHEN n >= 10 THEN round(((CASE WHEN a > 0 THEN n / a ELSE n END) + (CASE WHEN b > 0 THEN n / b ELSE n END)) / 2, 6) END AS mtld FROM f""")
def mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("doc_id", lexical.diversity(F.array_join("w", " ")).alias("d"))
    return rows.select("doc_id", F.round("d.mtld", 6).alias("mtld"))


@query()
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("doc_id", lexical.diversity(F.array_join("w", " ")).alias("d"))
    return rows.select("doc_id", F.round("d.mtld", 6).alias("mtld"), F.round("d.vocd_d", 6).alias("vocd_d"))


@query(f"""WITH {BASE} SELECT doc_id, round(list_sum(list_transform(w, lambda x: len(x))) / len(w), 6) AS avg_word_length,
  CASE WHEN len(w) < 3 THEN 0 ELSE round(1 - len(list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)])) / (len(w) - 2), 6) END
  AS repeated_ngram_share FROM base WHERE len(w) > 0""")
def word_length_and_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)) / F.size("w")
    share = T.repeated_ngram_share(F.col("w"), 3, 6)
    return base(spark, sf_dir).where(F.size("w") > 0).select("doc_id", F.round(length, 6).alias("avg_word_length"), share.alias("repeated_ngram_share"))


@query(f"""WITH {BASE}, p AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS j FROM base),
  x AS (SELECT DISTINCT doc_id, j, unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda y: len(y) > 4)) AS word FROM p),
  k AS (SELECT doc_id, word, count(*) AS n FROM x GROUP BY doc_id, word),
  v AS (SELECT doc_id, count(*) FILTER (n > 1) / count(*) AS share FROM k GROUP BY doc_id)
  SELECT doc_id, round(coalesce(share, 0), 3) AS chain_density FROM base LEFT JOIN v USING (doc_id)""")
def lexical_chain_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("doc_id", semantic.chain_density(F.col("s")).alias("chain_density"))


READ = """parts AS (SELECT doc_id, s, list_filter(string_split_regex(c, '\\s+'), lambda x: len(x) > 0) AS p FROM base),
sums AS (SELECT doc_id, len(p) AS n, greatest(1, len(s)) AS k, greatest(1, len(p))::DOUBLE AS w,
  coalesce(list_sum(list_transform(p, lambda x: len(regexp_replace(x, '[^\\p{L}]', '', 'g')))), 0) AS letters,
  coalesce(list_sum(list_transform(p, lambda x: len(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')))), 0) AS chars,
  coalesce(list_sum(list_transform(p, lambda x: greatest(1, len(regexp_extract_all(x, '(?i)[aeiou]+'))))), 0) AS syl,
  len(list_filter(p, lambda x: greatest(1, len(regexp_extract_all(x, '(?i)[aeiou]+'))) >= 3)) AS hard FROM parts),
indices AS (SELECT doc_id, 206.835 - 1.015 * (n / k) - 84.6 * (syl / w) AS flesch, 0.4 * (n / k + 100 * hard / w) AS fog,
  4.71 * chars / w + 0.5 * n / k - 21.43 AS ari, 0.0588 * (100 * letters / w) - 0.296 * (100 * k / w) - 15.8 AS cl FROM sums)"""


def _indices(rows: DataFrame) -> DataFrame:
    found = F.transform(F.array(readability.counts(F.col("c"), F.col("s"), F.lit("id"))), lambda x: F.struct(*[v.alias(k) for k, v in readability.formulas(x).items()]))[0]
    return rows.withColumn("v", found)


@query(f"""WITH {BASE}, {READ} SELECT doc_id, round(flesch, 6) AS flesch_reading_ease, round(fog, 6) AS gunning_fog, round(ari, 6) AS ari,
  round(cl, 6) AS coleman_liau FROM indices""")
def readability_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formulas with syllables as runs of vowels."""
    return _indices(base(spark, sf_dir)).select("doc_id", *[F.round(f"v.{k}", 6).alias(k) for k in ("flesch_reading_ease", "gunning_fog", "ari", "coleman_liau")])


@query(f"""WITH {BASE}, p AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS idx FROM base),
  h AS (SELECT doc_id, idx, round(len(list_filter(string_split_regex(t, '\\s+'), lambda x: greatest(1, len(regexp_extract_all(x, '(?i)[aeiou]+'))) >= 3))
    / len(string_split_regex(t, '\\s+')), 2) AS v FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, idx) AS down FROM h),
  u AS (SELECT *, CASE WHEN down > 2 THEN row_number() OVER (PARTITION BY doc_id, down > 2 ORDER BY v, idx) END AS up FROM r)
  SELECT doc_id, idx::INT AS sentence_idx, v AS contribution, CASE WHEN down <= 2 THEN 'strongest' ELSE 'weakest' END AS rank FROM u WHERE down <= 2 OR up <= 2""")
def polysyllable_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("doc_id", F.inline(readability.evidence(F.col("s"), F.lit("id"))))
    return rows.select("doc_id", "sentence_idx", "contribution", "rank")


NEIGHBOURS = """n AS (SELECT label, vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER w AS b, lead(vec_id) OVER w AS next_id
  FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
v AS (SELECT label, vec_id, next_id, list_cosine_similarity(a, b) AS r FROM n WHERE next_id IS NOT NULL)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next of its label, and their cosine."""
    vectors = tables(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = semantic.neighbours(vectors, "label", "vec_id", "v", semantic.cosine)
    return rows.select("label", "vec_id", F.col("next").alias("next_id"), F.col("raw").alias("r"))


@query(f"WITH {NEIGHBOURS} SELECT label, count(*) AS transitions, round(avg(r), 6) AS similarity, round(stddev_pop(r), 6) AS drift FROM v GROUP BY label")
def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("transitions"), F.round(F.avg("r"), 6).alias("similarity"), F.round(F.stddev_pop("r"), 6).alias("drift")
    )


@query(f"""WITH {NEIGHBOURS} SELECT label, vec_id, next_id, round(r, 6) AS similarity,
  CASE WHEN r > 0.75 THEN 'high overlap' WHEN r < 0.5 THEN 'low overlap' ELSE 'moderate overlap' END AS note FROM v""")
def transition_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("label", "vec_id", "next_id", F.round("r", 6).alias("similarity"), semantic.note(F.col("r")).alias("note"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\\p{L}+'), lambda x: lower(x))) AS a FROM conversations),
  n AS (SELECT conv_id, turn, a, lead(a) OVER o AS b, lead(turn) OVER o AS next_turn FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, next_turn, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)::DOUBLE), 6) ELSE 0 END
  AS similarity FROM n WHERE next_turn IS NOT NULL""")
def segment_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of neighbouring turns, never across conversations."""
    words = tables(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.words("text")).alias("w"))
    rows = semantic.neighbours(words, "conv_id", "turn", "w", semantic.word_cosine)
    return rows.select("conv_id", "turn", F.col("next").alias("next_turn"), F.round("raw", 6).alias("similarity"))


@query("""WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) = 1 AS kept FROM conversations),
  m AS (SELECT conv_id, turn, role, min(CASE WHEN kept THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    AS moved_to FROM k) SELECT conv_id, turn, moved_to FROM m WHERE role = 'user'""")
def boundary_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries at users' turns, moved on to the next turn that doesn't repeat an earlier one; null if there is none."""
    first = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn")) == 1
    turns = tables(spark, sf_dir, "conversations").withColumn("kept", first).groupBy("conv_id").agg(
        F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("edges"), F.collect_list(F.when(F.col("kept"), F.col("turn"))).alias("kept")
    )  # as many as a conversation's turns
    rows = turns.select("conv_id", F.inline(semantic.moved(F.col("edges"), F.col("kept"))))
    return rows.select("conv_id", F.col("at").alias("turn"), F.col("to").alias("moved_to"))


@query(f"""WITH RECURSIVE {BASE}, sn AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS idx FROM base),
  st AS (SELECT doc_id, idx::INT AS idx, list_distinct(list_transform(regexp_extract_all(t, '\\p{{L}}+'), lambda x: lower(x))) AS a FROM sn),
  fold AS (SELECT doc_id, 0 AS step, []::INT[] AS kept, []::VARCHAR[][] AS sets FROM base UNION ALL
    SELECT f.doc_id, f.step + 1, CASE WHEN near THEN f.kept ELSE list_append(f.kept, st.idx) END, CASE WHEN near THEN f.sets ELSE list_append(f.sets, st.a) END
    FROM fold f JOIN st ON st.doc_id = f.doc_id AND st.idx = f.step,
    LATERAL (SELECT len(st.a) > 0 AND len(list_filter(f.sets, lambda b: len(b) > 0 AND len(list_intersect(st.a, b)) >= 0.8 * (len(st.a) + len(b) - len(list_intersect(st.a, b))))) > 0 AS near))
  SELECT doc_id, max(step) AS n, max(len(kept)) AS n_kept, arg_max(kept, step) AS kept_idx FROM fold GROUP BY doc_id""")
def sentence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("doc_id", F.size("s").alias("n"), semantic.dedupe(F.col("s")).alias("kept"))
    return rows.select("doc_id", "n", F.size("kept").alias("n_kept"), F.transform("kept", lambda k: k["idx"]).alias("kept_idx"))


@query(f"""WITH {BASE}, h AS (SELECT doc_id, len(w) AS n,
  {", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in v.split())}))) / nullif(len(w), 0) AS {k}" for k, v in language.REGIONAL_WORDS.items())} FROM base)
  SELECT doc_id, CASE WHEN greatest(jv, su) > 0 THEN CASE WHEN jv >= su THEN 'jv' ELSE 'su' END END AS lang, round(greatest(jv, su), 3) AS share FROM h""")
def regional_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", language.regional(T.cleaned("text")).alias("r")).select("doc_id", "r.lang", "r.share")


# A light score from built-ins alone: lexical from MATTR, syntactic from sentence length, semantic from chains, readability from ARI.
LIGHT = f"""{BASE}, {READ}, chains AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS j FROM base),
cw AS (SELECT DISTINCT doc_id, j, unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda y: len(y) > 4)) AS word FROM chains),
ck AS (SELECT doc_id, word, count(*) AS n FROM cw GROUP BY doc_id, word),
cv AS (SELECT doc_id, count(*) FILTER (n > 1) / count(*) AS share FROM ck GROUP BY doc_id),
measures AS (SELECT b.doc_id, b.lang, len(w) AS n, round({MATTR_SQL}, 6) AS mattr, len(w) / greatest(1, len(s)) AS msl, round(coalesce(share, 0), 3) AS chain,
  len(s) AS ns, ari, fog, list_sum(list_transform(w, lambda x: len(x))) / nullif(len(w), 0) AS mwl
  FROM base b JOIN indices USING (doc_id) LEFT JOIN cv USING (doc_id)),
light AS (SELECT *, CASE WHEN mattr IS NOT NULL THEN least(100, greatest(0, (mattr - 0.3) / (0.9 - 0.3) * 100)) END AS lexical,
  least(100, greatest(0, (msl - 8) / 22 * 100)) AS syntactic,
  CASE WHEN ns > 1 THEN least(100, greatest(0, (chain - 0.1) / (0.6 - 0.1) * 100)) END AS semantic,
  least(100, greatest(0, (ari - 5) / (16 - 5) * 100)) AS readability FROM measures),
scored AS (SELECT *, round((coalesce(lexical * 0.35, 0) + syntactic * 0.25 + coalesce(semantic * 0.25, 0) + readability * 0.15)
  / (CASE WHEN lexical IS NULL THEN 0 ELSE 0.35 END + 0.25 + CASE WHEN semantic IS NULL THEN 0 ELSE 0.25 END + 0.15), 6) AS style_index FROM light)"""


def light(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _indices(base(spark, sf_dir)).withColumn("m", lexical.mattr(F.array_join("w", " ")))
    n, ns = F.size("w"), F.size("s")
    measured = rows.select(
        "doc_id", "lang", n.alias("n"), ns.alias("ns"), F.round("m", 6).alias("mattr"), (n / F.greatest(F.lit(1), ns)).alias("msl"),
        semantic.chain_density(F.col("s")).alias("chain"), "v.ari", F.col("v.gunning_fog").alias("fog"),
        F.when(n > 0, F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)) / n).alias("mwl"),
    )
    scores = measured.withColumns({
        "lexical": T.scaled(F.col("mattr"), 0.3, 0.9), "syntactic": T.scaled(F.col("msl"), 8.0, 30.0),
        "semantic": F.when(F.col("ns") > 1, T.scaled(F.col("chain"), 0.1, 0.6)), "readability": T.scaled(F.col("ari"), 5.0, 16.0),
    })
    index = compose.weighted_index({k: F.col(k) for k in POLICY.weights}, POLICY)
    return corpus.settled(scores).withColumn("style_index", F.round(index, 6))


@query(f"WITH {LIGHT} SELECT doc_id, style_index, semantic IS NULL AS partial FROM scored")
def style_index_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light(spark, sf_dir).select("doc_id", "style_index", F.col("semantic").isNull().alias("partial"))


@query(f"""WITH {LIGHT}, bands(band, low, high) AS (VALUES (1, 0, 40), (2, 40, 55), (3, 55, 70), (4, 70, 85), (5, 85, 100))
  SELECT doc_id, band FROM scored LEFT JOIN bands ON style_index >= low AND (style_index < high OR band = 5 AND style_index <= high)""")
def style_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.with_band(light(spark, sf_dir), "style_index", POLICY).select("doc_id", "band")


def _band_sql(column: str, of: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {b[of]} THEN {b[0]}" for b in reversed(POLICY.complexity_bands)) + " ELSE 1 END"


@query(f"""WITH {LIGHT}, m AS (SELECT doc_id, list_sort([{_band_sql('fog', 1)}, {_band_sql('ari', 2)}, {_band_sql('mattr', 3)}]) AS b FROM scored WHERE n > 0)
  SELECT doc_id, b[2] AS band, CASE WHEN b[3] - b[1] <= 1 THEN 'CONSISTENT' ELSE 'CONFLICTING' END AS consistency FROM m""")
def complexity_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATTR in the place of density, which needs a dictionary."""
    rows = light(spark, sf_dir).where("n > 0").select("doc_id", compose.complexity(F.col("fog"), F.col("ari"), F.col("mattr"), POLICY).alias("x"))
    return rows.select("doc_id", "x.band", "x.consistency")


@query(f"WITH {BASE} SELECT doc_id, CASE WHEN len(w) < 30 THEN 'VERY LOW' WHEN len(w) < 100 THEN 'LOW' WHEN len(w) < 300 THEN 'MEDIUM' ELSE 'HIGH' END AS tier FROM base")
def length_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", compose.length_tier(T.word_count(T.cleaned("text"))).alias("tier"))


@query(f"""WITH {LIGHT}, g AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN 0 ELSE round(1 - len(list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]))
  / (len(w) - 2), 3) END AS repeated FROM base) SELECT doc_id, lexical >= 60 AND chain < 0.15 AS stuffing, repeated > 0.2 AS padding FROM scored JOIN g USING (doc_id) WHERE n > 0""")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain density in the place of similarity."""
    repeated = base(spark, sf_dir).select("doc_id", T.repeated_ngram_share(F.col("w")).alias("repeated"))
    rows = light(spark, sf_dir).where("n > 0").join(repeated, "doc_id")
    none = F.lit(None).cast("double")
    flags = F.transform(compose.review_flags(F.col("lexical"), none, F.col("chain"), none, F.col("repeated"), POLICY), lambda x: x["flag"])
    return rows.select("doc_id", F.array_contains(flags, "possible_vocabulary_stuffing").alias("stuffing"), F.array_contains(flags, "ngram_padding").alias("padding"))


@query(f"""WITH {LIGHT}, r AS (SELECT doc_id, lang, style_index, row_number() OVER (PARTITION BY lang ORDER BY style_index DESC, doc_id) AS rank
  FROM scored WHERE style_index IS NOT NULL) SELECT * FROM r WHERE rank <= 20""")
def rank_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of each language: a top-k report."""
    return compose.rank_within_language(light(spark, sf_dir).select("doc_id", "lang", "style_index"), top=20)


PARTS = ("lexical", "syntactic", "semantic", "readability")
PAIRS = [(a, b) for i, a in enumerate(PARTS) for b in PARTS[i + 1 :]]
FULL = f"{LIGHT}, complete AS (SELECT *, lexical * 0.35 + syntactic * 0.25 + semantic * 0.25 + readability * 0.15 AS i FROM light WHERE lexical IS NOT NULL AND semantic IS NOT NULL)"


@query(f"WITH {FULL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM complete" for a, b in PAIRS))
def component_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.correlations(light(spark, sf_dir)).withColumn("r", F.round("r", 6))


@query(f"WITH {FULL} " + " UNION ALL ".join(f"SELECT '{k}' AS component, round({w} * covar_pop({k}, i) / var_pop(i), 6) AS weight FROM complete" for k, w in POLICY.weights.items()))
def effective_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.effective_weights(light(spark, sf_dir), POLICY).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {FULL}, k AS (SELECT corr(i, msl) AS a, corr(i, mwl) AS b, corr(msl, mwl) AS c FROM complete)
  SELECT round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) AS r2 FROM k""")
def length_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_share(light(spark, sf_dir), "msl", "mwl", POLICY).select(F.round("r2", 6).alias("r2"))


@query(f"""WITH {LIGHT} SELECT quality, count(*) AS n, round(avg(mattr), 4) AS mattr, round(avg(style_index), 4) AS style_index
  FROM scored JOIN labels USING (doc_id) GROUP BY quality""")
def metric_vs_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = light(spark, sf_dir).join(tables(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    found = corpus.group_means(rows, "quality", ["mattr", "style_index"])
    return found.select("quality", "n", F.round("mattr", 4).alias("mattr"), F.round("style_index", 4).alias("style_index"))


@query("SELECT doc_id, len(list_filter([" + ", ".join(f"regexp_matches(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '(?i){p}')" for p in sanitize.PHRASES.values()) + "], lambda x: x)) AS n_phrases FROM documents")
def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", F.size(sanitize.injection_phrases(F.col("text"))).alias("n_phrases"))


@query("""WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\p{Cf}', '', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM documents),
  b AS (SELECT doc_id, trim(regexp_replace(translate(x, '`[]|<>', '''()/‹›'), '^#+', '')) AS x FROM a)
  SELECT doc_id, CASE WHEN len(x) > 100 THEN rtrim(x[1:100]) || '…' ELSE x END AS excerpt FROM b""")
def sanitized_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", sanitize.clean_untrusted(F.col("text")).alias("excerpt"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS input_sha256 FROM documents")
def input_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", integrity.input_sha256(F.col("text")).alias("input_sha256"))


@query("""SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'INVALID_JSON' WHEN json_type(props) <> 'OBJECT' THEN 'INVALID_SHAPE' END AS error,
  len(json_keys(props)) AS n_keys FROM events""")
def json_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boundary.parsed(F.col("props"), "map<string,string>", "props")
    rows = tables(spark, sf_dir, "events").select("event_id", found.alias("x"))
    return rows.select("event_id", F.col("x.error.error").alias("error"), F.when(F.col("x.value").isNotNull(), F.size("x.value")).alias("n_keys"))


@query()
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", language.detect_language(F.col("text"), POLICY).alias("x")).select("doc_id", "x.*")


@query()
def syntactic_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("doc_id", syntactic.analyze_by_language(F.col("s"), F.col("lang")).alias("x"))
    return rows.select("doc_id", *[f"x.{k}" for k in ("mean_sentence_length", "clause_density", "subordination_index", "passive_ratio", "score")])


def _signed(rows: DataFrame) -> DataFrame:
    return integrity.sign(rows.withColumn("result", F.struct(T.word_count("text").alias("words"))), "result", "counts")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS input_sha256, 'counts' AS kind, NULL::VARCHAR AS integrity_error FROM documents")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed and verified again: the error is null for every row."""
    rows = integrity.verify(_signed(documents(spark, sf_dir, "text")), "result", "counts")
    return rows.select("doc_id", "input_sha256", "kind", "integrity_error")


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir, "lang", "text"), POLICY, declared="lang")


@query()
def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result, flattened: with the shipped policy no estimate about a person is ever given."""
    return _lexical(spark, sf_dir).select(
        "doc_id", "error.error", "gate.status", "gate.reasons", "style.style_index", "iq.style_band", "style.lexical", "style.syntactic", "style.semantic",
        "style.readability", "iq.point_estimate", F.col("iq.withheld_reason").alias("iq_withheld"), "mental_age.mental_age",
        F.col("mental_age.withheld_reason").alias("age_withheld"), "band.text_complexity_band", "band.consistency", "prep.word_count", "prep.token_count",
        "low_reliability", F.col("lexical.reliability_reasons").alias("reliability_reasons"), "flags",
    )


@query("""WITH base AS (SELECT doc_id, lang, text, len(text) > 100000 AS big FROM documents),
  c AS (SELECT doc_id, lang, big, CASE WHEN lang = 'en' AND NOT big THEN """ + CLEAN + """ ELSE '' END AS c FROM base),
  n AS (SELECT *, len(regexp_extract_all(c, '\\p{L}+')) AS w, len(regexp_extract_all(c, '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}\\p{P}]')) AS k, len(regexp_extract_all(c, '[.!?…]+')) AS m FROM c)
  SELECT doc_id, CASE WHEN big THEN 'INPUT_TOO_LARGE' END AS error, w AS word_count, k AS token_count,
    CASE WHEN lang <> 'en' THEN 'UNSUPPORTED_LANGUAGE' WHEN w < 250 THEN 'INSUFFICIENT_TEXT' WHEN w / greatest(1, m) > 40 THEN 'INSUFFICIENT_STRUCTURE'
      ELSE 'UNVERIFIED_PROVENANCE' END AS status, lang = 'en' AND w > 0 AS scored, lang = 'en' AND w > 0 AS measured, lang <> 'en' OR w = 0 AS refused FROM n""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are scored at all, and what the others have instead. None is in the other language with an instrument."""
    return _lexical(spark, sf_dir).select(
        "doc_id", "error.error", "prep.word_count", "prep.token_count", "gate.status", F.col("style.style_index").isNotNull().alias("scored"),
        F.col("readability.gunning_fog").isNotNull().alias("measured"), F.col("lexical").isNull().alias("refused"),
    )


@query()
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_report(_lexical(spark, sf_dir), "--both", "2026-01-01", policy=POLICY)

