"""Lexical diversity, density and rarity, with or without a dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prosemill.functions import text as T
from prosemill.operators.evidence import rank_evidence
from prosemill.operators.language import FUNCTION_WORDS

# Windows, thresholds, scales and weights that results must agree with.
WINDOW, MTLD_THRESHOLD, MIN_MTLD, MIN_VOCD, RARE_ZIPF, RARE_LETTERS, MAX_OOV = 50, 0.72, 10, 50, 3.5, 5, 0.10
WEIGHTS = {"mattr": 0.45, "mtld": 0.35, "lexical_density": 0.20}
SCALES = {"mattr": (0.3, 0.9), "mtld": (40.0, 200.0), "lexical_density": (0.3, 0.7)}


def _previous(ids: np.ndarray) -> np.ndarray:
    """For each place the one before it with the same id, or -1."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1)
    same = ids[order][1:] == ids[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def mattr_of(words: list[str], window: int = WINDOW) -> float | None:
    """Mean share of distinct words over all windows, by how many windows each word is the first of its kind in."""
    n = len(words)
    if not n:
        return None
    if n < window:
        return len(set(words)) / n
    ids = pd.factorize(np.array(words, object))[0]
    p, last = np.arange(n), n - window
    first = np.maximum(_previous(ids) + 1, np.maximum(p - window + 1, 0))
    return float(np.maximum(0, np.minimum(p, last) - first + 1).sum() / (window * (last + 1)))


def _factors(words: list[str], threshold: float) -> float:
    seen: set[str] = set()
    n = factors = 0
    for w in words:
        n += 1
        seen.add(w)
        if len(seen) / n <= threshold:
            factors, n = factors + 1, 0
            seen = set()
    return factors + ((1 - len(seen) / n) / (1 - threshold) if n else 0.0)


def mtld_of(words: list[str], threshold: float = MTLD_THRESHOLD) -> float | None:
    """Mean length of runs that keep the type-token ratio above the threshold, of both directions.

    Without any factor, not even a partial one, the measure is the number of words.
    """
    if len(words) < MIN_MTLD:
        return None
    both = [_factors(words, threshold), _factors(words[::-1], threshold)]
    return float(np.mean([len(words) / f if f > 0 else len(words) for f in both]))


def vocd_of(words: list[str]) -> float | None:
    """The parameter of the curve of expected type-token ratios for samples of 35 to 50 words; null if none fits.

    The expected ratios are exact (hypergeometric), so no samples are drawn; the fit is a bisection.
    """
    n = len(words)
    if n < MIN_VOCD:
        return None
    _, counts = np.unique(np.array(words), return_counts=True)
    sizes = np.arange(35, 51)
    k = np.arange(sizes.max())
    with np.errstate(divide="ignore"):
        left = np.log(np.maximum(n - counts[:, None] - k, 0)) - np.log(n - k)
    absent = np.exp(np.cumsum(left, 1))[:, sizes - 1]
    ratio = (1 - absent).sum(0) / sizes

    def miss(d: float) -> float:
        curve = d / sizes * (np.sqrt(1 + 2 * sizes / d) - 1)
        return float(((curve - ratio) * (np.sqrt(1 + 2 * sizes / d) - 1)).sum())

    low, high = 0.01, 10_000.0
    if miss(high) < 0:  # words that hardly ever recur: no curve fits
        return None
    for _ in range(80):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if miss(middle) < 0 else (low, middle)
    return float((low * high) ** 0.5)


MEASURES = {"mattr": mattr_of, "mtld": mtld_of, "vocd_d": vocd_of}


def _split(texts: pd.Series) -> list[list[str]]:
    return [x.split(" ") if x else [] for x in texts]


def _measured(lists: list[list[str]]) -> pd.DataFrame:
    columns = {k: pd.Series([f(w) for w in lists], dtype="float64") for k, f in MEASURES.items()}
    return pd.DataFrame(columns).replace({np.nan: None})


DIVERSITY = StructType([StructField(k, DoubleType()) for k in MEASURES])


@F.pandas_udf(DIVERSITY)
def diversity(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The three measures of word sequences, given as words joined by spaces. Order matters, so no built-in does it."""
    for batch in texts:
        yield _measured(_split(batch))


@F.pandas_udf(DIVERSITY)
def diversity_of_known(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The same of the words that are among the known ones, which are joined by spaces too."""
    for batch, known in texts:
        sets = [set(k) for k in _split(known)]
        yield _measured([[w for w in words if w in k] for words, k in zip(_split(batch), sets, strict=True)])


@F.pandas_udf(DoubleType())
def mattr(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """MATTR alone, for who needs no other measure."""
    for batch in texts:
        yield pd.Series([mattr_of(w) for w in _split(batch)], dtype="float64").replace({np.nan: None})


def mattr_native(words: Column, window: int = WINDOW) -> Column:
    """The same as mattr_of by built-ins alone; quadratic in the window, for checks."""
    n = F.size(words)
    at = F.sequence(F.lit(1), n - window + 1)
    shares = F.transform(at, lambda i: F.size(F.array_distinct(F.slice(words, i, window))) / window)
    mean = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(at)
    return F.when(n == 0, None).when(n < window, F.size(F.array_distinct(words)) / n).otherwise(mean)


def corpus_lexicon(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word, n, zipf: frequencies from the documents themselves; zipf is log10 of the count in a billion."""
    words = docs.select(F.col(lang_col).alias("lang"), F.explode(T.words(text_col)).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select("lang", "word", "n", F.round(F.log10(F.col("n") / F.col("total") * 1e9), 6).alias("zipf"))


def with_lexicon(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """For each document with words: shares of unknown and of rare words, and content density (nulls: no known word).

    lexicon: lang, word, zipf and, if it has it, is_stop. Words are counted within a document before the join, so
    a word moves once for each document; whether the lexicon is broadcast is left to its size. known: the document's
    words that the lexicon has; rare_once: those of them that are rare, long and occur once.
    """
    stop = F.col("is_stop") if "is_stop" in lexicon.columns else F.lit(False)
    known = lexicon.select(F.col(lang_col).alias("lang") if lang_col in lexicon.columns else F.col("lang"), "word", "zipf", stop.alias("is_stop"))
    counts = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.explode(T.words(text_col)).alias("word"))
        .groupBy("doc_id", "lang", "word")
        .agg(F.count("*").alias("n"))
    )
    n = F.col("n")
    found = F.when(F.col("zipf") > 0, n).otherwise(0)
    return (
        counts.join(known, ["lang", "word"], "left")
        .groupBy("doc_id")
        .agg(
            F.sum("n").alias("alpha_token_count"),
            F.sum(found).alias("known_token_count"),
            F.sum(F.when((F.col("zipf") > 0) & (F.col("zipf") < RARE_ZIPF), n).otherwise(0)).alias("rare"),
            F.sum(F.when((F.col("zipf") > 0) & ~F.coalesce("is_stop", F.lit(False)), n).otherwise(0)).alias("content"),
            F.collect_list(F.when(F.col("zipf") > 0, F.col("word"))).alias("known"),  # no longer than the document
            F.collect_list(F.when((F.col("zipf") > 0) & (F.col("zipf") < RARE_ZIPF) & (n == 1) & (F.length("word") > RARE_LETTERS), F.col("word"))).alias("rare_once"),
        )
        .select(
            "doc_id", "alpha_token_count", "known_token_count",
            F.round(1 - F.col("known_token_count") / F.col("alpha_token_count"), 6).alias("oov_rate"),
            F.round(F.try_divide("rare", "known_token_count"), 6).alias("rare_word_share"),
            F.round(F.try_divide("content", "known_token_count"), 6).alias("lexical_density"), "known", "rare_once",
        )
    )


def mattr_relational(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, mattr by a window function: each word counts in the windows that it is the first of its kind in."""
    words = docs.select(F.col(id_col).alias("doc_id"), T.words(text_col).alias("w"))
    rows = words.select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("p", "word"))
    before = F.lag("p").over(Window.partitionBy("doc_id", "word").orderBy("p"))
    last = F.greatest(F.col("n") - window, F.lit(0))
    size = F.least("n", F.lit(window))
    low = F.greatest(F.coalesce(before + 1, F.lit(0)), F.col("p") - size + 1, F.lit(0))
    return (
        rows.withColumn("k", F.greatest(F.lit(0), F.least("p", last) - low + 1))
        .groupBy("doc_id")
        .agg((F.sum("k") / (F.first(size) * (F.first(last) + 1))).alias("mattr"))
    )


def stop_words(lang: Column, word: Column) -> Column:
    """Whether word is a function word of the language."""
    out = F.lit(False)
    for k, listed in FUNCTION_WORDS.items():
        out = F.when(lang == k, word.isin(listed.split())).otherwise(out)
    return out


def analyze(words: Column, sentences: Column, lang: Column, found: Column, shares: Column | None = None) -> Column:
    """The lexical result, with all its fields on every path.

    words: lower-cased, alphabetic; found: the result of diversity(), over the known words where there is a dictionary;
    shares: a row of with_lexicon(), or null for no dictionary, when every word counts as known and rarity isn't
    measured. Without words, or without any that the dictionary has, nothing is measured and error says so.
    """
    n = F.size(words).cast("long")
    digits = lambda c, d: F.round(c, d)
    known = F.coalesce(shares["known_token_count"], F.lit(0)) if shares is not None else n
    some = F.coalesce(known > 0, F.lit(False))
    content = F.size(F.filter(words, lambda w: ~stop_words(lang, w)))
    density = shares["lexical_density"] if shares is not None else F.when(n > 0, content / n)
    measures = {"mattr": digits(found["mattr"], 3), "mtld": digits(found["mtld"], 1), "lexical_density": digits(density, 3)}
    measures = {k: F.when(some, v) for k, v in measures.items()}
    vocd = F.when(some, digits(found["vocd_d"], 1))
    score = F.round(T.weighted({k: (T.scaled(v, *SCALES[k]), WEIGHTS[k]) for k, v in measures.items()}), 1)
    weights = F.map_filter(
        F.create_map(*[x for k, v in measures.items() for x in (F.lit(k), F.when(v.isNotNull(), F.lit(WEIGHTS[k])))]), lambda _, v: v.isNotNull()
    )
    oov = F.round(shares["oov_rate"], 3) if shares is not None else F.when(n > 0, F.lit(0.0))
    reasons = F.filter(
        F.array(F.when(oov > MAX_OOV, F.concat(F.format_number(oov, 2), F.lit(" of the words are not in the dictionary")))),
        lambda x: x.isNotNull(),
    )
    short = lambda name, least: F.concat(F.lit(f"{name}_too_short: "), known.cast("string"), F.lit(f" known words; at least {least} are needed"))
    warnings = F.filter(
        F.array(
            F.when(n == 0, "insufficient_text: no words").when(~some, "insufficient_text: no dictionary words"),
            F.when(some & (known < MIN_MTLD), short("mtld", MIN_MTLD)),
            F.when(some & (known < MIN_VOCD), short("vocd", MIN_VOCD)),
            F.when(some & (known >= MIN_VOCD) & vocd.isNull(), "vocd_failed: no curve fits"),
        ),
        lambda x: x.isNotNull(),
    )
    rare = shares["rare_once"] if shares is not None else None
    evidence = _evidence(words, sentences, rare)
    return F.struct(
        *[v.alias(k) for k, v in list(measures.items())[:2]], vocd.alias("vocd_d"), measures["lexical_density"].alias("lexical_density"),
        F.when(some, F.round(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n, 1)).alias("avg_word_length"),
        F.lit("letter runs").alias("token_unit"), n.alias("alpha_token_count"), known.alias("known_token_count"), oov.alias("oov_rate"),
        (F.when(some, F.round(shares["rare_word_share"], 3)) if shares is not None else F.lit(None).cast("double")).alias("rare_word_share"),
        F.when(some, T.repeated_ngram_share(words)).alias("repeated_ngram_share"),
        (~some | (F.size(reasons) > 0)).alias("low_reliability"), reasons.alias("reliability_reasons"), weights.alias("score_weights"),
        F.when(some, score).alias("score"), F.when(some, evidence).otherwise(F.slice(evidence, 1, 0)).alias("evidence"), warnings.alias("warnings"),
        F.when(~some, "INSUFFICIENT_TEXT").alias("error"),
    )


def _evidence(words: Column, sentences: Column, rare: Column | None = None) -> Column:
    """Sentences by their share of rare words. rare: such words; without a dictionary, long words that occur once."""

    in_order = F.array_sort(words)
    once = rare if rare is not None else F.transform(
        F.array(in_order),
        lambda o: F.filter(o, lambda w, i: (F.length(w) > RARE_LETTERS) & ~w.eqNullSafe(F.get(o, i - 1)) & ~w.eqNullSafe(F.get(o, i + 1))),
    )[0]

    def of(s: Column, singles: Column) -> Column:
        own = F.transform(F.filter(F.split(s["text"], "\\s+"), lambda w: w.rlike("^\\p{L}+$")), F.lower)
        return F.struct(s["idx"].alias("idx"), s["text"].alias("text"), own.alias("w"), F.array_intersect(own, singles).alias("rare"))

    def item(s: Column) -> Column:
        share = F.round(F.size(s["rare"]) / F.size(s["w"]), 3)
        labels = F.transform(F.slice(s["rare"], 1, 3), lambda w: F.concat(F.lit("rare:"), w))
        return F.struct(
            s["idx"].alias("sentence_idx"), s["text"].alias("sentence"),
            F.concat(labels, F.array(F.concat(F.lit("rare_share:"), share.cast("string")))).alias("triggered_by"),
            share.alias("contribution"),
        )

    found = F.transform(F.array(once), lambda singles: F.transform(sentences, lambda s: of(s, singles)))[0]
    items = F.transform(F.filter(found, lambda s: F.size(s["w"]) > 0), item)
    return rank_evidence(items, ("sentence_idx", "sentence", "triggered_by", "contribution"))
