"""Text primitives: columns in, columns out. A null text gives null or empty results, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "\\p{L}+"
#: A token is a run of letters, a run of digits, or one other visible character.
TOKEN = "\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def found(text: Column | str, pattern: str) -> Column:
    """All matches of pattern, in order."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pattern), F.lit(0))


def cleaned(text: Column | str) -> Column:
    """Without links, mentions and tags; runs of white space are one space."""
    x = F.regexp_replace(F.coalesce(_c(text), F.lit("")), "(?U)http\\S+|www\\S+", "")
    x = F.regexp_replace(x, "(?U)[@#]\\w+", "")
    return F.trim(F.regexp_replace(x, "(?U)\\s+", " "))


def is_blank(text: Column | str) -> Column:
    return F.coalesce(~_c(text).rlike("(?U)\\S"), F.lit(True))


def tokens(text: Column | str) -> Column:
    return found(text, TOKEN)


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters."""
    return F.transform(found(text, WORD), F.lower)


def count(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(pattern))


def word_count(text: Column | str) -> Column:
    return count(text, WORD)


def token_count(text: Column | str) -> Column:
    """Tokens but punctuation."""
    return count(text, "\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}\\p{P}]")


def terminal_marks(text: Column | str) -> Column:
    """Runs of sentence-ending marks."""
    return count(text, "[.!?…]+")


def sentences(text: Column | str) -> Column:
    """array<struct<idx, text>>: the text cut after . ! ? and white space. idx is kept whatever is removed later."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), "(?<=[.!?])\\s+", -1)
    numbered = F.transform(parts, lambda s, i: F.struct(i.alias("idx"), F.trim(s).alias("text")))
    return F.filter(numbered, lambda s: F.length(s["text"]) > 0)


def segments(text: Column | str, least_words: int = 5) -> Column:
    """Pieces after sentence ends and line feeds that have enough words to tell a language by."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), "(?<=[.!?])\\s+|\\n+", -1)
    return F.filter(parts, lambda s: F.regexp_count(s, F.lit(WORD)) >= least_words)


def ngrams(array: Column, n: int) -> Column:
    """Runs of n neighbours, joined by a space."""
    last = F.size(array) - n + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(array, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def repeated_ngram_share(array: Column, n: int = 3, digits: int | None = 3) -> Column:
    """Share of n-grams that aren't the first of their kind; 0 without any."""
    share = F.transform(
        F.array(ngrams(array, n)), lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0)
    )[0]
    return share if digits is None else F.round(share, digits)


def scaled(value: Column, low: float, high: float) -> Column:
    """0 to 100 between low and high; a null stays null, which least() and greatest() alone would not keep."""
    return F.when(value.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), (value - low) / (high - low) * 100)))


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't null; null if all are."""
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts.values()), F.lit(0.0))
    value = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts.values()), F.lit(0.0))
    return F.when(total > 0, value / total)


def syllables(word: Column) -> Column:
    """Runs of vowels, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit("(?i)[aeiou]+")))


def english_syllables(word: Column) -> Column:
    """Runs of vowels and y, less a silent e at the end, one at least."""
    runs = F.regexp_count(word, F.lit("(?i)[aeiouy]+"))
    silent = F.when(word.rlike("(?i)[^aeiouyl]e\\W*$"), 1).otherwise(0)
    return F.greatest(F.lit(1), runs - silent)
