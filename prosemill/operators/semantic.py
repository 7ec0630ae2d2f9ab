"""Continuity of neighbouring sentences: near-duplicates, similarity, drift and lexical chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators.evidence import rank_evidence
from prosemill.policy import Policy

# Weights, scales and limits of the notes that results must agree with.
WEIGHTS = {"similarity": 0.45, "drift": 0.25, "chain": 0.20}
CHAIN_SCALE, DRIFT_SCALE, HIGH, LOW = (0.1, 0.6), 0.3, 0.75, 0.50


def dedupe(sentences: Column, threshold: float = 0.8) -> Column:
    """The sentences that are kept, each as struct(idx, text, words).

    A sentence goes if its set of words has a Jaccard similarity of the threshold or more with an earlier one that
    was kept; what is compared depends on what went before, so it is a fold. Sentences without words always stay.
    """
    rows = F.transform(
        sentences, lambda s: F.struct(s["idx"].alias("idx"), s["text"].alias("text"), F.array_sort(F.array_distinct(T.words(s["text"]))).alias("words"))
    )

    def near(kept: Column, s: Column) -> Column:
        def close(k: Column) -> Column:
            both = F.size(F.array_intersect(k["words"], s["words"]))
            return (k["words"] == s["words"]) | (both >= threshold * (F.size(k["words"]) + F.size(s["words"]) - both))

        # sets whose sizes differ too much can't be close; sets without words are never compared
        fits = lambda k: (F.size(k["words"]) >= threshold * F.size(s["words"])) & (F.size(s["words"]) >= threshold * F.size(k["words"]))
        return (F.size(s["words"]) > 0) & F.exists(kept, lambda k: (F.size(k["words"]) > 0) & fits(k) & close(k))

    start = F.slice(rows, 1, 0)
    return F.aggregate(rows, start, lambda kept, s: F.when(near(kept, s), kept).otherwise(F.concat(kept, F.array(s))))


def moved(boundaries: Column, kept_idx: Column) -> Column:
    """array<struct<at, to>>: for each boundary the first kept sentence from there on; null if there is none."""
    return F.transform(boundaries, lambda b: F.struct(b.alias("at"), F.array_min(F.filter(kept_idx, lambda k: k >= b)).alias("to")))


def remapped(boundaries: Column, kept_idx: Column) -> Column:
    """Boundaries on removed sentences move to the next kept one, or go if there is none."""
    return F.array_distinct(F.filter(F.transform(moved(boundaries, kept_idx), lambda x: x["to"]), lambda x: x.isNotNull()))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors; null if one has no length or is null."""
    norm = lambda v: F.sqrt(dot(v, v))
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def neighbours(rows: DataFrame, group: str, order: str, item: str, similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """group, order, next, raw: each row with the next one of its group, and how alike they are.

    For items that stand in rows of their own, as sentences of long documents or turns of conversations do.
    """
    by = Window.partitionBy(group).orderBy(order)
    both = rows.select(group, order, F.col(item).alias("a"), F.lead(item).over(by).alias("b"), F.lead(order).over(by).alias("next"))
    return both.where("next IS NOT NULL").select(group, order, "next", similarity(F.col("a"), F.col("b")).alias("raw"))


def word_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets of words; 0 if one is empty."""
    both, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.when((n > 0) & (m > 0), both / F.sqrt(n * m.cast("double"))).otherwise(0.0)


def note(similarity: Column) -> Column:
    return F.when(similarity > HIGH, "high overlap").when(similarity < LOW, "low overlap").otherwise("moderate overlap")


def transitions(kept: Column, boundaries: Column, vectors: Column | None = None) -> Column:
    """array<struct<sentence_idx_from, sentence_idx_to, raw>> of neighbours that no boundary parts.

    vectors: a map from idx to the sentence's vector, used if all the kept sentences have one.
    """

    def pair(i: Column) -> Column:
        a, b = F.element_at(kept, i), F.element_at(kept, i + 1)
        raw = word_cosine(a["words"], b["words"])
        if vectors is not None:
            every = vectors.isNotNull() & F.forall(kept, lambda k: F.try_element_at(vectors, k["idx"]).isNotNull())
            by_vector = cosine(F.try_element_at(vectors, a["idx"]), F.try_element_at(vectors, b["idx"]))
            raw = F.when(every, F.coalesce(by_vector, F.lit(0.0))).otherwise(raw)
        return F.struct(a["idx"].alias("sentence_idx_from"), b["idx"].alias("sentence_idx_to"), raw.alias("raw"))

    pairs = F.when(F.size(kept) > 1, F.transform(F.sequence(F.lit(1), F.size(kept) - 1), pair))
    return F.filter(F.coalesce(pairs, F.array()), lambda p: ~F.array_contains(boundaries, p["sentence_idx_to"]))


def chain_density(kept: Column) -> Column:
    """Share of long words between white space, punctuation and all, that two or more kept sentences have."""

    def of(every: Column) -> Column:
        n = F.size(F.array_distinct(every))
        return F.when(n > 0, F.size(F.array_distinct(F.filter(every, lambda w, i: w.eqNullSafe(F.get(every, i + 1))))) / n).otherwise(0.0)

    own = lambda s: F.array_distinct(F.filter(F.split(F.lower(s["text"]), "\\s+"), lambda w: F.length(w) > 4))
    return F.round(F.transform(F.array(F.array_sort(F.flatten(F.transform(kept, own)))), of)[0], 3)


def analyze(
    sentences: Column, boundaries: Column | None = None, policy: Policy = Policy(), vectors: Column | None = None, labels: Column | None = None
) -> Column:
    """The semantic result; without two distinct sentences, or any transition, the score is null and note says why.

    sentences: array<struct<idx, text>>; boundaries: idx at which a new document begins; vectors: as transitions()
    takes them; labels: those of the document's entities.
    """
    edges = F.coalesce(boundaries, F.array().cast("array<int>")) if boundaries is not None else F.array().cast("array<int>")
    none = F.array().cast("array<string>")

    def of(kept: Column) -> Column:
        at = remapped(edges, F.transform(kept, lambda k: k["idx"]))
        return F.transform(F.array(transitions(kept, at, vectors)), lambda t: result(kept, t))[0]

    def result(kept: Column, t: Column) -> Column:
        n, total, left = F.size(t), F.size(sentences), F.size(kept)
        measured = (left >= 2) & (n > 0)
        mean = F.aggregate(t, F.lit(0.0), lambda a, x: a + x["raw"]) / n
        spread = F.sqrt(F.aggregate(t, F.lit(0.0), lambda a, x: a + (x["raw"] - mean) * (x["raw"] - mean)) / n)
        similarity = F.when(measured, F.round(mean, 3))
        drift = F.when(measured & (n >= policy.min_drift_transitions), F.round(spread, 3))
        chain = F.when(measured, chain_density(kept))
        low, high = policy.similarity_scale
        score = F.round(T.weighted({
            "similarity": (T.scaled(similarity, low, high), WEIGHTS["similarity"]),
            "drift": (T.scaled(1 - drift / DRIFT_SCALE, 0.0, 1.0), WEIGHTS["drift"]),
            "chain": (T.scaled(chain, *CHAIN_SCALE), WEIGHTS["chain"]),
        }), 1)
        items = F.transform(t, lambda x: F.struct(
            x["sentence_idx_from"].alias("sentence_idx_from"), x["sentence_idx_to"].alias("sentence_idx_to"),
            F.round(x["raw"], 3).alias("similarity"), note(x["raw"]).alias("note"), F.round(x["raw"], 3).alias("contribution"),
        ))
        fields = ("sentence_idx_from", "sentence_idx_to", "similarity", "note", "contribution")
        return F.struct(
            similarity.alias("adjacent_sentence_similarity"), drift.alias("topic_drift_index"), chain.alias("lexical_chain_density"),
            (F.coalesce(labels, none) if labels is not None else none).alias("entity_labels"), F.when(measured, n).otherwise(0).alias("transitions"),
            F.when(measured, "uncalibrated").alias("scaling_status"), (total - left).alias("duplicate_sentences_removed"),
            F.when(total > 0, F.round((total - left) / total, 3)).alias("duplicate_sentence_ratio"), F.when(measured, score).alias("score"),
            F.when(measured, rank_evidence(items, fields)).otherwise(F.slice(rank_evidence(items, fields), 1, 0)).alias("evidence"),
            F.when(left < 2, "too few distinct sentences").when(n == 0, "no transition within a document").alias("note"),
        )

    return F.transform(F.array(dedupe(sentences, policy.near_duplicate)), of)[0]
