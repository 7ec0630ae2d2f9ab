"""Mixing sources to target weights, by soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains. Document rates from 0
to a limit are then fitted by projected-gradient least squares, so that the expected tokens of each domain
match the target weights. Documents with the same features have the same posterior, and so the same rate at
every step: the steps need only the tokens of each feature profile, whose number the bins bound, whatever the data.
These come from one aggregate; the driver works the steps out, thousands where posteriors overlap. Features,
posteriors and rates of documents are column expressions.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import col, columns_of, text_key, unused, written

#: Rows of the labelled table that the classifier learns from at most, by a hash of their id.
MOST_LABELS = 10_000
#: Words that speak for a domain, as many for each domain but the largest.
MOST_WORDS = 20
#: Profiles that the driver fits rates to at most; more are an error. Three domains can have 61,440 by their bins.
MOST_PROFILES = 500_000
#: Bin limits of the features that every model has, in the order of _values.
LIMITS = {
    "symbols": (0.005, 0.02, 0.05), "exclamations": (0.002, 0.01, 0.03), "capitals": (0.05, 0.15, 0.4), "bars": (0.002, 0.01),
    "pieces": (0.05, 0.12, 0.2, 0.3), "distinct": (0.1, 0.25, 0.4),
}
#: Bin limits of the occurrences of a domain's words, a character.
TOLD = (1e-9, 5e-4, 2e-3)
#: The steps end when none moves a rate by CLOSE, which is where the least squares no longer improve, or after STEPS.
STEPS, CLOSE = 20_000, 1e-10


def _left(text: Column, parts: str) -> Column:
    return F.length(text) - F.length(reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), parts, text))


def _values(text: Column, words: dict[str, list[str]]) -> dict[str, Column]:
    """The features that are cut into bins: shares of the characters, and of the pieces between spaces."""
    n = F.greatest(F.length(text), F.lit(1))
    parts = F.split(text, " ", -1)
    fixed = {
        "symbols": _left(text, "#*$%&") / n, "exclamations": _left(text, "!") / n,
        "capitals": F.regexp_count(text, F.lit("\\p{Lu}{2}")) * 2 / n, "bars": _left(text, "|") / n,
        "pieces": F.size(parts) / n, "distinct": F.size(F.array_distinct(parts)) / F.size(parts),
    }
    told = {f"told {d}": F.regexp_count(text, F.lit("(?i)\\b(?:" + "|".join(w) + ")\\b")) / n for d, w in words.items()}
    return fixed | told


@dataclass(frozen=True)
class Mixer:
    """domains in order; words: what speaks for a domain; prior, logs: the classifier; history: the fitted steps;
    labelled: whether the classifier had rows to learn from; residuals: what fit_rates missed by, for each domain."""

    domains: tuple[str, ...]
    words: dict[str, list[str]]
    prior: tuple[float, ...] = ()
    logs: tuple = ()
    history: tuple[tuple[float, ...], ...] = ()
    most_rate: float = 1.0
    labelled: bool = False
    residuals: tuple[float, ...] = ()

    @property
    def limits(self) -> dict[str, tuple[float, ...]]:
        return LIMITS | {f"told {d}": TOLD for d in self.words}

    def profile(self, text: Column) -> Column:
        """The bins of the features of a text, a digit for each; there are as many profiles as the bins allow."""
        text = F.coalesce(text, F.lit(""))
        found = _values(text, self.words)
        return F.concat(*[reduce(lambda c, x: c + (v >= x).cast("int"), self.limits[k], F.lit(0)).cast("string") for k, v in found.items()])  # noqa: B023

    def bins(self, profile: Column) -> Column:
        """The bins, as an array, of what profile() made."""
        return F.array(*[F.substring(profile, k, 1).cast("int") for k in range(1, len(self.limits) + 1)])

    def posterior(self, bins: Column) -> Column:
        """An array of the domains' probabilities; bins should be a plain column, as it is used often."""
        odds = [
            reduce(Column.__add__, [F.element_at(F.array(*map(F.lit, by_bin)), bins[j] + 1) for j, by_bin in enumerate(of)], F.lit(p))
            for p, of in zip(self.prior, self.logs, strict=True)
        ]

        def shares(x: Column) -> Column:
            total = F.aggregate(x, F.lit(0.0), lambda a, b: a + F.exp(b - F.array_max(x)))
            return F.transform(x, lambda b: F.exp(b - F.array_max(x)) / total)

        return F.transform(F.array(F.array(*odds)), shares)[0]

    def rate(self, p: Column) -> Column:
        """The rate after all steps: each moves it against the domains' residuals, back into [0, most_rate]."""
        if not self.history:
            return F.least(F.lit(1.0), F.lit(float(self.most_rate)))
        steps = F.from_json(F.lit(json.dumps(self.history)), "array<array<double>>")

        def moved(r: Column, step: Column) -> Column:
            pull = reduce(Column.__add__, [p[i] * step[i] for i in range(len(self.domains))])
            return F.least(F.greatest(r - pull, F.lit(0.0)), F.lit(float(self.most_rate)))

        return F.aggregate(steps, F.lit(1.0), moved)


def copies_of(rate: Column, *key: Column) -> Column:
    """rate rounded up or down, so that its mean is kept; which of them follows from a hash of the key."""
    u = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def telling_words(labelled: DataFrame, most: int = MOST_WORDS) -> dict[str, list[str]]:
    """For each domain but the largest: the words of the largest log-odds that at least 10 of its texts have."""
    letters = F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{4,}"), F.lit(0))
    sizes = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    largest = max(sorted(sizes), key=sizes.__getitem__)
    counts = (
        labelled.select("domain", F.explode(F.array_distinct(letters)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("all"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"in {d}") for d in sizes if d != largest])
    )
    counts = written(counts.where("all >= 10"), "mixing-words")
    found, total = {}, sum(sizes.values())
    for d in sorted(set(sizes) - {largest}):
        inside = F.col(f"in {d}")
        odds = F.log((inside + 0.5) / (sizes[d] + 1)) - F.log((F.col("all") - inside + 0.5) / (total - sizes[d] + 1))
        rows = counts.where(inside >= 10).withColumn("odds", odds).where("odds > 3").orderBy(F.desc("odds"), "word").limit(most)
        if words := [r["word"] for r in rows.collect()]:
            found[d] = words
    return found


def fit_posterior(labelled: DataFrame, domains: list[str]) -> Mixer:
    """Naive Bayes over the binned features. labelled: domain, text; a null text is the empty one, repeated rows count each.

    Without rows all domains are alike. With some, a domain that has none gets no share of any text: smoothing
    alone would give it texts that are merely rare.
    """
    mixer = Mixer(tuple(domains), {d: w for d, w in telling_words(labelled).items() if d in domains})
    profiled = labelled.select("domain", mixer.profile(F.col("text")).alias("profile")).groupBy("domain", "profile").count()
    rows = profiled.select("domain", "count", F.posexplode(mixer.bins(F.col("profile"))).alias("feature", "bin"))
    rows = rows.groupBy("domain", "feature", "bin").agg(F.sum("count").alias("n"))
    counts = {(r["domain"], r["feature"], r["bin"]): r["n"] for r in rows.collect()}
    sizes = {d: sum(n for (e, f, _), n in counts.items() if (e, f) == (d, 0)) for d in domains}
    n = sum(sizes.values())
    prior = tuple(math.log((sizes[d] + 1) / (n + len(domains))) if sizes[d] or not n else -math.inf for d in domains)
    logs = tuple(
        tuple(
            tuple(math.log((counts.get((d, j, k), 0) + 0.5) / (sizes[d] + 0.5 * (len(x) + 1))) for k in range(len(x) + 1))
            for j, x in enumerate(mixer.limits.values())
        )
        for d in domains
    )
    return replace(mixer, prior=prior, logs=logs, labelled=n > 0)


def fit_rates(
    profiles: DataFrame, mixer: Mixer, weights: list[float], total: float | None, most_rate: float, most_profiles: int = MOST_PROFILES
) -> Mixer:
    """mixer with the steps of the projected gradient. profiles: p (posteriors), tokens.

    Minimises the sum over domains of the squared miss of their expected tokens, each over its tokens at rate 1, over
    rates in [0, most_rate], from rate 1. The domain of the largest weight sets the total; the share of one that
    hasn't as much is only an upper bound, and all it has its target. residuals: expected tokens over the share of the
    total, less 1 (of a domain with weight 0, over the total).
    """
    taken = profiles.select("p", "tokens").limit(most_profiles + 1).collect()
    if len(taken) > most_profiles:
        raise ValueError(f"more than {most_profiles} profiles: so many domains need fewer bins, or a larger most_profiles")
    rows = sorted((tuple(r["p"]), float(r["tokens"])) for r in taken)
    p, tokens = np.array([r[0] for r in rows]).reshape(-1, len(weights)), np.array([r[1] for r in rows])
    mass, share = tokens @ p, np.array(weights)
    if total is None:  # all of the domain with the largest weight; of equal ones, of that with the most tokens
        total = max((most_rate * m / w for m, w in zip(mass.tolist(), weights, strict=True) if w == max(weights)), default=0.0)
    targets = np.minimum(total * share, most_rate * mass)
    rate, history = np.full(len(tokens), min(1.0, float(most_rate))), []
    while True:
        got = (rate * tokens) @ p
        step = np.divide(got - targets, mass, out=np.zeros_like(mass), where=mass > 0)
        moved = np.clip(rate - p @ step, 0.0, most_rate)
        change = np.abs(moved - rate).max(initial=0.0)
        if change < CLOSE:
            break
        if len(history) == STEPS:
            warnings.warn(f"rates still move by {change:.1e} after {STEPS} steps", stacklevel=2)
            break
        history.append(tuple(step.tolist()))
        rate = moved
    missed = got - total * share
    over = np.where(share > 0, total * share, total)
    residuals = np.divide(missed, over, out=np.zeros_like(missed), where=over > 0)
    return replace(mixer, history=tuple(history), most_rate=most_rate, residuals=tuple(residuals.tolist()))


@dataclass(frozen=True)
class Mixture:
    """documents: doc_id, th, n_tokens, profile; rates: profile, p, rate, as many rows as the bins allow at most."""

    mixer: Mixer
    documents: DataFrame
    rates: DataFrame

    @property
    def residuals(self) -> dict[str, float]:
        """For each domain, its expected tokens over those wanted, less 1. Empty if nothing was fitted."""
        return dict(zip(self.mixer.domains, self.mixer.residuals, strict=False))

    def table(self) -> DataFrame:
        """doc_id, n_tokens, p_<domain>, rate, copies for each document.

        An empty or null text has one empty token; a null id stays null. Repeated rows get the same decision. What is
        broadcast are the rates, MOST_PROFILES rows at most.
        """
        rows = self.documents.join(F.broadcast(self.rates), "profile")
        shares = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(self.mixer.domains)]
        return rows.select("doc_id", "n_tokens", *shares, "rate", copies_of(F.col("rate"), F.col("doc_id"), F.col("th")).alias("copies"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of docs, with all their columns, whatever their names, as often as the mixture takes them.

        docs: those that the mixture was fitted to. Nulls and repeated rows are as in table().
        """
        profile, rate, copy = unused(docs, "mix_profile", "mix_rate", "mix_copy")
        rates = self.rates.select(F.col("profile").alias(profile), F.col("rate").alias(rate))
        rows = docs.withColumn(profile, self.mixer.profile(col(text_col))).join(F.broadcast(rates), profile)
        copies = copies_of(F.col(rate), col(id_col).cast("long"), text_key(text_col))
        if self.mixer.most_rate > 1:
            rows = rows.withColumn(copy, F.explode(F.when(copies >= 1, F.sequence(F.lit(1), copies.cast("int")))))
            return rows.select(*columns_of(docs))
        return rows.where(copies >= 1).select(*columns_of(docs))


def fit_mixture(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    domain_col: str = "domain", total: float | None = None, most_rate: float = 1.0, most_labels: int = MOST_LABELS,
) -> Mixture:
    """The mixture whose rates bring the expected tokens of each domain in docs to its share of weights.

    A token is a piece between spaces. weights: target share of each domain; they are made to sum to 1. total:
    expected tokens of the mixture; by default as many as the domain of the largest weight allows without a rate
    over most_rate. Domains that are scarcer than their share are taken whole, up to most_rate, and never lower the
    rates of others. Labelled rows with null or unknown domain or null id don't count; without one of a domain of
    the largest weight nothing tells what to keep, and all rates are 1 (or most_rate, if that is less). A null
    text is empty (one empty token); a null id stays null. Repeated rows get the same decision.
    """
    domains = sorted(weights)
    share = [weights[d] / sum(weights.values()) for d in domains]
    chosen = (
        labelled.where(col(id_col).isNotNull() & col(domain_col).isin(domains))
        .select(col(id_col).cast("long").alias("doc_id"), col(domain_col).alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain")
        .limit(most_labels)
    )
    plain = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    learnt = written(plain.join(F.broadcast(chosen), "doc_id").select("domain", "text"), "mixing-labels")
    mixer = fit_posterior(learnt, domains)
    documents = written(
        plain.select(
            "doc_id", text_key("text").alias("th"), F.size(F.split("text", " ", -1)).cast("long").alias("n_tokens"),
            mixer.profile(F.col("text")).alias("profile"),
        ),
        "mixing-documents",
    )
    bins = documents.groupBy("profile").agg(F.sum("n_tokens").alias("tokens")).withColumn("bins", mixer.bins(F.col("profile")))
    rows = written(bins.select("profile", mixer.posterior(F.col("bins")).alias("p"), "tokens"), "mixing-profiles")
    if any(w == max(share) and x > -math.inf for w, x in zip(share, mixer.prior, strict=True)) and mixer.labelled:
        mixer = fit_rates(rows, mixer, share, total, most_rate)
    else:
        mixer = replace(mixer, most_rate=most_rate)
    return Mixture(mixer, documents, written(rows.select("profile", "p", mixer.rate(F.col("p")).alias("rate")), "mixing-rates"))


def labelled_domains(labels: DataFrame) -> DataFrame:
    """The labels table as doc_id, domain: toxic, else good or poor by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


#: Shares of the mixture's words by domain.
WEIGHTS = {"good": 0.96, "poor": 0.015, "toxic": 0.025}
