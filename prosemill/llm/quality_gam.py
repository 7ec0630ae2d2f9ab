"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Boosting goes round the features in turn; each shallow tree, of two
levels on one feature's bins, is added to that feature's lookup table. Then the pairs of features with the
largest gain on what is left get two-way tables in the same manner. A score is the logistic function of
the sum of the looked-up values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import as_bytes, col, slices, text_key

FEATURES = (
    "log_bytes", "log_words", "upper", "symbols", "exclamations", "digits", "stops", "commas", "bars", "wide",
    "word_length", "distinct_words", "top_word", "short_words", "doubled_words", "log_lines", "repeated_lines",
    "capital_words", "odd_ends", "ratio",
)
UPPER, SYMBOLS, DIGITS, ASCII = bytes(range(65, 91)), b"#*$%&<>@^~_=+\\{}[]", b"0123456789", bytes(range(128))
SYMBOL_ENDS = tuple(SYMBOLS)
#: Labelled rows that the model is fitted on at most; the choice among more follows a hash of doc_id.
MOST_LABELS = 20_000
THRESHOLD = 0.7


def features(raw: bytes, press: zstandard.ZstdCompressor) -> tuple[float, ...]:
    """FEATURES of a text in UTF-8; all are defined for the empty text."""
    n = max(1, len(raw))
    words = raw.split()
    w = max(1, len(words))
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / n
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        np.log1p(len(raw)), np.log1p(len(words)), share(UPPER), share(SYMBOLS), raw.count(b"!") / n, share(DIGITS),
        raw.count(b".") / n, raw.count(b",") / n, raw.count(b"|") / n, 1 - share(ASCII) if raw else 0.0,
        sum(map(len, words)) / w, len(seen) / w, max(seen.values(), default=0) / w, sum(len(x) < 4 for x in words) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, np.log1p(len(lines)), (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(x[0] < 91 and x[0] > 64 for x in words) / w, sum(x[-1] in SYMBOL_ENDS for x in words) / w,
        len(press.compress(raw)) / n,
    )


@dataclass
class Gam:
    """edges: a feature's bin limits; tables, pair_tables: the learnt lookup tables."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    return g / (h + smooth)


def _split(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[int, float]:
    """Where to cut bins in two, and the gain; the cut is 0 if nothing is gained."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0, 0.0
    gain = gl**2 / (hl + smooth) + (g.sum() - gl) ** 2 / (h.sum() - hl + smooth) - g.sum() ** 2 / (h.sum() + smooth)
    k = int(np.argmax(gain))
    return (k + 1, float(gain[k])) if gain[k] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, smooth: float, depth: int = 2) -> np.ndarray:
    """A tree's value for each bin."""
    cut, _ = _split(g, h, smooth) if depth else (0, 0.0)
    if not cut:
        return np.full(len(g), _leaf(g.sum(), h.sum(), smooth))
    return np.concatenate([_tree(g[:cut], h[:cut], smooth, depth - 1), _tree(g[cut:], h[cut:], smooth, depth - 1)])


def _gains(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of bins the best cut in two (0: none) and its score, the parts' squares over their weights."""
    left, weight = np.cumsum(g, 1), np.cumsum(h, 1)
    score = left**2 / (weight + smooth) + (left[:, -1:] - left) ** 2 / (weight[:, -1:] - weight + smooth)
    best = score.argmax(1)  # after the last bin: no cut
    return (best + 1) % g.shape[1], np.take_along_axis(score, best[:, None], 1)[:, 0]


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """The best tree that cuts the one feature, then each side by the other; its values, and the gain."""
    whole = g.sum() ** 2 / (h.sum() + smooth)
    best = (np.full(g.shape, _leaf(g.sum(), h.sum(), smooth)), 0.0)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        up_a, up_b = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]
        if not len(up_a):
            continue
        (low, low_score), (high, high_score) = _gains(up_a, up_b, smooth), _gains(a.sum(0) - up_a, b.sum(0) - up_b, smooth)
        k = int(np.argmax(low_score + high_score))
        gain = float(low_score[k] + high_score[k] - whole)
        if gain > best[1] + 1e-12:
            value = np.empty(a.shape)
            for side, cut in ((slice(0, k + 1), int(low[k])), (slice(k + 1, None), int(high[k]))):
                for part in (slice(0, cut), slice(cut, None)):
                    if a[side, part].size:
                        value[side, part] = _leaf(a[side, part].sum(), b[side, part].sum(), smooth)
            best = (value.T if turn else value, gain)
    return best


def fit_gam(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, most_pairs: int = 6, most_bins: int = 24,
    rate: float = 0.15, smooth: float = 2.0,
) -> Gam:
    """x: a row of features for each label y (0 or 1). Without rows of both classes the score is constant."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, most_bins + 1)[1:-1])) if len(x) else np.empty(0) for c in x.T]
    model = Gam(edges)
    p = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(p / (1 - p)))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    if len(set(y.tolist())) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(y), model.intercept)
    slopes = lambda: (y - (q := 1 / (1 + np.exp(-total))), q * (1 - q))
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), smooth)
            t += step
            total += step[b[:, j]]
    g, h = slopes()

    def summed(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(model.tables[i]), len(model.tables[j]))
        return np.bincount(b[:, i] * shape[1] + b[:, j], v, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(len(edges)), 2), key=lambda ij: -_pair_tree(summed(*ij, g), summed(*ij, h), smooth)[1])
    model.pairs = ranked[:most_pairs]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = rate * _pair_tree(summed(i, j, g), summed(i, j, h), smooth)[0]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def _featured(plain: DataFrame) -> DataFrame:
    """label, rank and features of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            x = pa.array([list(features(t, press)) for t in as_bytes(batch.column("text"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rank"), x], ["label", "rank", "x"])

    return plain.mapInArrow(run, "label int, rank long, x array<double>")


def held_out(id_col: Column) -> Column:
    """Rows kept from the fit: crc32 of doc_id as text leaves 2 when divided by 4. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most_labels: int = MOST_LABELS,
) -> Gam:
    """A model of the labels 0 and 1 of the rows that aren't held out; null ids and labels don't count.

    Of more than most_labels such rows it takes those with the smallest hashes, first of ids, then, where rows of docs
    share ids, of ids with texts. An id labelled twice counts twice, and so do rows of docs that share it. A null text is
    the empty one. Ties don't matter: rows equal in hash and label are equal, or as good as any others.
    """
    used = labels.where(col(id_col).isNotNull() & col(label_col).isin(0, 1) & ~held_out(col(id_col)))
    chosen = (
        used.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(most_labels)
    )
    plain = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    ranked = plain.join(F.broadcast(chosen), "doc_id").select("label", F.xxhash64("doc_id", text_key("text")).alias("rank"), "text")
    rows = _featured(ranked).orderBy("rank", "label", "x").limit(most_labels).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    y = rows["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the order in which rows arrive must not matter
    return fit_gam(x[order], y[order])


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. A null text is scored as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            x = np.array([features(t, press) for t in as_bytes(batch.column("text"))], float).reshape(-1, len(FEATURES))
            score = model.score(x)
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    plain = docs.select(
        col(id_col).cast("long").alias("doc_id"), held_out(col(id_col)).alias("held_out"), col(text_col).cast("string").alias("text")
    )
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
