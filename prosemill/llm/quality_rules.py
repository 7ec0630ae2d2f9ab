"""Quality rules: compression bands.

A text is rejected when its zstandard ratio (compressed over plain bytes) leaves the band for its length:
under the lower limit it repeats itself, over the upper one it is noise. The ratio is taken over the whole
text and over fixed chunks, so that a repetitive stretch in a long text counts as well. A shorter last chunk is
judged by the band for its own length; one too short for any band belongs to the chunk before. Chunks count by bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from prosemill.llm.common import as_bytes, slices

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, low_chunks long, high_chunks long, n_chunks long"
)


@dataclass(frozen=True)
class Bands:
    """(least bytes, lower limit, upper limit) by ascending length; shorter texts than the first have no band.

    Short texts compress worse, so their limits lie higher. Prose lies at 0.40 to 0.75 everywhere in between.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (128, 0.45, 1.05),
        (256, 0.40, 0.98),
        (512, 0.35, 0.92),
        (1024, 0.30, 0.85),
        (2048, 0.28, 0.80),
        (4096, 0.25, 0.75),
    )
    chunk_bytes: int = 2048
    #: A text goes when chunks with more than this share of its bytes leave their band.
    bad_share: float = 0.25
    level: int = 3

    def of(self, n: int) -> tuple[float, float]:
        found = (0.0, float("inf"))
        for least, low, high in self.limits:
            if n >= least:
                found = (low, high)
        return found

    def chunks(self, raw: bytes) -> list[bytes]:
        """raw cut every chunk_bytes; what is left over under the least bytes of a band stays with the chunk before."""
        cuts = list(range(0, len(raw), self.chunk_bytes))
        if len(cuts) > 1 and self.limits and len(raw) - cuts[-1] < self.limits[0][0]:
            cuts.pop()
        return [raw[a:b] for a, b in itertools.pairwise([*cuts, len(raw)])]


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 21:  # the product of three would overflow
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(seen) + ids[2:]
    _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = n[which] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def judged(raw: bytes, n_chars: int, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    """The columns of SCHEMA after doc_id for one text in UTF-8."""
    words = raw.split()  # at the six ASCII white-space bytes, as the word rule says
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = repeated_words(words)
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    ratio = len(press.compress(raw)) / len(raw) if raw else 0.0
    low, high = bands.of(len(raw))
    good = low <= ratio <= high
    chunks = lows = highs = bad = 0
    for chunk in bands.chunks(raw):
        low, high = bands.of(len(chunk))
        r = len(press.compress(chunk)) / len(chunk)
        chunks, lows, highs = chunks + 1, lows + (r < low), highs + (r > high)
        bad += 0 if low <= r <= high else len(chunk)
    good = good and bad <= bands.bad_share * len(raw)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (
        len(words), n_chars - spaces, symbols, len(lines) - len(set(lines)), repeated,
        failed, not failed and good, ratio, lows, highs, chunks,
    )


def _batches(batches: Iterator[pa.RecordBatch], text: str, bands: Bands) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    press = zstandard.ZstdCompressor(level=bands.level)
    for batch in slices(batches):
        texts = as_bytes(batch.column(text))
        chars = pa.compute.utf8_length(batch.column(text)).fill_null(0).to_pylist()
        yield batch, [judged(x, n, bands, press) for x, n in zip(texts, chars, strict=True)]


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The counts and the verdict for each row of docs (SCHEMA).

    A null text counts as empty: no words, base_failed. A null id stays null. Equal rows give equal rows.
    Other columns are not read. No shuffle; a task holds one batch of texts.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _batches(batches, "text", bands):
            columns = [list(x) for x in zip(*found, strict=True)] or [[] for _ in names[1:]]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names)

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)


def keep_by_rules(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that the rules keep.

    Null and empty texts go. Equal rows stay or go together; without rows there are none.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _batches(batches, text, bands):
            yield batch.filter(pa.array([x[6] for x in found], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
