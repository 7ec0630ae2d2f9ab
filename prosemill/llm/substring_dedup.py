"""Substring dedup: passages of WINDOW words or more that occur earlier in the corpus, by FM-indexes of shards.

Each window of 20 words has an anchor, the run of 6 words in it with the least hash; equal windows have equal
anchors. Neighbouring windows with the same anchor form a segment. Segments whose anchor occurs once can hold no
repeated window. The others are dealt to shards by anchor, so that equal windows meet in one shard. A shard
builds a compressed FM-index of its distinct segments and streams them through it: backward search over the
wavelet tree gives matching statistics, and matches of WINDOW words the rows of all equal windows, of which the
earliest keeps its words.

Two things keep an anchor that a great many documents have from overfilling its shard. A task sends on of equal
segments only the earliest that it has met; all windows of the others begin earlier too, by that one. And a segment of
a heavy anchor is first cut down to windows that occur more than once, then into parts in which the anchor's place in
the window varies by SPAN at most: all windows of such a part share its 20 - SPAN + 1 middle words, which take the
place of the anchor. A shard so gets of a passage that stands everywhere a few short parts from each task, and what
the documents have around it not at all. Shards' indexes treat these parts like any segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import (
    as_bytes, bitmaps, col, dropped, has_bit, order_id, slices, slot_of, slots, text_key, window_hashes, word_hashes, written,
)
from prosemill.llm.fm_index import FMIndex, matches

WINDOW, ANCHOR = 20, 6
#: Places of the anchor in the windows of a part of a segment.
SPAN = 4
#: Bits of the filters: repeated anchors and windows, heavy anchors, marked documents. They let more through as they fill.
REPEATED_BITS, HEAVY_BITS, MARKED_BITS = 27, 23, 24
#: Segments of a shard, equal ones included. An anchor with more than HEAVY is cut into parts.
SHARD_SEGMENTS = 10_000
HEAVY = SHARD_SEGMENTS // 5
#: Digests of segments that a task remembers at once.
REMEMBERED = 100_000


def segments(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and its place for each segment of a text, from the hashes of its words."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = window_hashes(hashes, ANCHOR)
    near = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - ANCHOR + 1)
    anchor = near.argmin(1) + np.arange(len(near))
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return first, np.diff(np.append(first, len(anchor))), runs[anchor[first]], anchor[first]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [segments(word_hashes(raw.split()))[2] for raw in as_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["anchor"])


MARKS = "array<struct<start:int,windows:int,mask:binary>>"
#: A segment or a part of one (words, place of the first window and of the anchor in it), or the marks of one or of several.
SEGMENTS = f"key long, heavy boolean, dk long, th long, start int, windows int, offset int, words binary, marks {MARKS}"
NAMES = ["key", "heavy", "dk", "th", "start", "windows", "offset", "words", "marks"]
MARK_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("mask", pa.binary())]))
KINDS = [pa.int64(), pa.bool_(), *[pa.int64()] * 2, *[pa.int32()] * 3, pa.binary(), MARK_TYPE]


class Merger:
    """Lets of equal segments only the first through that it is shown, and ones at earlier places than those before.

    All windows of the others begin earlier too; they become marks. It forgets now and then, which only lets more through.
    """

    def __init__(self) -> None:
        self.first: dict[bytes, tuple] = {}

    def known(self, text: bytes, place: tuple) -> bool:
        """Whether equal words were let through from an earlier place."""
        if len(self.first) >= REMEMBERED:
            self.first.clear()
        digest = xxhash.xxh3_128_digest(text)
        if self.first.get(digest, place) < place:
            return True
        self.first[digest] = place
        return False


def _rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(found), 20_000):
        columns = zip(*found[i : i + 20_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS, strict=True)], NAMES)


def _marks(dk: int, th: int, later: list[tuple[int, int]]) -> list[tuple]:
    """A row with marks of whole segments, if there are any."""
    marks = [{"start": s, "windows": n, "mask": None} for s, n in later]
    return [(None, None, dk, th, None, None, None, None, marks)] * bool(later)


def _segments(plain: DataFrame, repeated, heavy) -> DataFrame:
    """SEGMENTS whose anchors are repeated. key: the anchor; heavy: it is heavy; marks: of those equal to an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, often, merger = np.frombuffer(repeated.value, np.uint8), np.frombuffer(heavy.value, np.uint8), Merger()
        for batch in slices(batches):
            out: list[tuple] = []
            for dk, th, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                words = raw.split()
                first, n, anchors, at = segments(word_hashes(words))
                some = np.flatnonzero(has_bit(twice, slots(anchors, REPEATED_BITS)))
                many, keys, later = has_bit(often, slots(anchors[some], HEAVY_BITS)).tolist(), anchors.view(np.int64), []
                for k, is_heavy in zip(some.tolist(), many, strict=True):
                    start, windows = int(first[k]), int(n[k])
                    text = b" ".join(words[start : start + windows + WINDOW - 1])
                    if merger.known(text, (dk, th, start)):
                        later.append((start, windows))
                    else:
                        out.append((int(keys[k]), is_heavy, dk, th, start, windows, int(at[k]) - start, text, None))
                out += _marks(dk, th, later)
            yield from _rows(out)

    return plain.select("dk", "th", "text").mapInArrow(run, SEGMENTS)


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [window_hashes(word_hashes(raw.split(b" ")), WINDOW) for raw in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["hash"])


def parts(hashes: np.ndarray, again: np.ndarray, offset: int) -> list[tuple[int, int, int]]:
    """Runs of the windows of a segment that again marks, cut where the anchor's place changes its class.

    hashes: of the segment's words; offset: the anchor's place in the first window. Gives first window, number of
    windows and a hash of the words that all windows of this class have.
    """
    place = offset - np.arange(len(again))
    kind = np.where(again, place // SPAN, -1)
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    out = []
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(kind)], strict=True):
        if kind[s] >= 0:
            begin = offset - int(kind[s]) * SPAN - (SPAN - 1)  # the window with the anchor at the class's last place
            middle = hashes[max(0, begin + SPAN - 1) : begin + WINDOW]
            out.append((s, e - s, xxhash.xxh3_64_intdigest(middle.tobytes(), int(kind[s]))))
    return out


def _parts(found: DataFrame, repeated) -> DataFrame:
    """SEGMENTS: the parts of heavy anchors' segments that hold windows which occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, merger = np.frombuffer(repeated.value, np.uint8), Merger()
        for batch in slices(batches):
            out: list[tuple] = []
            for dk, th, start, offset, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                words = raw.split(b" ")
                hashes, later = word_hashes(words), []
                again = has_bit(twice, slots(window_hashes(hashes, WINDOW), REPEATED_BITS))
                for s, n, key in parts(hashes, again, offset):
                    text = b" ".join(words[s : s + n + WINDOW - 1])
                    if merger.known(text, (dk, th, start + s)):
                        later.append((start + s, n))
                    else:
                        out.append((key - (1 << 63), False, dk, th, start + s, n, None, text, None))
                out += _marks(dk, th, later)
            yield from _rows(out)

    return found.select("dk", "th", "start", "offset", "words").mapInArrow(run, SEGMENTS)


def repeats(texts: list[bytes], place: list[np.ndarray]) -> list[np.ndarray]:
    """For each window of each segment, whether the same words also begin earlier in these segments.

    texts: the segments, words joined by spaces. place: dk, th and start of each.
    """
    known: dict[bytes, int] = {}
    rows = [[known.setdefault(w, len(known) + 1) for w in t.split(b" ")] for t in texts]
    sizes = np.array([len(r) for r in rows])
    ends = np.cumsum(sizes + 1) - 1  # a separator, 0, follows each segment
    starts = ends - sizes
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.fromiter((w for r in rows for w in r), np.int64, int(sizes.sum()))
    index = FMIndex(text, len(known) + 1, WINDOW)
    length, rows_from, _ = matches(index, text, starts, ends)
    owner = np.repeat(np.arange(len(rows)), sizes + 1)
    offset = np.arange(len(text)) - starts[owner]
    dk, th, start = place
    at = start[owner] + offset
    order = np.lexsort((at, th[owner], dk[owner]))
    d, t, a = dk[owner][order], th[owner][order], at[order]
    rank = np.empty(len(text), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum((d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1]))])
    # the index has these texts themselves, so each place of a window is among those that find its rows
    whole = np.flatnonzero(length == WINDOW)
    earliest = np.full(index.size, len(rank))
    np.minimum.at(earliest, rows_from[whole], rank[whole])
    again = np.zeros(len(text), bool)
    again[whole] = rank[whole] > earliest[rows_from[whole]]
    return [again[s : e - WINDOW + 1] for s, e in zip(starts, ends, strict=True)]


def _shard(table: pa.Table) -> pa.Table:
    """Marks of a shard's segments that hold repeated windows. Equal segments are searched for once."""
    words = table.column("words").to_pylist()
    place = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("dk", "th", "start")])
    order = np.lexsort(place[::-1])  # the earliest of equal segments comes first
    first: dict[bytes, int] = {}
    for k in order.tolist():
        first.setdefault(words[k], k)
    heads = list(first.values())
    found = repeats(list(first), [p[heads] for p in place])
    masks: list = [None] * len(words)
    kept = np.ones(len(words), bool)
    for k, again in zip(heads, found, strict=True):
        kept[k] = again.any()
        masks[k] = np.packbits(again).tobytes()
    # a row equal in place to the first of its segment is that segment once more
    same = np.flatnonzero((place == place[:, [first[w] for w in words]]).all(0))
    for k in same.tolist():
        masks[k], kept[k] = masks[first[words[k]]], kept[first[words[k]]]
    windows = table.column("windows").to_pylist()
    rows = [k for k in range(len(words)) if kept[k]]
    marks = [[{"start": int(place[2, k]), "windows": windows[k], "mask": masks[k]}] for k in rows]
    return pa.table([pa.array(place[0, rows]), pa.array(place[1, rows]), pa.array(marks, MARK_TYPE)], names=["dk", "th", "marks"])


def _sharded(found: DataFrame, rows: int) -> DataFrame:
    """dk, th, marks of the segments in found, by indexes of shards."""
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows // SHARD_SEGMENTS)))).cast("int").alias("shard")
    return found.select(shard, "dk", "th", "start", "windows", "words").groupBy("shard").applyInArrow(_shard, f"dk long, th long, marks {MARKS}")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """dk, th, marks (start, windows, mask): the windows of each document that begin earlier too. mask: null for all.

    docs: dk, th, text. Documents are ordered by dk, then th.
    """
    context = docs.sparkSession.sparkContext
    counts = docs.select("text").mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    # the smaller bitmap's slots are the larger one's lower bits
    known = bitmaps(counts, slot_of("anchor"), REPEATED_BITS, repeated=F.col("n") > 1, heavy=F.col("n") > HEAVY)
    often = np.bitwise_or.reduce(np.frombuffer(known["heavy"], np.uint8).reshape(-1, (1 << HEAVY_BITS) // 8), 0).tobytes()
    repeated, heavy = context.broadcast(known["repeated"]), context.broadcast(often)
    found = written(_segments(docs, repeated, heavy), "segments")
    repeated.destroy(), heavy.destroy()
    rows = {r["heavy"]: r["n"] for r in found.groupBy("heavy").agg(F.count("*").alias("n")).collect()}
    tables, dealt, n = [found], found.where("heavy = false"), rows.get(False, 0)
    if rows.get(True):  # windows that occur more than once, and the parts of segments that have them
        cut = found.where("heavy")
        counts = cut.select("words").mapInArrow(_window_hashes, "hash long").groupBy("hash").agg(F.count("*").alias("n"))
        windows = context.broadcast(bitmaps(counts, slot_of("hash"), REPEATED_BITS, repeated=F.col("n") > 1)["repeated"])
        cut = written(_parts(cut, windows), "parts")
        windows.destroy()
        tables.append(cut)
        dealt = dealt.union(cut.where("words IS NOT NULL"))
        n += cut.where("words IS NOT NULL").count()
    marks = _sharded(dealt, n)
    for table in tables:
        marks = marks.union(table.where("marks IS NOT NULL").select("dk", "th", "marks"))
    out = written(marks.groupBy("dk", "th").agg(F.flatten(F.collect_list("marks")).alias("marks")), "marks")
    dropped(*tables)
    return out


def covered(n_words: int, marks: list[tuple[int, int, bytes | None]]) -> np.ndarray:
    """Which words lie in marked windows. marks: start, windows and mask of segments."""
    change = np.zeros(n_words + 1, np.int64)
    for start, windows, mask in marks:
        at = np.arange(start, start + windows)
        if mask is not None:
            at = at[np.unpackbits(np.frombuffer(mask, np.uint8), count=windows) == 1]
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change)[:-1] > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (removed runs of words, from and to) for each row of docs.

    A word is removed if a window of WINDOW words over it also begins earlier: at a smaller doc_id, or earlier in
    the same document. A null text has no words; a null doc_id counts as the least. Rows that share a doc_id
    stand in the order of their texts' hashes; rows equal in id and text are one document, and get equal results.
    """
    spark = docs.sparkSession
    plain = docs.select(
        col(id_col).cast("long").alias("doc_id"), order_id(id_col).alias("dk"), text_key(text_col).alias("th"),
        col(text_col).cast("string").alias("text"),
    )
    marks = repeated_windows(plain.select("dk", "th", "text"))
    place = F.xxhash64("dk", "th")
    marked = spark.sparkContext.broadcast(bitmaps(marks, slot_of(place), MARKED_BITS, marked=F.lit(True))["marked"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of documents without marks; the texts of the others stay."""
        bits = np.frombuffer(marked.value, np.uint8)
        for batch in slices(batches):
            places = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            stays = has_bit(bits, slots(places, MARKED_BITS))
            words = [x.split() for x in as_bytes(batch.column(3))]
            hashes = [None if s else hashlib.sha256(b" ".join(w)).hexdigest() for s, w in zip(stays, words, strict=True)]
            texts = [b" ".join(w) if s else None for s, w in zip(stays, words, strict=True)]
            arrays = [*(batch.column(k) for k in range(3)), pa.array([len(w) for w in words], pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "dk", "th", "n_words", "hash", "words"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, hashes, spans = [], [], []
            for n, known, text, marks in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if text is None:
                    removed.append(0), hashes.append(known), spans.append([])
                    continue
                gone = covered(n, [(m["start"], m["windows"], m["mask"]) for m in marks or []])
                words = text.split()
                hashes.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
                removed.append(int(gone.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"from": int(a), "to": int(b)} for a, b in edges.reshape(-1, 2)])
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            arrays = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    rows = plain.select("doc_id", "dk", "th", "text", place.alias("place")).mapInArrow(
        read, "doc_id long, dk long, th long, n_words long, hash string, words binary"
    )
    return rows.join(marks, ["dk", "th"], "left").select("doc_id", "n_words", "hash", "words", "marks").mapInArrow(
        apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<from int, to int>>"
    )


ORACLE = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS s
  FROM words, unnest(range(1, greatest(1, len(w) - {WINDOW - 2}))) AS t(i)
), marked AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS place FROM marked, range({WINDOW}) AS t(j)
), lists AS (
  SELECT doc_id, list(place) AS g FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  sha256(array_to_string([x FOR x, k IN w IF g IS NULL OR NOT list_contains(g, k)], ' ')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
"""
