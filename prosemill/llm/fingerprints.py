"""Document fingerprints: a canonical exact digest.

The canonical form of a text is its NFKC form with case folded and runs of white space made one space. The
fingerprint is the 128-bit xxhash of that form in UTF-8. Within buckets of equal hashes the bytes themselves
are compared; where they differ, a part of the SHA-256 of the form joins the fingerprint and tells them apart.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import bitmaps, col, has_bit, slices, written

#: Bits of the filter that finds the documents in buckets of several (2 MB); a full one only costs time.
FILTER_BITS = 24


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def proof(form: bytes) -> str:
    return hashlib.sha256(form).hexdigest()[:32]


def slot(hexadecimal: str) -> int:
    return int(hexadecimal[:12], 16)


def _slot_column(column: str):
    return F.conv(F.substring(column, 1, 12), 16, 10).cast("long")


def _differing(docs: DataFrame, text_col: str, digests: DataFrame) -> DataFrame:
    """The digests of buckets of docs whose canonical bytes differ. digests: digest, proof.

    Only texts whose bucket holds several rows are shuffled; equal ones meet in the map-side aggregate.
    """
    counts = digests.groupBy("digest").agg(F.count("*").alias("n"), F.min("proof").alias("a"), F.max("proof").alias("b"))
    counts = written(counts.where("n > 1"), "buckets")
    marks = docs.sparkSession.sparkContext.broadcast(
        bitmaps(counts, _slot_column("digest"), FILTER_BITS, several=F.lit(True))["several"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marks.value, np.uint8)
        for batch in slices(batches):
            forms = [canonical(x or "") for x in batch.column(0).to_pylist()]
            names = [digest(x) for x in forms]
            slots = np.array([slot(x) for x in names], np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            found = np.flatnonzero(has_bit(bits, slots))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in found], pa.string()), pa.array([forms[i] for i in found], pa.binary())],
                ["digest", "form"],
            )

    forms = docs.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "digest string, form binary")
    by_bytes = forms.groupBy("digest").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b")
    return by_bytes.select("digest").union(counts.where("a <> b").select("digest")).distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint for each row of docs. A null text is empty; equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            forms = [canonical(x or "") for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([digest(x) for x in forms], pa.string()), pa.array([proof(x) for x in forms], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "proof"])

    plain = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    found = written(plain.mapInArrow(run, "doc_id long, digest string, proof string"), "digests")
    differing = _differing(plain, "text", found.select("digest", "proof")).withColumn("differs", F.lit(True))
    return found.join(differing, "digest", "left").select("doc_id", _named("digest", "proof", "differs").alias("fingerprint"))


def _named(digest_col: str, proof_col: str, differs: str):
    return F.when(F.col(differs), F.concat(F.col(digest_col), F.lit("-"), F.col(proof_col))).otherwise(F.col(digest_col))


EDITS = (
    "kind string, part long, doc_id long, n_chars long, edited_sha256 string, digest string, proof string, "
    "edited_digest string, edited_proof string, near_edited double, near_next double, text string"
)


def _compared(text: str, following: str) -> tuple:
    """The columns of EDITS from n_chars to near_next. Likeness: 1 if the canonical bytes agree, else 0."""
    k = min(len(text) // 3, len(text))
    edited = text[: len(text) - k] + following[:k]
    form, edited_form, next_form = canonical(text), canonical(edited), canonical(following)
    same = lambda other: float(digest(form) == digest(other) and form == other)
    return (
        len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(form), proof(form),
        digest(edited_form), proof(edited_form), same(edited_form), same(next_form),
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its follower in this partition; the first and the last text for the neighbours."""
    part, waiting, names = TaskContext.get().partitionId(), None, [x.split()[0] for x in EDITS.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (x.split() for x in EDITS.split(", "))])
    blank = (None,) * 8

    def block(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in slices(batches):
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if waiting is None:
                out.append(("first", part, doc_id, *blank, text or ""))
            else:
                out.append(("row", part, waiting[0], *_compared(waiting[1], text or ""), None))
            waiting = (doc_id, text or "")
        yield block(out)
    if waiting is not None:
        yield block([("last", part, waiting[0], *blank, waiting[1])])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next row's, in descending order of doc_id; after the last row comes the first. Nulls: a null text is empty,
    a null doc_id counts as smaller than any other. Rows that share a doc_id stand in the order of their texts'
    hashes. The rows are dealt into ranges of doc_id, so each text moves once; only the first and the last text
    of a range meet those of its neighbours.
    """
    spark = docs.sparkSession
    plain = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = written(dealt.mapInArrow(_walk, EDITS), "edits")
    firsts = walked.where("kind = 'first'").select("part", "text")
    # the follower of a range's last row: the first row of the next range that has rows, or of the first range
    parts = sorted(r["part"] for r in firsts.select("part").collect())  # one number for each partition
    following = spark.createDataFrame(
        [(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part long, next_part long"
    )
    ends = (
        walked.where("kind = 'last'").select("part", "doc_id", "text").join(following, "part")
        .join(firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_chars", "edited_sha256", "digest", "proof", "edited_digest", "edited_proof", "near_edited", "near_next"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]
        for batch in slices(batches):
            rows = [_compared(x, y) for x, y in zip(batch.column("text").to_pylist(), batch.column("next_text").to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    names = [x.split()[0] for x in EDITS.split(", ")][2:-1]
    closed = ends.select("doc_id", "text", "next_text").mapInArrow(close, ", ".join(EDITS.split(", ")[2:-1]))
    rows = walked.where("kind = 'row'").select(*names).union(closed.select(*names))
    both = rows.select("digest", "proof").union(rows.select("edited_digest", "edited_proof"))
    differing = written(_differing(plain, "text", both), "differing")
    own, other = differing.select("digest", F.lit(True).alias("d1")), differing.select(F.col("digest").alias("edited_digest"), F.lit(True).alias("d2"))
    return rows.join(own, "digest", "left").join(other, "edited_digest", "left").select(
        "doc_id", "n_chars", "edited_sha256", _named("digest", "proof", "d1").alias("fingerprint"),
        _named("edited_digest", "edited_proof", "d2").alias("edited_fingerprint"), "near_edited", "near_next",
    )
