"""What the operators of this subpackage share: tables, scratch tables, fixed-size filters, word rules."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents go to Python in batches of so many rows, as one text may be very long.
ROWS_PER_BATCH = 256
#: Parts in which a bitmap comes to the driver, a job for each.
FETCHES = 4
#: Stands for a null doc_id where an order is needed: nulls come first.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """The batches cut into short ones, so that a Python worker works on few texts at once; Spark bounds their bytes."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names. On one machine alone a folder of our own will do where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "prosemill-scratch")


#: Scratch folders that are still there, with their sessions.
_LEFT: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a Parquet table in the shared folder and read again: cuts the lineage, survives executors.

    What dropped() doesn't remove goes when Python ends, or by clear_scratch().
    """
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm  # PySpark has no function that deletes files
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def dropped(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more, and let Spark clean up the shuffles behind them."""
    for df in tables:
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for path in [x for x in _LEFT if x.rpartition("/")[2] in {f.rpartition("/")[2] for f in folders}]:
            _delete(_LEFT.pop(path), path)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


@atexit.register
def clear_scratch() -> None:
    """Remove all scratch tables of this process. Results that weren't written yet can't be read any more."""
    while _LEFT:
        path, spark = _LEFT.popitem()
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names for further columns, which df doesn't have."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (s + "_" * k for k in range(len(taken) + 1)) if x not in taken) for s in stems]


def order_id(column: str | Column) -> Column:
    """doc_id as a sort key without nulls."""
    return F.coalesce((col(column) if isinstance(column, str) else column).cast("long"), F.lit(NULL_ID))


def text_key(column: str) -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(col(column), F.lit("")))


def slot_of(column: str | Column) -> Column:
    """A place in a bitmap for a 64-bit hash; slots() gives the same."""
    return F.shiftrightunsigned(col(column) if isinstance(column, str) else column, 16)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(16)) & np.uint64((1 << bits) - 1)


def bitmaps(counts: DataFrame, slot: Column, bits: int, sums: dict[str, Column] | None = None, **conditions: Column) -> dict:
    """For each condition a bitmap of 2**bits bits: the slots of the rows that meet it; and sums over all rows.

    The result is at most 2**bits / 8 bytes for each condition, whatever the input; it is a filter
    that lets too much through as it fills, never too little.
    """
    at = F.pmod(slot, F.lit(1 << bits)) + 1  # Spark counts bits from 1
    rows = (
        counts.groupBy(F.bitmap_bucket_number(at).alias("bucket"))
        .agg(
            *[F.bitmap_construct_agg(F.when(c, F.bitmap_bit_position(at))).alias(k) for k, c in conditions.items()],
            *[F.sum(c).alias(k) for k, c in (sums or {}).items()],
        )
        .repartition(FETCHES)
        .toLocalIterator()
    )
    out: dict = {k: np.zeros((1 << bits) // 8, np.uint8) for k in conditions}
    totals = dict.fromkeys(sums or {}, 0)
    for row in rows:
        for k, whole in out.items():
            part = np.frombuffer(bytes(row[k]), np.uint8)
            start = (row["bucket"] - 1) * len(part)
            room = whole[start : start + len(part)]
            room |= part[: len(room)]
        for k in totals:
            totals[k] += row[k] or 0
    return {k: v.tobytes() for k, v in out.items()} | totals


def has_bit(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the bits of these slots (uint64, already below the bitmap's size) are set."""
    return (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(array) -> list[bytes]:
    """An Arrow string column as UTF-8; nulls are empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, from the words' hashes."""
    out = hashes[: len(hashes) - k + 1].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : len(hashes) - k + 1 + j]
    return mixed(out)
