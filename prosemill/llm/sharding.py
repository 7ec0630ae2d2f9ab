"""Sharding: minimax contiguous partition of atomic groups (rows of equal text) into a number of shards.

Groups stand in the order of their texts' SHA-256. The driver binary-searches the smallest shard capacity
for which a greedy pass over the group sizes needs no more shards than asked for, and cuts there. It never
holds all groups: it starts with sums over key prefixes and opens only those prefixes in which a cut of any
capacity still in question can fall, until these hold single groups. So the capacity is exact, while the
driver has at most a bounded number of sums. A group's shard then follows from its key and the cuts alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.common import col, text_key, written

SHARDS = 16
#: Hexadecimal digits of the first prefixes, and sums that the driver takes in one round at most.
FIRST_DIGITS, MOST_SUMS = 3, 65_536


@dataclass(frozen=True)
class Block:
    """The groups whose keys begin with prefix; least is the smallest of these keys."""

    prefix: str
    size: int
    groups: int
    least: str


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Indices of the blocks that begin the second and later shards; None if capacity doesn't do.

    ends: running totals of the block sizes, none of which exceeds capacity.
    """
    cuts: list[int] = []
    at, done = 0, 0
    while at < len(ends):
        if at:
            cuts.append(at)
            if len(cuts) >= shards:
                return None
        at = bisect_right(ends, done + capacity, at)
        done = ends[at - 1]
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which greedy() needs no more shards, by binary search."""
    ends = list(accumulate(sizes))
    low, high = max([0, *sizes, -(-(ends[-1] if ends else 0) // shards)]), ends[-1] if ends else 0
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(ends, middle, shards) is not None else (middle + 1, high)
    return low


def _open(blocks: list[Block], least: int, most: int, shards: int) -> set[int]:
    """The blocks of several groups in which a cut of some capacity from least to most can fall."""
    ends = list(accumulate(b.size for b in blocks))
    found: set[int] = set()
    low = high = 0
    for _ in range(shards - 1):
        # a greedy pass that may only cut between blocks stays behind any other, one that may cut anywhere ahead of it
        i = bisect_right(ends, low + least)
        low = ends[i - 1] if i else 0
        high = min(high + most, ends[-1])
        j = bisect_left(ends, high)
        found.update(k for k in range(i, j + 1) if k < len(blocks) and blocks[k].groups > 1)
    return found


def cuts_of(groups: DataFrame, shards: int, first_digits: int = FIRST_DIGITS, most_sums: int = MOST_SUMS) -> list[str]:
    """The keys that begin the second and later shards. groups: key (64 hexadecimal digits, unique), size; no nulls.

    Of several cuts that do, it takes those that fill each shard in turn. No groups, or no more than one shard, have none.
    """

    def sums(frame: DataFrame, digits: int) -> list[Block]:
        rows = (
            frame.groupBy(F.substring("key", 1, digits).alias("prefix"))
            .agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.min("key").alias("least"))
            .collect()
        )
        return [Block(**row.asDict()) for row in rows]

    blocks = sorted(sums(groups, first_digits), key=lambda b: b.prefix)
    total, largest = sum(b.size for b in blocks), None
    while blocks:
        most = smallest_capacity([b.size for b in blocks], shards)
        singles = max((b.size for b in blocks if b.groups == 1), default=1)
        least = max(singles, -(-total // shards))
        opened = _open(blocks, least, most, shards)
        # a block larger than the capacity that the rest needs may be one large group: look into it too
        opened |= {k for k, b in enumerate(blocks) if b.groups > 1 and b.size > least}
        if not opened:
            largest = most
            break
        by_length: dict[int, list[str]] = {}
        for k in sorted(opened, key=lambda k: -blocks[k].size)[: most_sums // 16]:
            by_length.setdefault(len(blocks[k].prefix), []).append(blocks[k].prefix)
        gone, new = set(), []
        for length, prefixes in by_length.items():
            held = max(b.groups for b in blocks if b.prefix in set(prefixes))
            more = 1
            while 16**more < held and len(prefixes) * 16 ** (more + 1) <= most_sums:
                more += 1
            wanted = F.substring("key", 1, length).isin(prefixes)
            new += sums(groups.where(wanted), min(64, length + more))
            gone.update(prefixes)
        blocks = sorted([b for b in blocks if b.prefix not in gone] + new, key=lambda b: b.prefix)
    if largest is None:
        return []
    ends = list(accumulate(b.size for b in blocks))
    return [blocks[k].least for k in greedy(ends, largest, shards) or []]


def minimax_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots_by: int = 64,
    first_digits: int = FIRST_DIGITS, most_sums: int = MOST_SUMS,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    A null text is empty and in one group with empty texts. Null ids come first in a shard's slots; repeated
    rows each get a slot of their own, which of them which is open. Fewer groups than shards leave the last
    shards empty. No text is shuffled: its length, checksum and key are taken where it is read.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = written(
        docs.select(
            col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("key"),
            text_key(text_col).alias("salt"),
        ),
        "sharding",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "sharding-groups")  # every round reads them
    cuts = cuts_of(groups, shards, first_digits, most_sums)
    shard: Column = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= F.lit(cut)).cast("int")
    part = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(slots_by)).cast("int")
    dealt = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), part.alias("part"))
    # slots: counts of the parts of a shard (shards x slots_by rows) give each part its first slot
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(before, F.lit(0)))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        dealt.withColumn("within", within)
        .join(F.broadcast(starts.select("shard", "part", "first")), ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
