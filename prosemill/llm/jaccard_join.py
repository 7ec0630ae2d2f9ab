"""N-gram Jaccard join: a size-aware heavy-light self-join on sets of word shingles, and its groups.

Two sets link when their Jaccard similarity is at least 0.8. Shingles have one order for all sets: those that
many documents share come last, others by hash. A set of n shingles that links with another shares at least
ceil(0.8 n) of them with it; so the first n - ceil(0.8 n) + l shingles of the one and of the other have at
least l in common. Small (light) sets are joined by all 2-subsets of their first shingles (l = 2), large (heavy)
ones by the inverted lists of their first shingles (l = 1); light sets that a heavy one may link with are on
these lists too. The boundary is the size up to which subsets cost less than lists, by the corpus's own list
lengths. Equal sets are one node. Candidates are checked by the sets themselves.

Only the groups are asked for, so not all links inside one are looked at: stars first (each list's members against
the first few of them, the same for all lists), then, on lists that are longer, every pair of the others that are still in
different groups. In both, sizes, places and the sets' parity sketches rule out what can't link. That loses no group: the
first signature that two sets share has their pair in one of these, unless both ends are in one group already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import (
    NULL_ID, as_bytes, bitmaps, col, columns_of, dropped, has_bit, mixed, order_id, slices, slot_of, slots, text_key, unused,
    window_hashes, word_hashes, written,
)
from prosemill.llm.components import components

SHINGLE = 5
#: Similarity 0.8 as a fraction.
NUM, DEN = 4, 5
#: Shingles counted so much over what a counter holds by chance come last.
HOT = 8
#: Bits of the filters for late shingles (with a counter for each), and of those for signatures that more than one
#: document has and for wanted documents at most. As these fill they let more through, never too little.
HOT_BITS, REPEATED_BITS, WANTED_BITS = 23, 27, 24
#: Counters in a row, and parts that the tasks' counters are added up in first.
CHUNK, FAN_IN = 1 << 16, 64
#: The stars' centres that a set is checked against in a list, and parts that the list of a late shingle is dealt in.
CENTRES, PARTS = 8, 16
#: Bits of a set's parity sketch, and of what it is folded to where lists are joined.
SKETCH, FOLDED = 2048, 512
#: What a signature costs to write and to shuffle, in comparisons of list members.
ROW_COST = 8


def shingles(raw: bytes) -> np.ndarray:
    """The set of a text in UTF-8 as sorted 64-bit hashes. Fewer words than a shingle are one together."""
    words = word_hashes(raw.lower().split())  # of bytes, lower() is for A-Z alone
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(SHINGLE, len(words))) + np.uint64(min(SHINGLE, len(words))))


def overlap(n: int) -> int:
    """Shingles that a set of n must share with any set that it links with."""
    return -(-NUM * n // DEN)


def index_overlap(n: int) -> int:
    """The same for sets that are no smaller."""
    return -(-2 * NUM * n // (NUM + DEN))


#: What an entry is: on an inverted list (else a subset), a guest in a part of it, of the index prefix, of late shingles alone.
LIST, GUEST, INDEX, LATE = 1, 2, 4, 8


def signatures(found: np.ndarray, hot: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What to join a set by, what each of these is, and its place in the order (for subsets 0)."""
    n, none = len(found), (found[:0], np.empty(0, np.int8), np.empty(0, np.int32))
    if not n:
        return none
    late = has_bit(hot, slots(found, HOT_BITS))
    order = np.argsort(late, kind="stable")
    found, late = found[order], late[order]
    probe, index = n - overlap(n) + 1, n - index_overlap(n) + 1
    sigs, kinds, places = [], [], []
    if n > boundary or n >= overlap(boundary + 1):
        sigs.append(found[:probe])
        kinds.append(LIST + LATE * late[:probe] + INDEX * (np.arange(probe) < index))
        places.append(np.arange(probe))
    if 2 <= n <= boundary:
        i, j = np.triu_indices(min(n, probe + 1), 1)
        low, high = np.minimum(found[i], found[j]), np.maximum(found[i], found[j])
        sigs.append(mixed(low * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(high)))
        kinds.append(LATE * (late[i] & late[j]) + INDEX * (j < index + 1))
        places.append(np.zeros(len(i), int))
    if not sigs:
        return none
    return np.concatenate(sigs), np.concatenate(kinds).astype(np.int8), np.concatenate(places).astype(np.int32)


def parities(found: np.ndarray) -> np.ndarray:
    """SKETCH bits, as signed 64-bit numbers: whether an odd number of the set's shingles fall into each slot.

    Two sets that differ in d shingles differ in at most d bits, and in nearly d if d is small.
    """
    odd = np.bincount((found >> np.uint64(48)).view(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def boundary_by_cost(mean_list: float) -> int:
    """The largest size whose 2-subsets cost no more than its inverted lists of mean_list entries each.

    A signature costs ROW_COST to shuffle and a comparison for each member of its list; a subset's list is its own.
    """
    n, best = 2, 0
    while True:
        k = n - overlap(n) + 2
        if k * (k - 1) / 2 * (ROW_COST + 1) <= (k - 1) * (ROW_COST + mean_list):
            best = n
        elif k > 3:  # from here on k only grows, and with it the subsets' share
            return best
        n += 1


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        col(id_col).cast("long").alias("doc_id"), order_id(id_col).alias("dk"), text_key(text_col).alias("th"),
        col(text_col).cast("string").alias("text"),
    )


def _counters(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.int64)


def _packed(counters: np.ndarray) -> bytes:
    return zstandard.compress(counters.astype(np.int64).tobytes(), 1)


COUNTERS = "chunk int, part int, counters binary"


def _counter_rows(totals: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "chunk": pa.array(list(totals), pa.int32()), "part": pa.array([part] * len(totals), pa.int32()),
        "counters": pa.array([_packed(c) for c in totals.values()], pa.binary()),
    })


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of each chunk added up; a task holds one array for each chunk, however many rows it reads."""
    totals: dict[int, np.ndarray] = {}
    for batch in slices(batches, 1):
        chunk, counters = batch.column(0)[0].as_py(), _counters(batch.column(2)[0].as_py())
        totals[chunk] = totals[chunk] + counters if chunk in totals else counters
    yield _counter_rows(totals, 0)


def late_shingles(plain: DataFrame) -> tuple[bytes, float]:
    """A bitmap of the shingles that many documents have, and the mean length of the other shingles' lists.

    plain: text; null and empty texts count nothing, equal texts count each. A task counts all its documents' shingles
    in 2**HOT_BITS counters by hash; these are added up twice, by parts and in all. A counter that exceeds what it holds by
    chance by more than HOT marks its shingles; some marks are false, which only changes the order. The mean length is
    the second moment of the counts over the first. Without texts no shingle is late and the mean is 1.
    """
    m = 1 << HOT_BITS
    size = min(CHUNK, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(m, np.int32)
        for batch in slices(batches):
            found = [shingles(raw) for raw in as_bytes(batch.column(0))]
            places = slots(np.concatenate([np.empty(0, np.uint64), *found]), HOT_BITS)
            at, n = np.unique(places.view(np.int64), return_counts=True)
            counters[at] += n.astype(np.int32)
        yield _counter_rows(dict(enumerate(counters.reshape(-1, size))), TaskContext.get().partitionId() % FAN_IN)

    rows = plain.select("text").mapInArrow(run, COUNTERS).repartition("chunk", "part").mapInArrow(_added, COUNTERS)
    rows = written(rows.repartition("chunk").mapInArrow(_added, COUNTERS), "counters")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array([float(_counters(batch.column(0)[0].as_py()).sum())])], ["a"])

    mean = (rows.select("counters").mapInArrow(sums, "a double").agg(F.sum("a")).first()[0] or 0.0) / m
    most = mean + 6 * mean**0.5 + HOT

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            counters = _counters(batch.column(1)[0].as_py())
            late, rest = counters > most, counters[counters <= most].astype(float)
            bits = np.packbits(late, bitorder="little").tobytes()
            values = [[bits], [float(len(rest))], [rest.sum()], [(rest**2).sum()]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, values)], ["chunk", "bits", "n", "a", "b"])

    out, (n, first, second) = bytearray(m // 8), (0.0, 0.0, 0.0)
    kind = "chunk int, bits binary, n double, a double, b double"
    for row in rows.select("chunk", "counters").mapInArrow(marked, kind).collect():  # m / 8 bytes in all
        out[row["chunk"] * size // 8 : (row["chunk"] + 1) * size // 8] = row["bits"]
        n, first, second = n + row["n"], first + row["a"], second + row["b"]
    dropped(rows)
    square = second - first**2 / max(n, 1.0)  # less what counters hold by chance
    return bytes(out), max(1.0, square / first) if first else 1.0


def _listed(plain: DataFrame, hot, boundary: int) -> DataFrame:
    """sig: all signatures of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(hot.value, np.uint8)
        for batch in slices(batches):
            parts = [signatures(shingles(raw), marks, boundary)[0] for raw in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64))], ["sig"])

    return plain.select("text").mapInArrow(run, "sig long")


PARITIES = [f"k{i}" for i in range(SKETCH // 64)]
TABLE = "dk long, n int, late int, doc_id long, th long, cls binary, sig long, kind byte, place int, " + ", ".join(f"{k} long" for k in PARITIES)


def _tabled(plain: DataFrame, hot, repeated) -> DataFrame:
    """A row for each document (cls: a digest of its set; its sketch) and for each of its repeated signatures.

    repeated: the bitmap and the boundary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, (packed, boundary) = np.frombuffer(hot.value, np.uint8), repeated.value
        twice = np.frombuffer(packed, np.uint8)
        names = [x.split()[0] for x in TABLE.split(", ")]
        for batch in slices(batches):
            digests, sizes, common, sketches = [], [], [], []
            found, kinds, places, owners = ([np.empty(0, t)] for t in (np.uint64, np.int8, np.int32, np.int64))
            for k, raw in enumerate(as_bytes(batch.column("text"))):
                whole = shingles(raw)
                sigs, kind, place = signatures(whole, late, boundary)
                some = np.flatnonzero(has_bit(twice, slots(sigs, REPEATED_BITS)))
                found.append(sigs[some]), kinds.append(kind[some]), places.append(place[some]), owners.append(np.full(len(some), k))
                digests.append(xxhash.xxh3_128_digest(whole.tobytes()))
                sizes.append(len(whole))
                common.append(int(has_bit(late, slots(whole, HOT_BITS)).sum()))
                sketches.append(parities(whole))
            own, sums = batch.column("dk"), [pa.array(x, pa.int32()) for x in (sizes, common)]
            ids = [batch.column("doc_id"), batch.column("th"), pa.array(digests, pa.binary())]
            none = [pa.nulls(len(digests), t) for t in (pa.int64(), pa.int8(), pa.int32())]
            yield pa.RecordBatch.from_arrays([own, *sums, *ids, *none, *map(pa.array, np.array(sketches).T)], names)
            at = pa.array(np.concatenate(owners))
            none = [pa.nulls(len(at), pa.int64())] * 2 + [pa.nulls(len(at), pa.binary())]
            sigs = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(places))]
            arrays = [own.take(at), *[x.take(at) for x in sums], *none, *sigs, *[pa.nulls(len(at), pa.int64())] * len(PARITIES)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return plain.select("doc_id", "dk", "th", "text").mapInArrow(run, TABLE)


def _verified(pairs: DataFrame, plain: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough. Sets are made for the texts of these nodes alone."""
    spark, key = plain.sparkSession, F.xxhash64("dk")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("dk"))
    bits = spark.sparkContext.broadcast(bitmaps(nodes, slot_of(key), WANTED_BITS, wanted=F.lit(True))["wanted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches):
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            some = batch.filter(pa.array(has_bit(marks, slots(keys, WANTED_BITS))))
            sets = [shingles(raw).view(np.int64) for raw in as_bytes(some.column("text"))]
            yield pa.RecordBatch.from_arrays([some.column("dk"), some.column("th"), pa.array(sets, pa.list_(pa.int64()))], ["dk", "th", "s"])

    found = plain.select("dk", "th", "text", key.alias("key")).mapInArrow(run, "dk long, th long, s array<long>")
    # one shuffle of the sets is for both ends; sets of other nodes, which a bitmap that fills lets through, find no pair
    sets = found.repartition("dk").dropDuplicates(["dk", "th"])
    x, y = sets.select(F.col("dk").alias("a"), F.col("s").alias("x")), sets.select(F.col("dk").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    linked = pairs.select("a", "b").join(y, "b").join(x, "a").where(DEN * both >= NUM * (F.size("x") + F.size("y") - both))
    out = written(linked.select("a", "b"), "links")
    bits.destroy()
    dropped(pairs)
    return out


MET = "a long, b long, sig long, dk long, n int, late int, kind byte, place int"


def may_link(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Which of the members x and y, of one list each, may be a pair whose first shared signature this is.

    The first shingle that two sets share is among the first of both, as few as these two sizes need, and all that they
    share stands from there on in both. Sets on a list of a late shingle have all their other shingles among their
    first; so if they have too few late ones to link by these alone, they share another, and meet on its list before.
    """
    less = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["dk"] < y["dk"]))
    small, large, kind = np.minimum(x["n"], y["n"]), np.maximum(x["n"], y["n"]), np.where(less, x["kind"], y["kind"])
    needed = -(-NUM * (small + large) // (NUM + DEN))
    reach = np.minimum(x["n"] - x["place"], y["n"] - y["place"])
    return (
        (x["dk"] != y["dk"]) & (DEN * small >= NUM * large) & (kind & INDEX > 0)
        & ((kind & LATE == 0) | (np.minimum(x["late"], y["late"]) >= needed)) & ((kind & LIST == 0) | (reach >= needed))
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MET of members in the order of their lists: pairs (a, b) with the first CENTRES of a list, and the others as they are.

    All members of a late shingle's list are among the others too, as such a list is dealt in parts.
    """
    names, kept = ("sig", "part", "dk", "n", "late", "kind", "place"), None
    for batch in batches:
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        rows = {k: v.astype(np.int64) for k, v in rows.items()}
        old = 0
        if kept is not None:  # the first of the list that the last batch ended in
            old = len(kept["dk"])
            rows = {k: np.concatenate([kept[k], v]) for k, v in rows.items()}
        total = len(rows["dk"])
        if not total:
            continue
        begins = np.ones(total, bool)
        begins[1:] = (rows["sig"][1:] != rows["sig"][:-1]) | (rows["part"][1:] != rows["part"][:-1])
        at = np.arange(total)
        start = np.maximum.accumulate(np.where(begins, at, 0))
        new = at >= old
        pairs = []
        for k in range(CENTRES):
            x = np.flatnonzero(new & (at - start > k))
            one, two = ({c: v[i] for c, v in rows.items()} for i in (x, start[x] + k))
            some = may_link(one, two)
            pairs.append(np.stack([np.minimum(one["dk"], two["dk"])[some], np.maximum(one["dk"], two["dk"])[some]]))
        found = np.unique(np.concatenate(pairs, 1), axis=1)
        none = [pa.nulls(found.shape[1], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.int32())]
        fields = [x.split()[0] for x in MET.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), *none], fields)
        rest = np.flatnonzero(new & (rows["kind"] & GUEST == 0) & ((at - start >= CENTRES) | (rows["kind"] & LATE > 0)))
        kinds = {"sig": pa.int64(), "dk": pa.int64(), "n": pa.int32(), "late": pa.int32(), "kind": pa.int8(), "place": pa.int32()}
        values = [pa.array(rows[k][rest], pa.int64()).cast(t) for k, t in kinds.items()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()), *values], fields)
        last = slice(start[-1], min(start[-1] + CENTRES, total))
        kept = {k: v[last] for k, v in rows.items()}


def _met(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """MET of the members of lists (sig, kind, place, dk, n, late) that are in nodes (dk, copies).

    In a list the set that most documents have comes first: others are often changed copies of it. Lists of late
    shingles, which alone may be long, are dealt in PARTS; their first set is a guest in all of them.
    """
    is_late = F.col("kind").bitwiseAND(F.lit(LATE)) > 0
    ranked = lists.join(nodes, "dk").select("sig", "dk", "n", "late", "kind", "place", (-F.col("copies")).alias("up"), F.xxhash64("dk").alias("rank"))
    part = F.when(is_late, F.pmod("rank", F.lit(PARTS)).cast("int")).otherwise(0)
    rows = ranked.withColumn("part", part)
    order = ("up", "rank", "dk", "n", "late", "kind", "place")
    first = ranked.where(is_late).groupBy("sig").agg(F.min(F.struct(*order)).alias("x")).select("sig", "x.*")
    guests = first.withColumns({"kind": F.col("kind").bitwiseOR(F.lit(GUEST)).cast("byte"), "part": F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))})
    rows = rows.unionByName(guests).repartition("sig", "part").sortWithinPartitions("sig", "part", "up", "rank", "dk")
    return rows.select("sig", "part", "dk", "n", "late", "kind", "place").mapInArrow(_meet, MET)


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the nodes' sketches don't rule out.

    Sets of n and m shingles that link differ in at most (n + m) / 9 of them, and so do their sketches.
    """
    side = lambda x: nodes.select(F.col("dk").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(k).alias(f"{k}_{x}") for k in PARITIES])
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return written(both.where((NUM + DEN) * _differ("a", "b", PARITIES) <= F.col("n_a") + F.col("n_b")).select("a", "b"), "pairs")


def _differ(x: str, y: str, names: list[str]):
    return sum((F.bit_count(F.col(f"{k}_{x}").bitwiseXOR(F.col(f"{k}_{y}"))) for k in names), F.lit(0))


def _rest(grouped: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of the members of a list that are in different groups and may link, as may_link() says.

    grouped: sig, kind, place, dk, n, late, comp. Pairs meet by signature and size: a size class reaches from one power of
    DEN / NUM to the next, and of a pair that links the larger set is in the class of the smaller or in the next one.
    The sketches are folded to FOLDED bits, which still differ by no more than the sets.
    """
    several = grouped.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    kept = PARITIES[: FOLDED // 64]
    folded = [reduce(Column.bitwiseXOR, map(F.col, PARITIES[i :: len(kept)])).alias(k) for i, k in enumerate(kept)]
    left = written(grouped.join(several, "sig", "left_semi").join(nodes.select("dk", *folded), "dk"), "rest")
    size = F.floor(F.log("n") / F.log(F.lit(DEN / NUM)))
    columns = ("dk", "n", "late", "comp", "kind", "place", *kept)
    side = lambda x, at: left.select("sig", at.alias("at"), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    has = lambda c, bit: F.col(c).bitwiseAND(F.lit(bit)) > 0
    one = side("one", F.explode(F.array(size, size + 1))).where(has("kind_one", INDEX))
    # one is the smaller set, of equal ones that with the smaller id
    smaller = F.struct("n_one", "dk_one") < F.struct("n_two", "dk_two")
    both = F.col("n_one") + F.col("n_two")
    needed = F.ceil(both * NUM / (NUM + DEN))
    reach = F.least(F.col("n_one") - F.col("place_one"), F.col("n_two") - F.col("place_two"))
    pairs = (
        one.join(side("two", size), ["sig", "at"])
        .where(smaller & (DEN * F.col("n_one") >= NUM * F.col("n_two")) & (F.col("comp_one") != F.col("comp_two")))
        .where(~has("kind_one", LATE) | (F.least("late_one", "late_two") >= needed))
        .where(~has("kind_one", LIST) | (reach >= needed))
        .where((NUM + DEN) * _differ("one", "two", kept) <= both)
        .select(F.col("dk_one").alias("a"), F.col("dk_two").alias("b"))
    )
    found = _near(pairs, nodes)
    dropped(left)
    return found


def similarity_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, th, first for each row of docs.

    Links follow from the sets of distinct shingles of SHINGLE words (lower case for A-Z). A text without words,
    or null, has an empty set and links with nothing: its component is its own id. Rows that share a doc_id are
    one node with the links of all; so are rows with a null doc_id, which counts as the least and stays null,
    also as a component_id. th is a hash of the text; first marks the row with the least (doc_id, th) of its
    component, and rows with empty sets.
    """
    context = docs.sparkSession.sparkContext
    plain = _plain(docs, id_col, text_col)
    # 1: shingles that many documents have, and how long the lists of the others are
    late, mean_list = late_shingles(plain)
    boundary, hot = boundary_by_cost(mean_list), context.broadcast(late)
    # 2: signatures that more than one document has
    counts = _listed(plain, hot, boundary).groupBy("sig").agg(F.count("*").alias("k"))
    repeated = context.broadcast((bitmaps(counts, slot_of("sig"), REPEATED_BITS, repeated=F.col("k") > 1)["repeated"], boundary))
    # 3: documents, and the members of these lists; of equal sets one is a member
    table = written(_tabled(plain, hot, repeated), "jaccard")
    hot.destroy(), repeated.destroy()
    documents = table.where("cls IS NOT NULL").select("doc_id", "dk", "th", "cls", "n", *PARITIES)
    reps = documents.groupBy("cls").agg(F.min("dk").alias("rep"), F.count("*").alias("copies"))
    documents = written(documents.join(reps, "cls").drop("cls"), "documents")
    nodes = documents.where("dk = rep").select("dk", "n", "copies", *PARITIES).distinct()
    lists = table.where("cls IS NULL").select("sig", "kind", "place", "dk", "n", "late")
    met = written(_met(lists, nodes.select("dk", "copies")), "met")
    dropped(table)
    # 4: groups. A document is linked with the one that stands for its set, in case others share its id
    links = _verified(_near(met.where("a IS NOT NULL").select("a", "b"), nodes), plain)
    own = documents.where("dk <> rep").select(F.col("dk").alias("a"), F.col("rep").alias("b"))
    groups = written(components(links.union(own)), "groups")
    comps = groups.select(F.col("node").alias("dk"), "comp")
    others = met.where("a IS NULL").select("sig", "kind", "place", "dk", "n", "late")
    grouped = others.join(comps, "dk", "left").withColumn("comp", F.coalesce("comp", "dk"))
    more = _verified(_rest(written(grouped, "grouped"), nodes), plain)
    groups = components(more.union(groups.select("node", "comp"))).select(F.col("node").alias("rep"), "comp")
    labelled = documents.select("doc_id", "dk", "th", "n", "rep").join(groups, "rep", "left")
    labelled = written(labelled.withColumn("comp", F.coalesce("comp", "rep")), "labelled")
    dropped(met)
    least = labelled.where("n > 0").groupBy("comp").agg(F.min(F.struct("dk", "th")).alias("first"))
    found = labelled.join(least, "comp", "left")
    own = F.when(F.col("n") == 0, F.col("dk")).otherwise(F.col("first.dk"))
    stands = (F.col("n") == 0) | (F.struct("dk", "th") == F.col("first"))
    return found.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(own != NULL_ID, own).alias("component_id"), "th",
        stands.alias("first"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their groups: those with the smallest doc_id.

    Rows without words, or with a null text, stay. Of rows that share the smallest id the one with the least text hash
    stays, of rows equal in id and text one. Columns of any name are kept as they are. Nothing in, nothing out.
    """
    dk, th = unused(docs, "kept_id", "kept_text")
    found = similarity_groups(docs, id_col, text_col).where("first AND n_shingles > 0")
    keep = found.select(order_id("doc_id").alias(dk), F.col("th").alias(th))
    wordy = F.coalesce(col(text_col), F.lit("")).rlike("[^ \\t-\\r]")
    rows = docs.where(wordy).withColumns({dk: order_id(id_col), th: text_key(text_col)})
    kept = rows.join(keep, [dk, th], "left_semi").dropDuplicates([dk, th])
    return kept.select(*columns_of(docs)).union(docs.where(~wordy))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (max(x.n) + max(y.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY ALL
"""
