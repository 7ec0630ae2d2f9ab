"""Fingerprints, quality rules, token counts, line dedup and sharding against brute force."""

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from prosemill.llm import fingerprints, line_dedup, quality_rules, sharding, token_counts
from prosemill.llm.common import bitmaps, has_bit
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge.rows(), edge.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], edge.SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_bitmaps_hold_all_slots(spark):
    import numpy as np

    df = spark.range(500).selectExpr("id * 131 as slot", "id")
    found = bitmaps(df, F.col("slot"), 16, sums={"all": F.col("id")}, every=F.lit(True), few=F.col("id") < 7)
    every = np.frombuffer(found["every"], np.uint8)
    assert has_bit(every, (np.arange(500) * 131 % 65536).astype(np.uint64)).all()
    assert np.unpackbits(np.frombuffer(found["few"], np.uint8)).sum() == 7 and found["all"] == 500 * 499 // 2


def test_rules_match_the_definitions(docs):
    for r in quality_rules.compression_rules(docs).collect():
        texts = [t for i, t, *_ in edge.rows() if i == r["doc_id"]]
        assert any(matches(r, t or "") for t in texts)


def matches(r, text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    own = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)
    return own == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_bands_reject_noise_and_repetition(spark):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(400))
    line = "this line stands here more than once and says nothing new"
    numbered = "\n".join(f"{line} {i}" for i in range(300))
    prose = " ".join("".join(rng.choice("aeioustnr") for _ in range(rng.randrange(2, 9))) for _ in range(500))
    df = spark.createDataFrame([(1, noise), (2, numbered), (3, prose)], "doc_id long, text string")
    found = by_id(quality_rules.compression_rules(df))
    assert not any(r["base_failed"] and k != 2 for k, r in found.items())
    assert not found[1]["kept"] and not found[2]["kept"] and found[3]["kept"]
    ratio = len(zstandard.ZstdCompressor(level=3).compress(prose.encode())) / len(prose.encode())
    assert found[3]["ratio"] == pytest.approx(ratio)
    assert [r["doc_id"] for r in quality_rules.keep_by_rules(df).collect()] == [3]


def test_tails_are_judged(spark):
    import random

    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("aeioustnrlmdhc") for _ in range(rng.randrange(2, 9))) for _ in range(2000))
    phrase = "nothing new is said by these words " * 100
    texts = [
        prose[:2048] + phrase[:1000],  # a third repeats itself
        prose[:2048] + prose[5000:6000],
        prose[:6144] + phrase[:1000],  # a seventh does
        prose[:2048] + phrase[:100],  # too short for a band of its own
        prose[:1000],
        prose[:100],
        "",
    ]
    found = by_id(quality_rules.compression_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(found[i]["n_chunks"], found[i]["low_chunks"], found[i]["high_chunks"]) for i in range(7)] == [
        (2, 1, 0), (2, 0, 0), (4, 1, 0), (1, 0, 0), (1, 0, 0), (1, 0, 0), (0, 0, 0),
    ]
    assert found[0]["ratio"] > 0.28 and not found[0]["base_failed"]  # only the tail speaks against it
    assert [found[i]["kept"] for i in range(5)] == [False, True, True, True, True]
    bands = quality_rules.Bands()
    for n in (0, 1, 127, 128, 2047, 2048, 2049, 2175, 2176, 4096, 4195, 5000):
        assert b"".join(bands.chunks(prose[:n].encode())) == prose[:n].encode()


def test_kept_rows_keep_their_columns(docs, empty):
    kept = quality_rules.keep_by_rules(docs)
    assert kept.schema == docs.schema
    n = quality_rules.compression_rules(docs).where("kept").count()
    assert kept.count() == n > 0 and quality_rules.keep_by_rules(empty).count() == 0


def test_edited_fingerprints(spark):
    rows = edge.unique()
    found = by_id(fingerprints.edited_fingerprints(spark.createDataFrame(rows, edge.SCHEMA).repartition(5)))
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)

    def form(t):
        return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())

    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        r = found[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"], r["near_next"]) == (float(form(t) == form(edited)), float(form(t) == form(following)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (form(t) == form(edited))
    names = defaultdict(set)
    for i, t in order:
        names[form(t)].add(found[i]["fingerprint"])
    assert all(len(x) == 1 for x in names.values()) and len({min(x) for x in names.values()}) == len(names)


def test_fingerprints_take_nulls_and_nothing(docs, empty):
    found = fingerprints.edited_fingerprints(docs).collect()
    assert len(found) == docs.count() and sum(r["doc_id"] is None for r in found) == 2
    assert fingerprints.edited_fingerprints(empty).count() == fingerprints.fingerprints(empty).count() == 0


def test_colliding_digests_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda form: f"{len(form) % 3:032x}")
    texts = {fingerprints.canonical(t or "") for _, t, *_ in edge.rows()}
    assert fingerprints.fingerprints(docs).select("fingerprint").distinct().count() == len(texts)


def test_histogram_answers_every_limit(spark, docs, empty):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.load_ranks(), special_tokens={})
    own = sorted(len(encoding.encode_ordinary(t or "")) for _, t, *_ in edge.rows())
    hist = token_counts.length_histogram(token_counts.encoded_lengths(docs)).cache()
    rows = {r["length"]: r for r in hist.collect()}
    assert {k: r["docs"] for k, r in rows.items()} == Counter(own)
    for limit, r in rows.items():
        assert r["truncated_tokens"] == sum(min(x, limit) for x in own) == token_counts.truncated_total(hist, limit).first()["tokens"]
        assert r["tokens_at_least"] == sum(x for x in own if x >= limit) and r["fitting_share"] == pytest.approx(sum(x <= limit for x in own) / len(own))
    assert token_counts.truncated_total(hist, 100).first()["tokens"] == sum(min(x, 100) for x in own)
    assert token_counts.quantile(hist, 0.5).first()["length"] == own[-(-len(own) // 2) - 1]
    assert token_counts.length_histogram(token_counts.encoded_lengths(empty)).count() == 0
    assert token_counts.truncated_total(hist.where("false"), 5).first()["tokens"] == 0


def lines_left(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, t, _, site, *_ in rows:
        for pos, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                sites[line].add(site or "")
                first[line] = min(first.get(line, (float("inf"),)), (i, pos))
    out = {}
    for i, t, *_ in rows:
        if t is not None:
            kept = [x for pos, x in enumerate(t.split("\n")) if not (len(sites[x]) >= min_sites and first[x] != (i, pos))]
            out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("min_sites", [2, 3])
def test_line_dedup(spark, min_sites):
    rows = edge.unique()
    df = spark.createDataFrame(rows, edge.SCHEMA)
    found = by_id(line_dedup.line_dedup(df, min_sites=min_sites))
    wanted = lines_left(rows, min_sites)
    assert {i: r["kept_text"] for i, r in found.items() if r["kept_text"] is not None} == wanted
    assert any(r["n_removed"] for r in found.values()) == (min_sites == 2) and all(r["n_removed"] >= 0 for r in found.values())
    kept = line_dedup.drop_boilerplate(df, min_sites=min_sites)
    texts = {i: t for i, t, *_ in rows}
    stays = {i for i, t in texts.items() if t is None or wanted[i] == t or WORD.search(wanted[i])}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == stays


def test_line_dedup_takes_repeated_rows_and_nothing(docs, empty):
    assert line_dedup.line_dedup(docs).count() == docs.count() and line_dedup.line_dedup(empty).count() == 0


def test_smallest_capacity_is_smallest():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 3, 50]) for _ in range(rng.randrange(1, 9))]
        k = rng.randrange(1, 5)
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(sizes)), n) for n in range(k))
        best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))) for c in cuts)
        assert sharding.smallest_capacity(sizes, k) == best


@pytest.mark.parametrize(("digits", "most"), [(1, 32), (3, 65536)])
def test_shards(spark, docs, digits, most):
    rows = edge.rows()
    got = sharding.minimax_shards(docs, shards=5, slots_by=3, first_digits=digits, most_sums=most).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    sizes, where, slots = defaultdict(int), {}, defaultdict(list)
    groups = defaultdict(int)
    for _, t, *_ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert where.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) == sharding.smallest_capacity([groups[k] for k in sorted(groups)], 5)


def test_shards_of_nothing(empty):
    assert sharding.minimax_shards(empty).count() == 0
