"""Substring dedup, the Jaccard join and components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from prosemill.llm import common, fm_index, jaccard_join, substring_dedup
from prosemill.llm.components import components
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 300)
    text[[50, 120, 299]] = 0
    index = fm_index.FMIndex(text, 4, 20)
    count = lambda p: sum(tuple(text[i : i + len(p)]) == tuple(p) for i in range(len(text) - len(p) + 1))
    for _ in range(40):
        at = rng.integers(0, 290)
        p = text[at : at + rng.integers(1, 10)]
        low, high = np.array([0]), np.array([index.size])
        for c in p[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        assert high[0] - low[0] == count(p)
    pattern = np.array([1, 2, -1, 3, 1, 1, 2, 3, 2, 1, 2, 2])
    length, low, high = fm_index.matches(index, pattern, np.array([0, 3]), np.array([3, 12]))
    for a, b in ((0, 3), (3, 12)):
        for i in range(a, b):
            m = 0
            while i + m < b and m < 20 and pattern[i + m] >= 0 and count(pattern[i : i + m + 1]):
                m += 1
            assert length[i] == m and (m == 0 or high[i] - low[i] == count(pattern[i : i + m]))


def test_bits_are_found_both_ways():
    rng = np.random.default_rng(1)
    bits = rng.random(1000) < 0.02
    bits[[0, 999]] = True
    vector, ones, at = fm_index.BitVector(bits), np.flatnonzero(bits), np.arange(1000)
    assert (vector.rank(at) == np.searchsorted(ones, at)).all()
    assert (vector.previous(at) == ones[np.searchsorted(ones, at, side="right") - 1]).all()
    assert (vector.following(at) == ones[np.searchsorted(ones, at)]).all()


def removed(rows):
    first, spots = {}, []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(t or "")
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in first:
                gone.update(range(k, k + 20))
            first.setdefault(window, (i, k))
        spots.append((i, words, gone))
    return {i: (len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for i, w, g in spots}


@pytest.mark.parametrize(("heavy", "segments", "remembered"), [(2000, 50_000, 100_000), (1, 7, 3), (3, 40, 100_000)])
def test_substring_dedup(spark, monkeypatch, heavy, segments, remembered):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", segments)
    monkeypatch.setattr(substring_dedup, "REMEMBERED", remembered)
    rows = edge.unique()
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, edge.SCHEMA).repartition(3)).collect()
    wanted = removed(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == wanted
    assert all(r["n_removed"] == sum(s["to"] - s["from"] for s in r["spans"]) for r in found) and sum(r["n_removed"] for r in found) > 500


def test_equal_windows_meet_in_one_part():
    """Whatever stands around them; and windows of a part share the words of its key."""
    rng = np.random.default_rng(4)
    shared = rng.integers(1, 1 << 60, 26).astype(np.uint64)
    keys = []
    for _ in range(6):
        words = np.concatenate([rng.integers(1, 1 << 60, 25).astype(np.uint64), shared, rng.integers(1, 1 << 60, 25).astype(np.uint64)])
        of = {}
        for start, n, _, at in zip(*substring_dedup.segments(words), strict=True):
            inside = words[start : start + n + 19]
            for s, m, key in substring_dedup.parts(inside, np.ones(n, bool), at - start):
                assert m <= substring_dedup.SPAN
                of |= {start + s + k: key for k in range(m)}
        assert sorted(of) == list(range(len(words) - 19))
        keys.append([of[25 + k] for k in range(7)])
    assert all(k == keys[0] for k in keys)


def test_the_index_decides(spark, monkeypatch):
    """Documents with different words around a short passage have no equal segments: only the index finds what they share."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(21)]
    rows = [(i, " ".join([f"a{i}.{k}" for k in range(rng.randrange(5, 30))] + passage + [f"b{i}.{k}" for k in range(9)])) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    find = lambda: {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()}
    wanted = {i: n for i, (_, n, _) in removed(rows).items()}
    assert find() == wanted and sum(wanted.values()) == 8 * 21
    monkeypatch.setattr(substring_dedup, "HEAVY", 1)
    assert find() == wanted
    # without the index nothing is left to find it
    words = [t.split() for _, t in rows]
    found = [substring_dedup.segments(common.word_hashes([w.encode() for w in x])) for x in words]
    texts, place = [], []
    for i, (x, (first, n, _, _)) in enumerate(zip(words, found, strict=True)):
        for s, m in zip(first.tolist(), n.tolist(), strict=True):
            texts.append(" ".join(x[s : s + m + 19]).encode())
            place.append((i, 0, s))
    assert len(set(texts)) == len(texts)
    columns = [np.array(c) for c in zip(*place, strict=True)]
    assert sum(a.sum() for a in substring_dedup.repeats(texts, columns)) == 8 * 2
    monkeypatch.setattr(substring_dedup, "matches", lambda index, text, *_: (np.zeros(len(text), int),) * 3)
    assert sum(a.sum() for a in substring_dedup.repeats(texts, columns)) == 0


def test_substring_dedup_takes_nulls_and_nothing(spark):
    docs = spark.createDataFrame(edge.rows(), edge.SCHEMA)
    found = substring_dedup.substring_dedup(docs)
    assert found.count() == docs.count() and found.where("doc_id is null and n_words > 0").count() == 2
    assert substring_dedup.substring_dedup(spark.createDataFrame([], edge.SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(1000, 1000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    wanted = {x: root(x) for a, b in edges for x in (a, b) if a != b}
    found = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(rows):
    out = {}
    for i, t, *_ in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    return out


def groups_of(sets):
    ids = sorted(sets)
    links = defaultdict(set)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                links[a].add(b), links[b].add(a)
    out = {}
    for a in ids:
        if a not in out:
            queue = [a]
            while queue:
                x = queue.pop()
                if x not in out:
                    out[x] = a
                    queue += links[x]
    return out


def corpus(seed, n=140):
    """Families of near copies of several sizes, sharing passages, some with frequent words only."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    passage = [rng.choice(words) for _ in range(25)]
    rows, families = [], [[rng.choice(words) for _ in range(rng.choice([4, 6, 9, 30, 80, 150]))] for _ in range(n // 7)]
    for i in range(n):
        text = list(rng.choice(families))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.4:
            text += passage
        rows.append((i * 3 % 1009, " ".join(text)))
    return rows


def test_boundary_follows_the_lists():
    """It has no limit of its own: the longer the lists are, the larger the sets whose subsets are cheaper."""
    found = [jaccard_join.boundary_by_cost(x) for x in (1.0, 6.0, 100.0, 5000.0)]
    assert found == sorted(found) and found[0] >= 2 and found[-1] > 1000
    for n, mean in zip(found, (1.0, 6.0, 100.0, 5000.0), strict=True):
        k = n - jaccard_join.overlap(n) + 2
        assert k / 2 * (jaccard_join.ROW_COST + 1) <= jaccard_join.ROW_COST + mean


@pytest.mark.parametrize(("seed", "hot", "light"), [(1, 32, 64), (2, 2, 64), (3, 4, 0), (4, 1, 20)])
def test_groups(spark, monkeypatch, seed, hot, light):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "boundary_by_cost", lambda _: light)
    rows = corpus(seed)
    found = jaccard_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    sets = sets_of(rows)
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == groups_of(sets)


def test_groups_of_odd_documents(spark):
    rows = edge.unique()
    df = spark.createDataFrame(rows, edge.SCHEMA)
    sets = sets_of(rows)
    found = {r["doc_id"]: r for r in jaccard_join.similarity_groups(df).collect()}
    wanted = groups_of(sets)
    assert {i: r["component_id"] for i, r in found.items()} == wanted
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in sets.items() if not s or wanted[i] == i}


def test_groups_take_nulls_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame(edge.rows(), edge.SCHEMA)
    assert jaccard_join.similarity_groups(docs).count() == docs.count()
    twice = [r for r in jaccard_join.keep_one(docs).collect() if r["doc_id"] == edge.rows()[10][0]]
    assert len(twice) <= 1
    empty = spark.createDataFrame([], edge.SCHEMA)
    assert jaccard_join.similarity_groups(empty).count() == jaccard_join.keep_one(empty).count() == 0


def test_every_link_shares_a_signature():
    """The lemma of the prefixes, on random sets of all sizes around the boundary."""
    rng = np.random.default_rng(7)
    hot = np.zeros(1 << (jaccard_join.HOT_BITS - 3), np.uint8)
    universe = common.mixed(np.arange(1, 400, dtype=np.uint64))
    for h in universe[::3]:
        s = int(common.slots(np.array([h]), jaccard_join.HOT_BITS)[0])
        hot[s >> 3] |= 1 << (s & 7)
    for _ in range(400):
        n = int(rng.integers(2, 70))
        a = np.unique(rng.choice(universe, n, replace=False))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.choice(universe, int(rng.integers(0, 1 + n // 8)))]))
        both = len(np.intersect1d(a, b))
        if len(b) < 2 or 5 * both < 4 * (len(a) + len(b) - both):
            continue
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        for boundary in (0, 20, 64):
            s1, k1, p1 = jaccard_join.signatures(small, hot, boundary)
            s2, _, p2 = jaccard_join.signatures(large, hot, boundary)
            at = {int(x): p for x, p in zip(s2, p2, strict=True)}
            need = -(-4 * (len(a) + len(b)) // 9)
            late = [int(common.has_bit(hot, common.slots(x, jaccard_join.HOT_BITS)).sum()) for x in (a, b)]
            assert any(
                k & jaccard_join.INDEX and int(s) in at and (not k & jaccard_join.LATE or min(late) >= need)
                and (not k & jaccard_join.LIST or min(len(small) - p, len(large) - at[int(s)]) >= need)
                for s, k, p in zip(s1.tolist(), k1.tolist(), p1.tolist(), strict=True)
            )
        assert 9 * np.bitwise_count((jaccard_join.parities(a) ^ jaccard_join.parities(b)).view(np.uint64)).sum() <= len(a) + len(b)
