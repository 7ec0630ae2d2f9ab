"""Names that clash, bounds that hold, scratch that goes, and the models against plain loops."""

import math
import os
import re
import types
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from prosemill.llm import common, jaccard_join, line_dedup, mixing, quality_gam, quality_rules, queries
from tests.llm import edge

CLASHING = (
    "line_id", "line_text", "line_gone", "kept_id", "kept_text", "mix_profile", "mix_rate", "mix_copy", "__dk", "__th", "__gone", "__profile",
    "__rate", "profile", "rate", "comp", "first", "sig", "pos", "a.b", "c0", "c1", "select",
)


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [r for r in edge.unique()]
    df = spark.createDataFrame(rows, edge.SCHEMA).select("doc_id", "text", "source")
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


def test_columns_of_any_name_are_kept(spark, clashing):
    labels = spark.createDataFrame([(i, 1 - (i % 5 == 0), int(i % 7 == 0)) for i in range(97)], "doc_id long, quality int, toxic int")
    mix = mixing.fit_mixture(clashing, mixing.labelled_domains(labels), mixing.WEIGHTS, most_rate=2.0)
    results = {
        "rules": quality_rules.keep_by_rules(clashing), "lines": line_dedup.drop_boilerplate(clashing, min_sites=2),
        "groups": jaccard_join.keep_one(clashing), "mixture": mix.apply(clashing),
    }
    for name, df in results.items():
        assert df.columns == clashing.columns, name
        rows = df.collect()
        assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHING), name


def test_operators_take_ids_and_texts_of_any_name(spark):
    rows = [(i, f"some words of a text {i} " * 20) for i in range(6)]
    df = spark.createDataFrame(rows, "`the.id` long, `the.text` string").withColumn("source", F.lit("s"))
    assert jaccard_join.keep_one(df, "the.id", "the.text").count() == 6
    assert line_dedup.drop_boilerplate(df, "the.id", "the.text").count() == 6
    assert quality_rules.compression_rules(df, "the.id", "the.text").count() == 6
    assert quality_rules.keep_by_rules(df, "the.text").columns == df.columns
    labels = spark.createDataFrame([(i, "good") for i in range(6)], "`the.id` long, domain string")
    assert mixing.fit_mixture(df, labels, {"good": 1.0, "bad": 0.1}, "the.id", "the.text").apply(df, "the.id", "the.text").count() == 6


def test_labelled_rows_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_gam, "fit_gam", lambda x, y: seen.append(len(y)))
    quality_gam.fit_quality(docs, labels, most_labels=10)
    quality_gam.fit_quality(docs.limit(0), labels, most_labels=10)
    assert seen == [10, 0]


def test_many_domains_have_profiles(spark):
    mixer = mixing.Mixer(tuple("abcdefghijkl"), {d: [f"word{d}"] for d in "abcdefghijkl"})
    row = spark.createDataFrame([("worda wordb #", ), (None,)], "text string").select(mixer.profile(F.col("text")).alias("p"))
    bins = [r["b"] for r in row.select(mixer.bins(F.col("p")).alias("b")).collect()]
    assert len(bins[0]) == len(mixer.limits) == 18 and bins[0][6:9] == [3, 3, 0] and bins[1][6:] == [0] * 12
    profiles = spark.createDataFrame([([1.0, 0.0], float(k)) for k in range(5)], "p array<double>, tokens double")
    with pytest.raises(ValueError, match="profiles"):
        mixing.fit_rates(profiles, mixing.Mixer(("a", "b"), {}), [0.5, 0.5], None, 1.0, most_profiles=4)


def test_scratch_folder_is_shared_or_refused():
    session = lambda **conf: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))
    assert common.scratch(session(**{"spark.checkpoint.dir": "hdfs:/x", "spark.master": "yarn"})) == "hdfs:/x"
    assert common.scratch(session(**{"spark.master": "local[4]"})).endswith("prosemill-scratch")
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]", "k8s://b"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.scratch(session(**{"spark.master": master}))


def test_scratch_tables_go(spark):
    path = lambda df: df.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    one, two = (common.written(spark.range(3), "probe") for _ in range(2))
    folders = path(one), path(two)
    common.dropped(one)
    assert [os.path.exists(f) for f in folders] == [False, True]
    common.clear_scratch()
    assert not os.path.exists(folders[1])


def test_session_settings_stay(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    quality_rules.keep_by_rules(spark.createDataFrame(edge.rows(), edge.SCHEMA)).count()
    assert before == {k: spark.conf.get(k) for k in before}


def verdict(text, bands):
    """The rules by their definition."""
    raw = (text or "").encode()
    press = zstandard.ZstdCompressor(level=bands.level)
    fits = lambda x: next((low <= len(press.compress(x)) / len(x) <= high for least, low, high in reversed(bands.limits) if len(x) >= least), True)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    failed = len(words) < 50 or len(covered) * 100 > 50 * len(words)
    chunks, rest = [], raw
    while rest:
        left = len(rest) - bands.chunk_bytes
        take = bands.chunk_bytes if left >= bands.limits[0][0] else len(rest)
        chunks.append(rest[:take])
        rest = rest[take:]
    bad = sum(len(c) for c in chunks if not fits(c))
    return failed, not failed and (not raw or fits(raw)) and bad <= bands.bad_share * len(raw), len(chunks), bad > 0


def test_verdicts_match_the_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    noise = "".join(chr(33 + zlib.crc32(str(i).encode()) % 90) + " " * (i % 7 == 0) for i in range(9000))
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(-1, noise), (-2, "the same words again " * 900), (-3, docs[3]["text"] * 3), (-4, None), (-5, "")]
    rows += [(-10 - k, (docs[5]["text"] + docs[6]["text"] + docs[7]["text"])[: 4000 + 61 * k]) for k in range(12)]
    found = {r["doc_id"]: r for r in quality_rules.compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bands = quality_rules.Bands()
    for i, text in rows:
        r = found[i]
        assert (r["base_failed"], r["kept"], r["n_chunks"], r["low_chunks"] + r["high_chunks"] > 0) == verdict(text, bands), i
    assert not found[-1]["kept"] and not found[-2]["kept"] and {r["kept"] for r in found.values()} == {True, False}


def test_features_match_plain_counts():
    text = "The CAT, the cat!\n\nThe CAT, the cat!\n12 | x| é# the the\n"
    got = dict(zip(quality_gam.FEATURES, quality_gam.features(text.encode(), zstandard.ZstdCompressor(level=1)), strict=True))
    n, words = len(text.encode()), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    wanted = {
        "log_bytes": math.log(1 + n), "log_words": math.log(1 + len(words)), "upper": sum(c.isupper() for c in text) / n, "symbols": 1 / n,
        "exclamations": text.count("!") / n, "digits": 2 / n, "stops": 0.0, "commas": 2 / n, "bars": 2 / n, "wide": 2 / n,
        "word_length": sum(len(w.encode()) for w in words) / len(words), "distinct_words": len(set(words)) / len(words),
        "top_word": max(Counter(words).values()) / len(words), "short_words": sum(len(w.encode()) < 4 for w in words) / len(words),
        "doubled_words": sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), "log_lines": math.log(1 + len(lines)),
        "repeated_lines": 1 - len(set(lines)) / len(lines), "capital_words": sum(w[0].isascii() and w[0].isupper() for w in words) / len(words),
        "odd_ends": sum(w[-1] in "#*$%&<>@^~_=+\\{}[]" for w in words) / len(words),
    }
    assert {k: got[k] for k in wanted} == pytest.approx(wanted) and 0 < got["ratio"] <= 1.5
    assert all(math.isfinite(x) for x in quality_gam.features(b"", zstandard.ZstdCompressor(level=1)))


def plain_tree(g, h, smooth, depth):
    """The best tree over bins by trying every cut, in plain loops."""
    value = lambda a, b: sum(a) / (sum(b) + smooth)
    worth = lambda a, b: sum(a) ** 2 / (sum(b) + smooth)
    if depth:
        gains = [worth(g[:k], h[:k]) + worth(g[k:], h[k:]) - worth(g, h) for k in range(1, len(g))]
        if gains and max(gains) > 1e-9:
            k = gains.index(max(gains)) + 1
            return plain_tree(g[:k], h[:k], smooth, depth - 1) + plain_tree(g[k:], h[k:], smooth, depth - 1)
    return [value(g, h)] * len(g)


def test_boosting_matches_plain_loops():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((120, 2)), 2)
    y = (rng.random(120) < np.where(x[:, 0] > 0.4, 0.8, 0.2) * np.where(x[:, 1] > 0.7, 0.5, 1)).astype(float)
    model = quality_gam.fit_gam(x, y, rounds=6, pair_rounds=0, most_bins=8, rate=0.3, smooth=2.0)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1]).tolist())) for j in range(2)]
    bins = [[sum(e <= v for e in edges[j]) for v in x[:, j]] for j in range(2)]
    p = (sum(y) + 0.5) / (len(y) + 1)
    tables, total = [[0.0] * (len(e) + 1) for e in edges], [math.log(p / (1 - p))] * len(y)
    for _ in range(6):
        for j, table in enumerate(tables):
            q = [1 / (1 + math.exp(-t)) for t in total]
            g, h = ([0.0] * len(table) for _ in range(2))
            for i, b in enumerate(bins[j]):
                g[b] += y[i] - q[i]
                h[b] += q[i] * (1 - q[i])
            step = [0.3 * v for v in plain_tree(g, h, 2.0, 2)]
            for k, v in enumerate(step):
                table[k] += v
            total = [t + step[b] for t, b in zip(total, bins[j], strict=True)]
    assert [t.tolist() for t in model.tables] == [pytest.approx(t, abs=1e-9) for t in tables]
    assert model.score(x) == pytest.approx([1 / (1 + math.exp(-t)) for t in total])


def test_pair_trees_match_plain_search():
    rng = np.random.default_rng(5)
    g, h = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
    worth = lambda rows, columns: g[rows, columns].sum() ** 2 / (h[rows, columns].sum() + 2.0)
    best = 0.0
    for a, b, c in product(range(1, 4), range(6), range(6)):  # a cut of rows, then one of columns on either side; 0 and 5: none
        best = max(best, sum(worth(r, s) for r, k in ((slice(0, a), b), (slice(a, 4), c)) for s in (slice(0, k), slice(k, 5))))
    for a, b, c in product(range(1, 5), range(5), range(5)):
        best = max(best, sum(worth(s, r) for r, k in ((slice(0, a), b), (slice(a, 5), c)) for s in (slice(0, k), slice(k, 4))))
    values, gain = quality_gam._pair_tree(g, h, 2.0)
    assert gain == pytest.approx(best - g.sum() ** 2 / (h.sum() + 2.0))
    assert len(np.unique(values)) <= 4


def test_posteriors_match_plain_bayes(spark, sf_dir):
    """Telling words, bins and posteriors of the whole table, worked out in plain Python."""
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    domain = {r["doc_id"]: r["domain"] for r in mixing.labelled_domains(labels).collect() if r["domain"]}
    sizes = Counter(domain[i] for i in domain if i in texts)
    largest = max(sorted(sizes), key=sizes.__getitem__)
    has = {d: Counter() for d in sizes}
    for i, d in domain.items():
        if i in texts:
            has[d].update(set(re.findall(r"[^\W\d_]{4,}", texts[i].lower())))
    told = {}
    for d in sorted(set(sizes) - {largest}):
        odds = []
        for w, n in has[d].items():
            every = sum(has[e][w] for e in sizes)
            if every >= 10 and n >= 10:
                o = math.log((n + 0.5) / (sizes[d] + 1)) - math.log((every - n + 0.5) / (sum(sizes.values()) - sizes[d] + 1))
                if o > 3:
                    odds.append((-o, w))
        if odds:
            told[d] = [w for _, w in sorted(odds)[: mixing.MOST_WORDS]]
    mix = mixing.fit_mixture(docs, mixing.labelled_domains(labels), mixing.WEIGHTS)
    assert {d: sorted(w) for d, w in mix.mixer.words.items()} == {d: sorted(w) for d, w in told.items()}

    def bins(t):
        n, parts = max(1, len(t)), t.split(" ")
        values = [
            sum(t.count(c) for c in "#*$%&") / n, t.count("!") / n, len(re.findall(r"(?:[A-ZÀ-ÖØ-Þ]){2}", t)) * 2 / n, t.count("|") / n, len(parts) / n,
            len(set(parts)) / len(parts), *[len(re.findall(r"\b(?:" + "|".join(w) + r")\b", t, re.I)) / n for w in told.values()],
        ]
        return [sum(v >= x for x in limits) for v, limits in zip(values, mix.mixer.limits.values(), strict=True)]

    names, counts = sorted(mixing.WEIGHTS), Counter()
    for i, d in domain.items():
        if i in texts:
            counts.update((d, j, b) for j, b in enumerate(bins(texts[i])))
    n = sum(sizes.values())
    for r in mix.table().collect():
        odds = []
        for d in names:
            o = math.log((sizes[d] + 1) / (n + len(names)))
            for j, b in enumerate(bins(texts[r["doc_id"]])):
                o += math.log((counts[d, j, b] + 0.5) / (sizes[d] + 0.5 * (len(list(mix.mixer.limits.values())[j]) + 1)))
            odds.append(o)
        p = np.exp(np.array(odds) - max(odds))
        assert [r[f"p_{d}"] for d in names] == pytest.approx((p / p.sum()).tolist(), abs=1e-9), r["doc_id"]


@pytest.mark.parametrize("name", ["rule_counts", "edited_texts", "shard_laws", "mixture_tokens", "op5_line_dedup"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())
