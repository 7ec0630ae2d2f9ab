"""The quality model, the mixture, the sampled segmentations, the pipeline and the registry."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosemill.llm import mixing, piece_sampling, quality_gam
from tests.llm import edge


def test_gam_learns_additive_and_pairwise_effects():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 4))
    odds = 3 * (x[:, 0] > 0.5) - 2 * (x[:, 1] < 0.2) + 4 * ((x[:, 2] > 0.5) ^ (x[:, 3] > 0.5)) - 2.5
    y = (rng.random(6000) < 1 / (1 + np.exp(-odds))).astype(float)
    model = quality_gam.fit_gam(x[:4000], y[:4000])
    p = model.score(x[4000:])
    assert (2, 3) in model.pairs
    assert np.mean((p > 0.5) == y[4000:]) > np.mean((odds[4000:] > 0) == y[4000:]) - 0.03
    total = model.intercept + sum(t[b] for t, b in zip(model.tables, model.bins(x[:1])[0], strict=True))
    b = model.bins(x[:1])[0]
    total += sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_gam_without_both_classes():
    for y in (np.empty(0), np.ones(5)):
        model = quality_gam.fit_gam(np.zeros((len(y), 2)), y)
        assert len(set(model.score(np.random.rand(4, 2)).tolist())) == 1


def test_held_out_rows(spark):
    got = {r[0]: r[1] for r in spark.range(50).select("id", quality_gam.held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_quality_on_held_out_documents(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.fit_quality(docs, labels)
    rows = quality_gam.score_quality(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = (rows[rows.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.98 and (rows.predicted == rows.quality).mean() > 0.97


def test_quality_takes_odd_documents(spark):
    docs = spark.createDataFrame(edge.rows(), edge.SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(97)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_gam.score_quality(docs, quality_gam.fit_quality(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    none = docs.where("false")
    assert quality_gam.score_quality(none, quality_gam.fit_quality(none, labels.where("false"))).count() == 0


def reference_rates(p, tokens, share, most_rate, total):
    """The same steps in plain Python."""
    mass = (p * tokens[:, None]).sum(0)
    rate = np.minimum(1.0, np.full(len(p), most_rate))
    for _ in range(mixing.STEPS):
        step = ((p * (rate * tokens)[:, None]).sum(0) - total * np.array(share)) / mass
        if np.abs(step).max() < mixing.CLOSE:
            break
        rate = np.clip(rate - p @ step, 0, most_rate)
    return rate


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.2, 0.2, 0.2], 200)
    tokens = rng.integers(1, 500, 200).astype(float)
    frame = spark.createDataFrame([(x.tolist(), float(t)) for x, t in zip(p, tokens, strict=True)], "p array<double>, tokens double")
    share = [0.2, 0.5, 0.3]
    total = 0.4 * tokens.sum()  # well within reach, so that the least squares are zero
    mixer = mixing.fit_rates(frame, mixing.Mixer(("a", "b", "c"), {}), share, total, 1.0)
    got = np.array([r[0] for r in frame.select(mixer.rate(F.col("p"))).collect()])
    wanted = reference_rates(p, tokens, share, 1.0, total)
    assert got == pytest.approx(wanted, abs=1e-9) and got.min() >= 0 and got.max() <= 1
    assert ((p * (got * tokens)[:, None]).sum(0) / total) == pytest.approx(share, abs=0.02)


def test_mixture_of_the_tables(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    mix = mixing.fit_mixture(docs, mixing.labelled_domains(labels), mixing.WEIGHTS)
    rows = mix.table().toPandas()
    assert len(rows) == docs.count() and rows[["p_good", "p_poor", "p_toxic"]].sum(axis=1).to_numpy() == pytest.approx(1)
    taken = rows.rate * rows.n_tokens
    for d, w in mixing.WEIGHTS.items():
        assert (rows[f"p_{d}"] * taken).sum() / taken.sum() == pytest.approx(w, abs=0.02)
    kept = mix.apply(docs)
    assert kept.columns == docs.columns and kept.count() == rows.copies.sum()
    good = rows.merge(labels.where("quality = 1 and toxic = 0").toPandas(), on="doc_id")
    assert good.copies.mean() > 0.95


def test_scarce_domains_leave_the_kept_one_whole(spark):
    for toxic in (0.0, 1e-9, 5.0):  # tokens of a thousand; 25 are wanted
        rows = [([1.0, 0.0, 0.0], 950.0), ([0.0, 1.0, 0.0], 45.0), ([0.0, 0.0, 1.0], toxic)]
        frame = spark.createDataFrame(rows, "p array<double>, tokens double")
        mixer = mixing.fit_rates(frame, mixing.Mixer(("good", "poor", "toxic"), {}), [0.96, 0.015, 0.025], None, 1.0)
        good, poor, last = (r[0] for r in frame.select(mixer.rate(F.col("p"))).collect())
        assert good == pytest.approx(1, abs=1e-9) and last == pytest.approx(1, abs=1e-9)
        assert poor * 45 == pytest.approx(0.015 * 950 / 0.96, rel=0.01)


def test_steps_go_on_until_the_least_squares_are_met(spark):
    p = np.array([[0.98, 0.012, 0.008], [0.6, 0.3, 0.1], [0.5, 0.2, 0.3], [0.4, 0.35, 0.25], [0.3, 0.35, 0.35]])
    tokens, share = np.array([900.0, 300.0, 300.0, 200.0, 200.0]), [0.96, 0.025, 0.015]
    frame = spark.createDataFrame([(x.tolist(), float(t)) for x, t in zip(p, tokens, strict=True)], "p array<double>, tokens double")
    mixer = mixing.Mixer(("good", "poor", "toxic"), {})

    def fitted(total):
        found = mixing.fit_rates(frame, mixer, share, total, 1.0)
        rate = {tuple(r[0]): r[1] for r in frame.select("p", found.rate(F.col("p"))).collect()}
        return found, np.array([rate[tuple(x)] for x in p.tolist()])

    for total in (700.0, None):  # within reach; out of reach, as every text is partly unwanted
        found, rate = fitted(total)
        mass = tokens @ p
        all_of = total or mass[0] / 0.96
        got, targets = (rate * tokens) @ p, np.minimum(all_of * np.array(share), mass)
        assert found.residuals == pytest.approx(got / (all_of * np.array(share)) - 1, abs=1e-9)
        pull = p @ ((got - targets) / mass)  # at the least squares, only bounds hold rates back
        assert np.abs(np.clip(rate - pull, 0, 1) - rate).max() < 1e-8
    _, rate = fitted(700.0)
    assert (rate * tokens) @ p / 700 == pytest.approx(share, rel=1e-6)


def test_mixture_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(i, f"word number {i % 7} of the text " * 9) for i in range(60)], "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(i, 1, 0) for i in range(20)], [(i, 0, 0) for i in range(20)], [(i, 0, 1) for i in range(20)]):
        labels = mixing.labelled_domains(spark.createDataFrame(rows, schema))
        mix = mixing.fit_mixture(docs, labels, mixing.WEIGHTS)
        assert {r["rate"] for r in mix.table().collect()} == {1.0} and mix.apply(docs).count() == 60


def test_mixture_takes_odd_documents(spark):
    docs = spark.createDataFrame(edge.rows(), edge.SCHEMA)
    labels = spark.createDataFrame([(i, 1 - (i % 5 == 0), int(i % 7 == 0)) for i in range(97)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    mix = mixing.fit_mixture(docs, mixing.labelled_domains(labels), mixing.WEIGHTS, most_rate=3.0)
    assert mix.table().count() == docs.count() and mix.apply(docs).columns == docs.columns
    for d, l in ((docs.where("false"), labels), (docs, labels.where("false")), (docs.where("false"), labels.where("false"))):
        assert mixing.fit_mixture(d, mixing.labelled_domains(l), mixing.WEIGHTS).table().count() == d.count()


def test_no_python_in_native_operators(spark, sf_dir):
    from prosemill.llm import sharding

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for df in (sharding.minimax_shards(docs), mixing.fit_mixture(docs, mixing.labelled_domains(labels), mixing.WEIGHTS).table()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.load_pieces()


def segmentations(pieces, text):
    if not text:
        return [((), 0.0)]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in pieces.ids:
            i = pieces.ids[text[:n]]
            out += [((i, *rest), pieces.weights[i] + w) for rest, w in segmentations(pieces, text[n:])]
    if text[0] not in pieces.ids:
        ids = tuple(pieces.byte_ids[b] for b in text[0].encode())
        out += [(ids + rest, pieces.weights[ids[0]] * len(ids) + w) for rest, w in segmentations(pieces, text[1:])]
    return out


@pytest.mark.parametrize("steps", [64, 1])
def test_samples_follow_the_lattice(pieces, monkeypatch, steps):
    monkeypatch.setattr(piece_sampling, "STEPS", steps)
    text = "hat the\n▁x"
    every = segmentations(pieces, " " + text)
    total = np.logaddexp.reduce([w for _, w in every])
    p = {s: float(np.exp(w - total)) for s, w in every}
    lattices = piece_sampling.Lattices(pieces)
    n = 8000
    seeds = piece_sampling.mixed(np.arange(n, dtype=np.uint64) + np.uint64(steps))
    found = [[(tuple(ids.tolist()), *rest) for ids, *rest in rows] for rows in piece_sampling.sample(lattices, [text] * n, seeds, 3)]
    assert all(len({r[0] for r in rows}) == 3 and rows[0][2] >= rows[1][2] >= rows[2][2] for rows in found)
    assert all(r[1] == pytest.approx(np.log(p[r[0]]), abs=1e-6) for rows in found[:200] for r in rows)
    first, second = Counter(rows[0][0] for rows in found), Counter(rows[1][0] for rows in found)
    for s in sorted(p, key=p.get)[-4:]:
        assert first[s] / n == pytest.approx(p[s], abs=0.02)
        assert second[s] / n == pytest.approx(sum(q * p[s] / (1 - q) for o, q in p.items() if o != s), abs=0.02)
    # the inverse of the inclusion probability is a fair weight
    assert np.mean([sum(np.exp(r[1] - r[3]) for r in rows) for rows in found]) == pytest.approx(1, abs=0.02)
    assert np.mean([sum(len(r[0]) * np.exp(r[1] - r[3]) for r in rows) for rows in found]) == pytest.approx(sum(len(s) * q for s, q in p.items()), rel=0.02)


def test_all_segmentations_of_a_short_text_are_found(pieces):
    every = {s for s, _ in segmentations(pieces, " hat")}
    rows = piece_sampling.sample(piece_sampling.Lattices(pieces), ["hat"], np.array([5], np.uint64), 1000)[0]
    assert {tuple(r[0].tolist()) for r in rows} == every and rows[-1][3] == 0.0


def test_samples_of_odd_documents(spark):
    docs = spark.createDataFrame(edge.rows(), edge.SCHEMA)
    rows = piece_sampling.sample_encodings(docs, samples=3).collect()
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert Counter(r["sample"] for r in rows)[1] == docs.count()
    again = piece_sampling.sample_encodings(docs.repartition(5), samples=3, with_ids=False).collect()
    assert Counter((r["doc_id"], r["sample"], r["ids_sha256"]) for r in rows) == Counter((r["doc_id"], r["sample"], r["ids_sha256"]) for r in again)
    assert piece_sampling.sample_encodings(docs.where("false")).count() == 0


def test_ids_are_decoded(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["The  cat\nsat ", "", None, "é😀 ▁x", " a b" * 50])], "doc_id long, text string")
    rows = piece_sampling.decode_encodings(piece_sampling.sample_encodings(docs, samples=2)).collect()
    wanted = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) > 5 and all(r["decoded"] == wanted[r["doc_id"]] for r in rows)
    none = piece_sampling.sample_encodings(docs, samples=1, with_ids=False)
    assert {r["decoded"] for r in piece_sampling.decode_encodings(none).collect()} == {None}
    assert piece_sampling.decode_encodings(none.where("false")).count() == 0


def test_a_worker_needs_little_memory(pieces):
    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, x)) for x in rng.choice(np.array([*b"abcdefghijklmnopqrstuvwxyz", 32, 32, 32, 32]), (60, 50_000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts), pa.array(range(60))], ["doc_id", "text", "seed"])
    tracemalloc.start()
    got = [r for b in piece_sampling.encoded(iter([batch]), pieces, 2, False) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 120 and all(r["round_trip"] for r in got)
    assert peak < 120e6


def test_groups_of_texts():
    sizes = np.array([3, 0, 4, 9, 1, 1, 0, 20, 20, 0])
    assert list(piece_sampling.groups(sizes, 7)) == [(0, 3), (3, 4), (4, 7), (7, 8), (8, 9), (9, 10)]
    assert list(piece_sampling.groups(np.empty(0, np.int64), 7)) == []


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    names = [f.__module__ for _, f in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.written(after, name)
        assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.where("sample = 1").count() == before and last.where("not round_trip").count() == 0
    run = corpus_pipeline.run(spark, sf_dir)
    key = ("doc_id", "sample", "ids_sha256")
    assert {tuple(r[k] for k in key) for r in run.collect()} == {tuple(r[k] for k in key) for r in last.collect()}


def test_pipeline_takes_odd_documents(spark, sf_dir):
    import corpus_pipeline

    for docs in (spark.createDataFrame(edge.rows(), edge.SCHEMA), spark.createDataFrame([], edge.SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)


def test_registry():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
