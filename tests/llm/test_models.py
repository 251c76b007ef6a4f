"""Language ID, quality classifier, SimHash and the pipeline."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import quality_model as QM
from quern.llm.components import connected_components
from quern.llm.language_id import UNKNOWN, fit_language_model, has_letter, language_filter, predict_languages
from quern.llm.quality_model import fit_quality_model, quality_scores
from quern.llm.simhash import flips, gather, links, near_duplicates, plan

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return fit_language_model(docs)


def test_language_accuracy(docs, model):
    rows = predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.02 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(edge, texts, clashing, empty, repeated, model):
    got = {r["doc_id"]: r for r in predict_languages(edge, model).collect()}
    for i, t in texts.items():
        assert (got[i]["lang_pred"] == UNKNOWN) == (not any(ch.isalpha() for ch in t))
    assert got[1]["rejected"] and got[17]["rejected"]
    assert predict_languages(empty, model).count() == 0 and predict_languages(repeated, model).count() == 2 * len(texts)
    kept = language_filter(clashing, model)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["rejected"]}
    assert fit_language_model(empty) is None and predict_languages(edge, None).filter(F.col("lang_pred") != UNKNOWN).count() == 0


def test_language_sample_is_the_same_in_any_order(spark):
    """A bound that binds, ids that repeat with other texts, and null ids."""
    rows = [(i % 90 or None, f"wort satz {i} und" if i % 2 else f"word {i} sentence and", "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = fit_language_model(docs, most_per_label=20)
    two = fit_language_model(docs.repartition(7, "text").orderBy(F.desc("text")), most_per_label=20)
    assert one.labels == two.labels and np.array_equal(one.table, two.table) and (one.temperature, one.limit) == (two.temperature, two.limit)


def test_letters():
    assert has_letter("1é") and not has_letter("12 ²½ _!") and not has_letter(None)


def test_quality_accuracy(spark, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    net = fit_quality_model(docs, labels)
    rows = quality_scores(docs, net).join(labels, "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.97


def test_quality_sample_is_the_same_in_any_order(spark):
    """A bound that binds, repeated label rows, and an id that holds most rows."""
    rows = [(i, f"text {i} " * (1 + i % 5), i % 2) for i in range(200)] + [(1, f"other {i}", 1) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    one = fit_quality_model(docs, labels, most_per_label=5)
    two = fit_quality_model(docs.repartition(7, "text").orderBy(F.desc("text")), labels.repartition(5).orderBy(F.desc("doc_id")), most_per_label=5)
    three = fit_quality_model(docs, labels.distinct(), most_per_label=5)
    for k, x in one.p.items():
        assert np.array_equal(x, two.p[k]) and np.array_equal(x, three.p[k])


def test_quality_edge_cases(spark, edge, texts, clashing, empty, repeated):
    labels = edge.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    net = fit_quality_model(edge, labels, most_per_label=20)
    got = {r["doc_id"]: r["score"] for r in quality_scores(edge, net).collect()}
    assert set(got) == set(texts) and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
    assert {r["doc_id"]: r["score"] for r in quality_scores(clashing, net).collect()} == pytest.approx(got)
    assert quality_scores(empty, net).count() == 0 and quality_scores(repeated, net).count() == 2 * len(texts)
    assert fit_quality_model(edge, labels.limit(0)).scores(np.zeros(0, np.uint8), np.array([0, 0])).shape == (1,)


def test_chunks_cover_and_overlap():
    edge = np.array([0, 1, 40, 41])
    first, last, row = QM.chunk_bounds(edge)
    for r in range(3):
        spans = [(a, b) for a, b, x in zip(first, last, row) if x == r]
        assert spans[0][0] == edge[r] and spans[-1][1] == edge[r + 1]
        assert all(b - c == 1 for (_, b), (c, _) in zip(spans, spans[1:]))


def test_gradients_by_differences():
    net = QM.ByteNetwork(1)
    net.p = {k: v.astype(np.float64).astype(np.float32) for k, v in net.p.items()}
    texts = [np.frombuffer(b"hello world, this is text! " * 60, np.uint8), np.frombuffer(b"***%%% ", np.uint8)]
    y, w = np.array([1, 0], np.float32), np.ones(2, np.float32)
    data, offsets = np.concatenate(texts), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])

    def loss():
        p = net.scores(data, offsets)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.gradients(texts, y, w)
    for name, at in (("v", (3,)), ("v", (30,)), ("c", (0,)), ("w", (5, 2)), ("b", (1,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def simhash(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, most=4):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def test_near_duplicates(edge, texts, clashing, empty, repeated):
    prints = {i: simhash(t) for i, t in texts.items()}
    want = components(prints)
    for df in (edge, clashing, repeated):
        rows = near_duplicates(df).collect()
        assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints and all(len(r["fingerprint"]) == 16 for r in rows)
        assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert near_duplicates(repeated).count() == 2 * len(texts) and near_duplicates(empty).count() == 0


@pytest.mark.parametrize("total", [100, 10**6, 10**9])
def test_search_loses_no_link(spark, total):
    """Whatever plan the estimates give, pairs at distance 4 and less are all found."""
    rng = np.random.default_rng(total)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for x, k in zip(base, rng.integers(1, 6, 150))]
    all_ = np.unique(np.array([int(x) for x in base] + near, np.uint64))
    scheme = plan(all_, total, 4)
    assert sum(t + 1 for t in scheme.thresholds) == 5 and sorted(b for p in scheme.parts for b in p) == list(range(64))
    want = {(a, b) for a in all_.tolist() for b in all_.tolist() if a < b and (a ^ b).bit_count() <= 4}
    for a, b in want:
        assert any(
            t >= 0 and (int(gather(np.array([a], np.uint64), p)[0]) ^ int(gather(np.array([b], np.uint64), p)[0])).bit_count() <= t for p, t in zip(scheme.parts, scheme.thresholds)
        )
    df = spark.createDataFrame([(int(x),) for x in all_.view(np.int64)], "fp long")
    got = {frozenset(np.array(tuple(r), np.int64).view(np.uint64).tolist()) for r in links(df, 4).collect()}
    assert got == {frozenset(x) for x in want}


def test_flips():
    assert len(flips(10, 2)) == 1 + 10 + 45 and len(set(flips(10, 2).tolist())) == 56


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, docs, model):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "token_output"]
    kept = {r["doc_id"] for r in language_filter(docs, model).select("doc_id").collect()}
    near = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs.filter(F.col("doc_id").isin(list(kept)))).collect()}
    one = {i for i, c in near.items() if i == c}
    from quern.llm.decontaminate import contaminated

    bad = {r["doc_id"] for r in contaminated(docs, spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    rows = P.run(spark, D).collect()
    ids = {i for r in rows for i in r["doc_ids"]}
    assert ids <= one - bad and len(ids) > 0.5 * len(one - bad)
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_stages_on_odd_tables(spark, edge, clashing, repeated, empty, texts):
    """Null, empty and long texts, repeated rows, clashing columns and no rows, through every stage but the last."""
    import corpus_pipeline as P

    for name, stage in P.STAGES[:4]:
        one = stage(spark, edge, D)
        assert one.columns == edge.columns
        kept = sorted(r["doc_id"] for r in one.collect())
        wide = stage(spark, clashing, D)
        assert wide.columns == clashing.columns and sorted(r["doc_id"] for r in wide.collect()) == kept
        twice = sorted(r["doc_id"] for r in stage(spark, repeated, D).collect())
        # The language model is fitted anew on the repeated rows; rows that share an id still stay or go together.
        assert name == "mix" or (all(twice.count(i) == 2 for i in twice) if name == "language_id" else twice == sorted(2 * kept))
        assert stage(spark, empty, D).count() == 0
        assert set(kept) <= set(texts) and len(set(kept)) > 10


def test_null_ids_and_columns(spark):
    import corpus_pipeline as P

    rows = [(None, "some words of text here", None, None), (None, None, None, None), (1, "some other words of a text", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert P.near_dedup(spark, df, D).count() == 3 and P.decontaminate(spark, df, D).count() == 3
    assert {r["doc_id"] for r in P.mix(spark, df, D).collect()} <= {1}
