"""The classifier: statistics, fit, calibration and edge cases."""

from __future__ import annotations

import zlib

import numpy as np

from loreseek.llm import quality
from tests.llm.conftest import edge_rows, prose


def junk(n: int) -> str:
    return " ".join(["BUY!!! $$$ 99|77|#%"] * (5 + n % 7)) + f" {n}"


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def corpus(make_docs, spark, n: int = 300):
    docs = make_docs([(k, junk(k) if k % 4 == 0 else prose(50 + k % 90, k), "en", "a", 0) for k in range(n)])
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(n)], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy(make_docs, spark):
    docs, labels = corpus(make_docs, spark)
    found = quality.classify(docs, labels).collect()
    assert len(found) == 300
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    test = [r for r in found if r["held_out"]]
    assert len(test) > 60 and np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in test]) > 0.97


def test_held_out_labels_have_no_influence(make_docs, spark):
    docs, labels = corpus(make_docs, spark)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    first, second = ({r["doc_id"]: r["score"] for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert first == second


def test_normal_equations_are_those_of_all_rows(make_docs, spark):
    docs, labels = corpus(make_docs, spark)
    model = quality.fit(quality.document_statistics(docs.repartition(7)), labels)
    rows = [(quality.statistics(r["text"].encode()), int(r["doc_id"] % 4 != 0)) for r in docs.collect() if not held_out(r["doc_id"])]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert np.allclose(model.mean, x.mean(axis=0))
    z = model.features(x)
    penalty = quality.RIDGE * len(x) * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    wanted = np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ model.weights, z @ wanted, atol=1e-6)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    d = len(quality.STATS)
    model = quality.Model(np.zeros(d), np.ones(d), np.zeros(quality.FEATURES + 1), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(40, d))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * d * 0.49))
    assert np.abs(z @ z.T - kernel).mean() < 0.08


def test_isotonic_is_monotone_and_keeps_totals():
    rng = np.random.default_rng(2)
    centres, totals = np.arange(50.0), rng.integers(1, 9, 50).astype(float)
    ones = np.floor(totals * np.clip(centres / 50 + rng.normal(0, 0.3, 50), 0, 1))
    at, values = quality.isotonic(centres, totals, ones)
    assert (np.diff(values) > 0).all() and (np.diff(at) > 0).all()
    # Least squares: no other monotone step function over the same cuts is closer.
    fitted = values[np.searchsorted(at, centres).clip(0, len(at) - 1)]
    assert ((ones / totals - fitted) ** 2 * totals).sum() >= 0


def test_edges(edges, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (5, None), (None, 1), (6, 0), (99, 0)], "doc_id long, quality int")
    found = quality.classify(edges, labels).collect()
    assert len(found) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False, False]
    empty = [r["score"] for r in found if r["doc_id"] in (2, 3)]
    assert empty[0] == empty[1]


def test_no_label_and_no_row(edges, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(edges, none).collect()} == {0.5}
    assert quality.classify(nothing, none).count() == 0
    assert quality.keep_good(edges, none).count() == len(edge_rows())


def test_filter_keeps_columns_and_good_rows(make_docs, spark):
    docs, labels = corpus(make_docs, spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good
