"""Top-k against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreseek.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows: list[tuple], k: int, every: int) -> list[tuple]:
    usable = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in dict((i, v) for i, v in usable).items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in usable if i != q and len(c) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k=10, every=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "dims", "length", "bucket", "part", "score", "rank", "d", "b", "class")})
    found = topk.top_k(df.repartition(3), k, every, **options)
    assert sorted(map(tuple, found.collect())) == brute(rows, k, every)


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) * np.exp(rng.normal(size=(n, 1)) * spread)
    return [(k, x) for k, x in enumerate(v.tolist())]


@pytest.mark.parametrize(("bucket", "block"), [(4096, 1024), (16, 7), (3, 2)])
@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_all_buckets_and_blocks(spark, bucket, block, spread):
    check(spark, vectors(200, 8, 1, spread), bucket=bucket, block=block)


def test_ties_go_to_the_smaller_id(spark):
    check(spark, [(k, [1.0, float(k % 2)]) for k in range(60)], bucket=8)


def test_same_vector_many_times(spark):
    check(spark, [(k, [0.5, 0.5]) for k in range(300)] + [(1000 + k, x) for k, x in vectors(50, 2, 3)], bucket=16, every=100)


def test_steep_thresholds_use_coordinates(spark):
    rng = np.random.default_rng(5)
    centre = np.zeros(16)
    centre[3] = 1.0
    rows = [(k, (centre * 2 + rng.normal(size=16) * 0.05).tolist()) for k in range(60)] + [(100 + k, x) for k, x in vectors(200, 16, 6, 0.2)]
    check(spark, rows, bucket=16)


def test_coordinates_lose_nothing():
    rng = np.random.default_rng(8)
    for _ in range(50):
        q, c = rng.normal(size=6), rng.normal(size=(300, 6)) * np.exp(rng.normal(size=(300, 1)))
        unit, length = q / np.linalg.norm(q), np.linalg.norm(c, axis=1)
        need = np.quantile(c @ unit, 0.95)
        kept = set(topk._by_coordinates(unit, c, length, need).tolist())
        assert set(np.flatnonzero(c @ unit >= need).tolist()) <= kept


def test_nulls_and_odd_vectors(spark):
    rows = vectors(40, 4, 9)
    rows += [(100, None), (105, []), (110, [1.0, None, 0.0, 0.0]), (115, [float("nan"), 0.0, 0.0, 0.0]), (120, [float("inf")] * 4), (None, [1.0, 0.0, 0.0, 0.0])]
    rows += [(125, [1.0, 2.0]), (126, [2.0, 1.0]), (130, [0.0] * 4), (135, [-1e-9] * 4), (140, [1e6, -1e6, 3.25, 0.0]), (141, [1e6, 1e6, 1.0, 1.0])]
    rows += [(150, [0.1, 0.2, 0.3, 0.4]), (151, [0.1, 0.2, 0.3, 0.4]), (151, [0.1, 0.2, 0.3, 0.4])]
    check(spark, rows, bucket=8, block=4)


def test_fewer_candidates_than_k(spark):
    check(spark, vectors(4, 3, 2), every=1)


def test_large_values_are_exact(spark):
    rows = [(k, [float(10**6 + k), float(k * 977 % 1000), -(10.0**6)]) for k in range(30)]
    check(spark, rows, bucket=4)


def test_same_as_sql(spark, same_in_duckdb):
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in vectors(300, 6, 4)] + [(400, None), (500, [None] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same_in_duckdb(topk.top_k(df), topk.TOPK_SQL, embeddings=df)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
