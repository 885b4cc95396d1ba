"""Top-k search against all products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, query string"


def brute(rows, k, scale=256):
    top = (1 << 63) - 1
    usable = [
        (i, n, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, n, v in usable:
        if i is None or i % 50:
            continue
        scores = [
            (-max(-top, min(top, sum(a * b for a, b in zip(v, w, strict=True)))), j is None, j)
            for j, m, w in usable if m != n and len(w) == len(v)
        ]
        ranked = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(i, r, j, -s) for r, (s, _, j) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def found(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    result = topk.search(df, F.col("vec_id") % 50 == 0, k=k)
    return sorted((tuple(r) for r in result.collect()), key=repr)


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    return [
        (i, [float(x) for x in (centres[i % 8] + 0.1 * rng.standard_normal(dim)) * spread ** rng.integers(0, 6)])
        for i in range(n)
    ]


@pytest.mark.parametrize(("seed", "dim", "spread"), [(1, 16, 1.0), (2, 16, 3.0), (3, 2, 1.5)])
def test_search(spark, monkeypatch, seed, dim, spread):
    monkeypatch.setattr(topk, "_BUCKET", 64)
    monkeypatch.setattr(topk, "_BLOCK", 8)
    monkeypatch.setattr(topk, "_SEEDS", 100)
    rows = vectors(seed, 1200, dim, spread)
    assert found(spark, rows) == brute(rows, 5)


def test_awkward_rows(spark):
    rng = random.Random(4)
    plain = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    odd = [
        *plain, plain[50], plain[50], (50, [0.5, 0.5, 0.5, 0.5]), (None, plain[0][1]), (None, [0.1] * 4),
        *((i, [0.25, -0.25, 0.25, 0.75]) for i in range(100, 240)),
        (300, None), (350, []), (351, []), (400, [0.0] * 4), (401, [0.0, -0.0, 0.0, 0.0]),
        (450, [1.0, None, 1.0, 1.0]), (500, [math.nan] * 4), (550, [math.inf, 0.0, 0.0, 0.0]),
        (600, [1.0]), (650, [1.0, 2.0]), (651, [2.0, 1.0]),
        (700, [3e7, -3e7, 1e8, 1.0]), (701, [3e7 + 1, 1e8, 5.0, 2.0]), (750, [1e12] * 4), (751, [-1e12] * 4),
    ]
    assert found(spark, odd) == brute(odd, 5)
    assert found(spark, odd, k=1) == brute(odd, 1)
    assert found(spark, []) == []


def test_nothing_ruled_out_is_a_match():
    rng = np.random.default_rng(7)
    unit = rng.standard_normal((3000, 3))
    unit[:20] = np.repeat(np.eye(3), 7, 0)[:20]
    norms = rng.uniform(1, 2, 3000)
    unit *= (norms / np.linalg.norm(unit, axis=1))[:, None]
    bucket = topk.Bucket(unit, norms)
    for query in unit[:100]:
        norm = np.linalg.norm(query)
        for cosine in (0.7, 0.9, 0.99, 1.0):
            kept = bucket.by_coordinates(query, norm, cosine)
            true = np.flatnonzero(bucket.vectors @ query >= cosine * norm * bucket.norms * (1 + 1e-12))
            assert set(true) <= set(kept)
            least = cosine * norm * 1.5
            assert set(np.flatnonzero(bucket.vectors @ query >= least)) <= set(range(bucket.by_length(least, norm)))
