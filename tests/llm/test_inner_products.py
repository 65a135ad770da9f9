from __future__ import annotations

import math

import numpy as np
import pytest

from clipgrid.llm import inner_products

SCHEMA = "vec_id long, embedding array<double>, label int"
LONG = (1 << 63) - 1


def brute(rows, nearest=10, every=100):
    kept = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    found = []
    for q, v in kept:
        if q % every == 0:
            scores = [(max(-LONG, min(LONG, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in kept if len(w) == len(v) and (i, w) != (q, v)]
            best = sorted(scores, key=lambda x: (-x[0], x[1]))[:nearest]
            found += [(q, k, i, s) for k, (s, i) in enumerate(best, 1)]
    return sorted(found)


def search(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], schema).repartition(3)
    return sorted(map(tuple, inner_products.top_products(df, **options).collect()))


def vectors(n, width=16, seed=3, spread=0.6):
    rng = np.random.default_rng(seed)
    scaled = rng.standard_normal((n, width)) * np.exp(rng.standard_normal((n, 1)) * spread) * np.linspace(1, 0.1, width)
    return [(i, [float(x) for x in v]) for i, v in enumerate(scaled)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SEGMENT", 40), ("QUERIES", 7), ("SLICE", 16)):
        monkeypatch.setattr(inner_products, name, value)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_against_brute_force(spark, small, spread):
    rows = vectors(600, spread=spread)
    assert search(spark, rows, every=20) == brute(rows, every=20)


def test_contract_sizes(spark):
    rows = vectors(3000, width=64)
    assert search(spark, rows) == brute(rows)


def test_odd_vectors(spark, small):
    rows = vectors(120, seed=4)
    rows += [(200, None), (300, [None] * 16), (400, [float("nan")] * 16), (500, [float("inf")] * 16), (None, [1.0] * 16)]
    rows += [(600, []), (601, []), (700, [0.0] * 16), (800, [-0.0] * 16), (900, [1.0]), (901, [2.0]), (902, [-2.0])]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(1000, rows[5][1])] * 30  # copies, repeated rows
    rows += [(1100, rows[6][1]), (1100, rows[7][1]), (3, rows[8][1])]  # one id with several vectors
    assert search(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_id(spark, small):
    rows = [(i, [1.0, (i % 7) / 1024]) for i in range(500, 0, -1)] + [(1000, [1.0, 0.0])]
    assert search(spark, rows) == brute(rows)


def test_numbers_beyond_doubles(spark, small):
    rows = [(i, [1e6 + i / 1000, -3e6, 2e6 + i]) for i in range(150)] + [(1000 + i, [x * 1e150 for x in (1.0, i, -1.0)]) for i in range(5)]
    rows += [(2000 + i, [1e12, 1e12 + i, 7.0]) for i in range(20)]
    want = brute([r for r in rows if max(map(abs, r[1])) * 1024 < 2.0**500])
    assert search(spark, rows) == want


def test_the_longest_vectors_spare_the_rest(spark, small, monkeypatch):
    looked = []
    inner = inner_products._Block._scores
    monkeypatch.setattr(inner_products._Block, "_scores", lambda self, live, v, i, j: looked.append(len(i)) or inner(self, live, v, i, j))
    rng = np.random.default_rng(1)
    v = rng.standard_normal((640, 16)) * np.exp(rng.standard_normal((640, 1)))
    v = v[np.argsort(-np.sqrt((v * v).sum(axis=1)))]
    block = inner_products._Block(np.arange(7), v[:7].copy(), np.full(7, -np.inf), None, 11)
    block.meet(np.arange(640), np.arange(640), v)
    assert sum(looked) < 0.5 * 7 * 640


def test_few_rows_and_clashing_columns(spark):
    rows = vectors(5)
    assert search(spark, rows) == brute(rows) and search(spark, []) == []
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<double>, cid int, norm double, rank int")
    assert sorted(map(tuple, inner_products.top_products(df).collect())) == brute(rows)
