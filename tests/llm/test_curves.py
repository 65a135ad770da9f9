from __future__ import annotations

import numpy as np
import pytest

from clipgrid.llm import curves

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, nearest=5, every=50):
    """Per query: the ids and scores of its nearest, over usable vectors of its length."""
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    found = {}
    for q, v in kept:
        if q % every == 0:
            best = {}
            for i, w in kept:
                if i != q and len(w) == len(v):
                    best[i] = max(best.get(i, -2.0), float(curves.cosine(v, w)))
            found[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:nearest]
    return found


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    found = {}
    for r in sorted(curves.nearest_neighbours(df, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def vectors(n, width=64, seed=6):
    return [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(seed).standard_normal((n, width)))]


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("dims", [1, 2, 3])
def test_hilbert_visits_neighbouring_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = curves.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_recall(spark):
    rows = vectors(3000)
    want, found = brute(rows), search(spark, rows, least=24, share=0.015)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, own in found.items():
        scores = {i: float(curves.cosine(np.float32(rows[q][1]).astype(float), np.float32(rows[i][1]).astype(float))) for i, _ in own}
        assert dict(own) == scores


def test_wide_windows_are_exact(spark):
    rows = vectors(300)
    assert search(spark, rows, least=400) == brute(rows)


def test_copies_and_odd_vectors(spark):
    rows = vectors(120, 8)
    rows += [(1000 + i, rows[3][1]) for i in range(300)]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [float("nan")] + [1.0] * 7), (2200, [float("inf")] + [1.0] * 7), (2250, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (50, rows[50][1]), (7, [1.0] * 8)]
    assert search(spark, rows, least=4000) == brute(rows)


def test_few_or_no_candidates(spark):
    assert search(spark, []) == {}
    assert search(spark, [(50, [1.0, 0.0])]) == {}
    assert search(spark, [(50, [1.0, 0.0]), (2, [1.0, 1.0])]) == brute([(50, [1.0, 0.0]), (2, [1.0, 1.0])])
    clash = spark.createDataFrame([(50, [1.0], "a", 1), (3, [2.0], "b", 2)], "vec_id long, embedding array<float>, v string, cid int")
    assert [(r.vec_id, r.score) for r in curves.nearest_neighbours(clash).collect()] == [(3, 1.0)]


def test_small_blocks_find_what_windows_hold(spark):
    rows = vectors(600)
    assert search(spark, rows, least=700, most=16) == brute(rows)


def test_blocks_stay_small(spark, monkeypatch):
    """No block is larger than ``most``, though the window is."""
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors(400, 8)], SCHEMA)
    sizes, real = [], curves._nearest_in_block
    v = np.random.default_rng(1).standard_normal((8, 4))
    near = lambda *x: sizes.append(len(x[4])) or real(*x)
    monkeypatch.setattr(curves, "_nearest_in_block", near)
    import pyarrow as pa

    cells = [[7] * 8, [False] * 5 + [True] * 3, range(8), range(8), [9] * 8, v.tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in cells], ["task", "asks", "cid", "rank", "window", "v"])
    found = list(curves._nearest_by_task(iter([batch.slice(0, 3), batch.slice(3, 4), batch.slice(7)]), 2))
    assert sizes == [5, 5] and sum(len(q) for q, *_ in found) == 6
    assert curves.nearest_neighbours(df, least=300, most=32).count() == 40


def test_ties_of_scaled_copies_go_to_the_smaller_id(spark):
    rows = [(50, [1.0] * 8)] + [(i, [float(2 ** (i % 60))] * 8) for i in range(51, 111) if i != 100]
    assert search(spark, rows, least=400) == brute(rows)
    assert [i for i, _ in search(spark, rows, least=400)[50]] == [51, 52, 53, 54, 55]


def test_repeated_rows_do_not_hide_other_copies(spark):
    v = vectors(3)
    rows = [*v, *[(50, v[1][1])] * 30, *[(51 + i, v[1][1]) for i in range(8)]]
    assert search(spark, rows) == brute(rows)
