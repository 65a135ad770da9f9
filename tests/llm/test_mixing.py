from __future__ import annotations

import re
from collections import defaultdict

import pytest

from clipgrid.llm import mixing
from corpus_samples import ODD, prose


def brute_targets(sizes, weights, total, epochs):
    """Targets by sharing out and clamping round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > epochs * sizes[s]}
        if not over:
            return level | {s: epochs * sizes[s] for s in full}
        full |= over


def test_targets_and_takes(documents):
    rows, n = [], 0
    for source, count in (("a", 300), ("b", 20), ("c", 90), ("d", 10), ("é", 60), (None, 40)):
        for i in range(count):
            rows.append((n, prose(n, 1 + (i * 37) % 150), "en", source))
            n += 1
    sizes = defaultdict(int)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _, _ in rows}
    for d, _, _, s in rows:
        sizes[s] += size[d]
    want = brute_targets(sizes, mixing.WEIGHTS, 1.5 * sum(sizes.values()), 2)
    df = documents(rows)
    found = {r.doc_id: r for r in mixing.mix(df).collect()}
    taken = defaultdict(int)
    for d, _, _, s in rows:
        r = found[d]
        assert (r["size"], r.source_size) == (size[d], sizes[s]) and r.target == pytest.approx(want[s], rel=1e-12)
        assert r.taken == r.times * r["size"] <= 2 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 150
    assert {d: r.taken for d, r in found.items()} == {r.doc_id: r.taken for r in mixing.mix(df.repartition(5)).collect()}


def test_many_strata_stay_near(documents, monkeypatch):
    monkeypatch.setattr(mixing, "STRATUM", 16)
    rows = [(i, prose(i, 1 + i % 40), "en", "ab"[i % 5 == 0]) for i in range(900)]
    found = mixing.mix(documents(rows), weights=(3.0, 1.0), share=0.7).collect()
    for target in {r.target for r in found}:
        assert sum(r.taken for r in found if r.target == target) == pytest.approx(target, rel=0.05)


def test_share_beyond_all_clamps(documents):
    found = mixing.mix(documents([(1, "a b", "en", "x"), (2, "c", "en", "y")]), share=9.0).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == [(1, 4), (2, 2)]


def test_odd_rows(spark, documents):
    found = mixing.mix(documents(ODD)).collect()
    assert len(found) == len(ODD) and all(r.taken <= 2 * r["size"] for r in found)
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None), (2, "")])).collect()] == [0, 0]
    clash = spark.createDataFrame([(1, "a b", "s", 7.0, "r")], "doc_id long, text string, source string, target double, rank string")
    assert mixing.mix(clash, keep=("rank",)).first()["rank"] == "r"


def test_word_count(spark):
    texts = ["", None, " a  b\n", "x", "a\x0bb\x1cc", " ", " \t", "é ü\r\nß"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in df.select(mixing.word_count(df.text)).collect()]
    assert found == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
