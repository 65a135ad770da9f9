from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from clipgrid.llm import simhash
from clipgrid.llm.components import components
from corpus_samples import ODD, prose


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_documents_against_brute_force(documents):
    rng = random.Random(2)
    texts = [prose(i, rng.randrange(1, 120)) for i in range(40)]
    for i in range(60):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice("ABC")
        texts.append(" ".join(words))
    texts += ["", None, " \t", "one", "one two", "ONE two", "Éa éa"]
    prints = [brute_print(t) for t in texts]
    groups = brute_groups(prints)
    found = {r.doc_id: r for r in simhash.near_duplicates(documents(list(enumerate(texts)))).collect()}
    assert [found[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [found[i].component_id for i in range(len(texts))] == groups


@pytest.mark.parametrize("block", [4, 2048])
def test_links_keep_every_connection(spark, block):
    """Dense clusters and random prints, with hot keys in many blocks."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    prints = set(base)
    for b in base[:3]:
        for _ in range(60):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long").repartition(3)
    found = {r.node: r.root for r in components(simhash.links(df, block)).collect()}
    roots = [found.get(s, s) for (s,) in signed]
    groups = brute_groups(prints)
    assert len({*zip(roots, groups)}) == len({*roots}) == len({*groups})


def test_forest_connects_what_links_connect():
    a = np.array([5, 1, 9, 9, 2], np.uint64)
    b = np.array([1, 9, 5, 1, 3], np.uint64)
    x, y = simhash.forest(a, b)
    assert len(x) == 3 and {*x.tolist(), *y.tolist()} == {1, 2, 3, 5, 9}


def test_odd_rows_and_representatives(documents):
    df = documents(ODD)
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(ODD)
    kept = simhash.representatives(df).collect()
    assert sorted((r.doc_id, r.text) for r in kept)[0] == (1, None)  # with all texts without words
    assert len(kept) == len({simhash.fingerprint((t or "").encode()) for _, t in ODD}) and all(r.doc_id for r in kept)
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    assert simhash.near_duplicates(documents([])).count() == simhash.representatives(documents([])).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(900, 900), (901, 902)], "a long, b long"))
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 901: 901, 902: 901}
