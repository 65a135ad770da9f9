from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipgrid.llm import spelling
from corpus_samples import ODD


def near(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    around = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
    found = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        found.append((w, forms[w], root, n, len(around[w]), words.get(forms[w])))
    return sorted(found)


def found(df):
    return sorted(tuple(r[c] for c in "word form root n n_near form_n".split()) for r in spelling.variants(df).collect())


def corpus(seed, letters="abÀ", words=40, rows=300):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(words)]
    for i in range(words // 2, words):  # rare words next to frequent ones
        w = stock[i - words // 2]
        k = rng.randrange(len(w))
        stock[i] = w[:k] + rng.choice(["", "a", "b", "c", w[k] * 2]) + w[k + 1 :]
    weights = [1 / (i + 1) ** 2 for i in range(words)]
    return [(i, rng.choice([" ", ", ", "-1 ", "\n"]).join(rng.choices(stock, weights, k=rng.randrange(24)))) for i in range(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, documents, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 3
    assert found(documents(rows)) == want


def test_chains_of_forms(spark, documents):
    words = {"abcdefgh": 2, "abcdefghi": 30, "abcdefghij": 400, "abcdefghiXY": 2, "zbcdefg": 2, "ybcdefg": 2}
    rows = [(7, " ".join(w for w, n in words.items() for _ in range(n)))]
    want = brute(rows)
    assert found(documents(rows)) == want
    assert ("abcdefgh", "abcdefghi", "abcdefghij", 2, 1, 30) in want


def test_odd_rows(spark, documents):
    long = "é" * 5_000
    rows = [*ODD, (8, "x" * 9_000 + " " + "x" * 9_000), (9, long + " " + long), (10, long[1:] + "!" + long[1:]), (11, "ABCdefGÀ abcdefgÀ ABCDEFGà abcdefgà")]
    rows += [(None, "nothing before nothing before"), (12, "Æ×÷ÿßÀ-seven Æ×÷ÿßÀa Æ×÷ÿßÀa " * 3)]
    assert found(documents(rows)) == brute(rows)
    assert found(documents([])) == [] and found(documents([(1, "short words only")])) == []


def test_pieces_end_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 10)
    rng = random.Random(5)
    text = "".join(rng.choice("ABc  é-") for _ in range(4000)) + "k" * 100
    whole = [w for w in re.findall("[A-Za-zÀ-ÿ]+", text) if len(w) >= 7]
    assert [w for some in spelling.runs(text) for w in some] == [w.replace("A", "a").replace("B", "b") for w in whole]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(-9, -1), st.integers(1, 9)), min_size=1, max_size=20))
def test_paths_by_their_steps(path):
    path = np.array(path)
    steps = spelling._steps(path)
    assert spelling._unfolded(steps.tolist(), path[steps].tolist(), len(path)).tolist() == path.tolist()


def test_numbers_of_nodes_over_many_partitions(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 13))) for _ in range(400)})
    shuffled = spark.createDataFrame([(w,) for w in rng.sample(words, len(words))], "word string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        paths = {r.own: r.path for r in spelling.number_nodes(shuffled.withColumn("own", shuffled.word), ["own"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    nodes = {}
    for w in words:
        assert len(paths[w]) == len(w)
        for i, x in enumerate(paths[w]):
            assert nodes.setdefault(w[: i + 1], x) == x
    assert sorted(nodes.values()) == list(range(1, len(nodes) + 1))
    own = [paths[w][-1] for w in words]
    assert own == sorted(own)


def test_a_common_word_and_clashing_columns(spark):
    rows = [(i, "government " * 50 + "governmenT goverment") for i in range(80)]
    df = spark.createDataFrame([(*r, 1, "x", 3, 4) for r in rows], "doc_id long, text string, n int, word string, w int, path int")
    assert found(df) == brute(rows)
