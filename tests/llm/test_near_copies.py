from __future__ import annotations

import random

import corpus_pipeline
import pytest
from clipgrid.llm import near_copies
from corpus_samples import ODD, prose
from test_simhash import brute_groups, brute_print


def brute(texts):
    """Group numbers (the first member) by all pairs of five-word shingle sets."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def varied():
    rng = random.Random(4)
    texts = [prose(i, rng.randrange(20, 200)) for i in range(30)]
    for _ in range(120):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = rng.choice("ABC")
        texts.append(" ".join(words))
    return texts + ["one two", "ONE  two", "", None, " \t"]


@pytest.mark.parametrize("block", [4, 2048])
def test_groups_against_brute_force(documents, block):
    texts = varied()
    found = {r.doc_id: r.root for r in near_copies.grouped(documents(list(enumerate(texts))), block).collect()}
    roots, want = [found[i] for i in range(len(texts))], brute(texts)
    assert len({*zip(roots, want)}) == len({*roots}) == len({*want}) < len(texts)


def test_the_stage_drops_what_differs_in_a_few_words(spark, documents):
    words = prose(1, 200).split()
    rows = [(1, " ".join(words)), (2, " ".join(w if i not in (20, 90, 150) else "changed" for i, w in enumerate(words))), (3, prose(2, 200))]
    assert 0.8 <= 181 / 211 and sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, documents(rows), "").collect()) == [1, 3]


def test_odd_rows(documents):
    assert near_copies.grouped(documents(ODD)).count() == len(ODD)
    assert near_copies.grouped(documents([])).count() == 0


def test_one_row_of_equal_ids_and_texts_stays(spark):
    text = prose(3, 60)
    rows = [(i, text, "web", x) for i in (None, 4, 4, 4, 9) for x in ("b", "a")] + [(None, "other", "web", "a")] * 2
    runs = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, _tag string").repartition(3)
        runs.append(sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=str))
    assert runs[0] == runs[1] and [r[:2] for r in runs[0]] == [(4, text), (None, "other")]


def test_simhash_groups_hold_whatever_the_shingle_sets_say(spark, documents):
    often = "river stone cloud light morning garden window " * 60
    rows = [(1, often + "one two three four five"), (2, prose(8, 90)), (3, often + "six seven eight nine ten"), (4, prose(9, 90))]
    texts = [t for _, t in rows]
    assert len(set(brute(texts))) == 4 and brute_groups([brute_print(t) for t in texts]) == [0, 1, 0, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, documents(rows), "").collect()) == [1, 2, 4]


def test_simhash_links_and_shingle_links_make_one_group(documents):
    often = "river stone cloud light morning garden window " * 60
    first, second = often + "one two three four five " + prose(5, 8), often + "six seven eight nine ten " + prose(6, 8)
    copy = " ".join([*second.split()[:-1], "changed"])
    texts = [first, prose(8, 90), second, copy]
    assert len({r.root for r in near_copies.simhash_and_copies(documents(list(enumerate(texts)))).collect()}) == 2
