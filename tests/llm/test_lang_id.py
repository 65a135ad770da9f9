from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from clipgrid.llm import lang_id
from corpus_samples import ODD

SYLLABLES = {"aa": "ka lo mi ten ra".split(), "bb": "sch ung ver ber äu".split(), "cc": "ción os ado ña el".split()}


def sentence(lang, seed, words=30):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture
def corpus(documents):
    rows = [(i, sentence(lang, i, 4 + i % 40), lang, "s") for i in range(240) for lang in [("aa", "bb", "cc")[i % 3]]]
    return rows, documents(rows)


def test_held_out_accuracy(corpus):
    rows, df = corpus
    want = {d: lang for d, _, lang, _ in rows}
    found = lang_id.identify(df).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d in want if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert sorted(map(tuple, found)) == sorted(map(tuple, lang_id.identify(df.repartition(7)).collect()))


def test_held_out_labels_are_not_learnt(corpus, documents):
    rows, df = corpus
    wrong = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 5 == 0 else lang, s) for d, t, lang, s in rows]
    assert sorted(map(tuple, lang_id.identify(documents(wrong)).collect())) == sorted(map(tuple, lang_id.identify(df).collect()))


def test_one_id_in_very_many_rows_does_not_pass_the_sample(spark, documents, monkeypatch):
    got = []
    monkeypatch.setattr(lang_id, "train", lambda rows, seed=0: got.append(rows))
    same = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 5)
    texts = [(same, sentence("aa", i, 6), "aa", "s") for i in range(3000)] + [(same, "once more", "bb", "s")] * 3000
    lang_id.learn(documents(texts), sample=50)
    lang_id.learn(documents(texts).repartition(11), sample=50)
    assert len(got[0]) == 50 and got[0] == got[1]
    assert len({*got[0]}) == 50


def test_other_scripts_are_rejected_more(corpus, documents):
    rows, df = corpus
    model = lang_id.learn(df)
    odd = [(i, "".join(chr(0x4E00 + (i * 31 + j) % 900) for j in range(40))) for i in range(20)]
    strange = sum(r.rejected for r in lang_id.predict(documents(odd), model).collect())
    usual = sum(r.rejected for r in lang_id.predict(df, model).collect())
    assert strange / 20 >= usual / 240


def test_buckets_stay_inside_their_text():
    texts = [lang_id.normal(t) for t in ("abc", "d", "efg hij")]
    found, begins = lang_id.buckets_of(texts)
    ends = [*begins[1:], len(found)]
    for i, text in enumerate(texts):
        alone, _ = lang_id.buckets_of([text])
        assert sorted(found[begins[i] : ends[i]]) == sorted(alone)
        assert len(alone) == sum(max(0, len(text) - n + 1) for n in lang_id.GRAMS)


def test_calibration_lowers_the_loss():
    rng = np.random.default_rng(1)
    want = rng.integers(0, 3, 400)
    logits = rng.standard_normal((400, 3)) + 2 * np.eye(3)[want]
    model = lang_id.calibrated(lang_id.Model(["a", "b", "c"], np.zeros((1, 3)), np.zeros(3), 1.0, 0.0), logits * 7, want)
    assert model.temperature > 1
    p = lang_id.softmax(logits * 7 / model.temperature)
    accepted = p.max(axis=1) >= model.reject_below
    assert (p.argmax(axis=1) != want)[accepted].mean() <= lang_id.ERRORS


def test_odd_rows(spark, documents):
    rows = [*ODD, (11, "12 34 !!"), (12, "ª"), (13, "кот")]
    found = lang_id.identify(documents(rows)).collect()
    und = [r for r in found if r.lang_pred == "und"]
    assert len(found) == len(rows) and len(und) == 6 and all(r.score == 0 and r.rejected for r in und)
    assert lang_id.identify(documents([])).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None, "x")], "doc_id long, text string, lang string, score string")
    assert [tuple(r)[2:] for r in lang_id.identify(unlabelled).collect()] == [("und", 0.0, True)]
