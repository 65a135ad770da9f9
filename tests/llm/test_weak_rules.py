from __future__ import annotations

import re
from collections import Counter

import pytest

from clipgrid.llm import weak_rules
from corpus_samples import ODD, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    again = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_counts_against_brute_force(documents):
    texts = [prose(i, 20 + 9 * i) for i in range(20)]
    texts += ["a b c a b c a b", "x " * 70, "l1\nl1\n \nl2\nl1", "a|b <c> #é x y", "a\x0bb\x1cc\x0c", "b a b a b a b c d e b a b"]
    texts += [texts[3] + "\n" + texts[3], None, "", "\n\n"]
    found = {r.doc_id: tuple(r)[1:7] for r in weak_rules.verdicts(documents(list(enumerate(texts)))).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_estimate_separates_good_from_bad(documents):
    good = [(i, prose(i, 200).replace(" ", ". ", 6)) for i in range(60)]
    bad = [(100 + i, " | ".join(prose(i, 120).split()) + " !!" * 90) for i in range(15)]
    judged = {r.doc_id: r for r in weak_rules.verdicts(documents(good + bad)).collect()}
    assert all(judged[i].kept for i, _ in good) and not any(judged[i].kept for i, _ in bad)
    assert all(0 <= r.quality <= 1 for r in judged.values())


def test_accuracies_are_learnt(documents):
    """A rule that disagrees with the others gets less weight than one that agrees."""
    rows = [(i, prose(i, 200).replace(" ", ". ", 6)) for i in range(60)] + [(100 + i, "# " * 200 + prose(i, 60)) for i in range(20)]
    _, weights = weak_rules.estimate(weak_rules.votes(weak_rules.counts(documents(rows))))
    assert weights["symbols"] > 0 and weights["repeats"] > 0


def test_odd_rows(spark, documents):
    found = weak_rules.verdicts(documents(ODD)).collect()
    assert len(found) == len(ODD) and sum(r.n_words == 0 for r in found) == 4
    assert weak_rules.verdicts(documents([])).count() == 0
    clash = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, n_words string")
    assert weak_rules.judge(clash, ["doc_id"]).first().n_words == 2


def test_runs_no_python(documents):
    plan = weak_rules.counts(documents([(1, "a")]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("iterations", [1, 3])
def test_sql_has_one_step_per_iteration(iterations):
    assert weak_rules.verdicts_sql(iterations).count("AS MATERIALIZED (SELECT ln(") == iterations
