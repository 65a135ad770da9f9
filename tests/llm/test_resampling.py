from __future__ import annotations

import math

import numpy as np
import pytest
import xxhash

from clipgrid.llm import resampling
from corpus_samples import ODD, prose

LABELS = "doc_id long, quality int, toxic int"


def brute_buckets(text):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh32_intdigest(w) for w in words]
    m = 0xFFFFFFFF
    both = h + [((a * 0x9E3779B1) & m) ^ ((b + 0x7F4A7C15) & m) for a, b in zip(h, h[1:])]
    both = [((x ^ x >> 16) * 0x85EBCA6B) & m for x in both]
    return [(x ^ x >> 13) % resampling.BUCKETS for x in both]


def brute(rows, targets, share, reference=None):
    """Weight, key and whether kept, by plain loops."""
    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for doc, text in rows:
        for b in brute_buckets(text):
            raw[b] += 1
            target[b] += doc in targets
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    found = {}
    for doc, text in rows:
        own = brute_buckets(text)
        weight = sum(ratio[b] for b in own) / len(own) * min(len(own), reference or len(own)) if own else None
        noise = xxhash.xxh64_intdigest(b"%d:" % doc + (text or "").encode(), resampling.SEED) >> 1
        u = ((noise >> 10) + 0.5) / 2.0**53
        found[doc] = (weight, None if weight is None else weight - math.log(-math.log(u)))
    some = sorted((d for d in found if found[d][0] is not None), key=lambda d: -found[d][1])
    kept = set(some[: int(len(some) * share + 0.5)])
    return {d: (*x, d in kept) for d, x in found.items()}


@pytest.mark.parametrize("share, reference", [(0.3, None), (0.8, None), (0.8, 64)])
def test_against_brute_force(spark, documents, share, reference):
    rows = [(i, prose(i, 5 + 3 * i)) for i in range(40)] + [(40 + i, "## " * 30 + prose(i, 9)) for i in range(12)] + [(60, ""), (61, None)]
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(i, 0, 0) for i in (4, 41, 42)] + [(4, 1, 1), (999, 1, 0), (None, 1, 0)]
    want = brute(rows, set(range(0, 40, 2)) - {4}, share, reference)
    found = resampling.resample(documents(rows), spark.createDataFrame(labels, LABELS), share, reference=reference).collect()
    assert len(found) == len(rows) and sorted(r["rank"] for r in found) == list(range(1, len(rows) + 1))
    for r in found:
        weight, key, kept = want[r.doc_id]
        assert r.kept == kept and (r.log_weight is None) == (weight is None)
        if weight is not None:
            assert r.log_weight == pytest.approx(weight, abs=1e-9) and r.key == pytest.approx(key, abs=1e-9)


def test_prefers_the_target(spark, documents):
    rows = [(i, prose(i, 60)) for i in range(80)] + [(100 + i, "## " * 40 + prose(i, 20)) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS)
    kept = {r.doc_id for r in resampling.resample(documents(rows), labels).where("kept").collect()}
    assert kept == set(range(80))


def test_targets_are_bounded_and_stable(spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], LABELS)
    few = resampling.target_ids(labels, 10)
    assert len(few) == 10 and all(i % 3 for i in few) and few == resampling.target_ids(labels.repartition(4), 10)


def test_odd_rows(spark, documents):
    none = spark.createDataFrame([], LABELS)
    found = resampling.resample(documents(ODD), none).collect()
    assert len(found) == len(ODD) and all((r.log_weight or 0.0) == 0.0 for r in found)
    assert sum(r.log_weight is None for r in found) == 4 and sum(r.kept for r in found) == 5
    assert resampling.resample(documents([]), none).count() == 0
