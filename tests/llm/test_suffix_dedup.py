from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from clipgrid.llm import suffix_dedup
from corpus_samples import ODD, prose


def brute(rows, length=suffix_dedup.LENGTH):
    """n_bytes, n_removed, n_spans and digest of each row, for distinct ids."""
    seen, found = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if string in seen:
                gone[i : i + length] = True
            seen.add(string)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        found[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return found


def report(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(df).collect()}


def test_planted_passages(documents):
    rng = random.Random(1)
    shared = [prose(1000 + i, 40) for i in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(i, rng.randrange(5, 60)) for _ in range(2)]
        text = parts[0] + " " + rng.choice(shared) + " " + parts[1]
        rows.append((i, text if i % 7 else rows[rng.randrange(len(rows))][1] if rows else text))
    rows += [(60, "ab" * 400), (61, "x" * 350), (62, "x" * 99), (63, "x" * 100), (64, prose(3, 30) * 5), (65, "öß" * 120), (66, ""), (67, None)]
    assert report(documents(rows)) == brute(rows)


@pytest.mark.parametrize("crowd", [0, 5, 256])
def test_a_common_line_in_many_surroundings(documents, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "COMBINED", 400)
    line = prose(9, 24)
    rows = [(i, f"{prose(i, 12)}\n{line}\n{prose(500 + i % 7, 12)}") for i in range(60)]
    assert report(documents(rows)) == brute(rows)


def test_chunks_of_a_long_text(documents, monkeypatch):
    rows = [(0, prose(1, 400)), (1, prose(2, 300) + prose(1, 400)[200:1200] + prose(3, 100))]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 512)
    texts = [t.encode() for _, t in rows]
    covered = []
    for some in suffix_dedup._pieces(texts):
        for a, _, doc, at in suffix_dedup._anchor_rows(np.array([0, 1]), texts, some):
            first = (at & 0x7FFFFFFF) - (a >> 7 & 127)
            covered += [(d, s) for d, f, n in zip(doc, first, a & 127, strict=True) for s in range(f, f + n + 1)]
    assert sorted(covered) == [(d, s) for d, t in enumerate(texts) for s in range(len(t) - suffix_dedup.LENGTH + 1)]


def test_odd_rows(documents):
    found = suffix_dedup.removal_report(documents(ODD)).collect()
    assert len(found) == len(ODD)
    five = sorted((r.n_bytes, r.n_removed) for r in found if r.doc_id == 5)
    long = len(ODD[4][1].encode())
    assert (long, 0) in five and (long, long) in five
    nulls = sorted((r.n_bytes, r.n_removed) for r in found if r.doc_id is None)
    assert nulls == [(0, 0), (long, long)]


def test_nulls_of_equal_short_hashes_are_different_rows(documents):
    seen, texts = {}, None
    for i in range(1 << 20):
        text = f"{i} " + "abcdefghij" * 12
        tag = xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF
        if tag in seen:
            texts = seen[tag], text
            break
        seen[tag] = text
    tails = [t.split(" ")[0] for t in texts]
    found = suffix_dedup.remove_repeats(documents([(None, t) for t in texts]), keep=["doc_id"]).collect()
    kept = sorted(bytes(r.kept).decode() for r in found)
    assert tails[0] != tails[1] and all(any(k.startswith(t) for k in kept) for t in tails)


def test_empty_table_and_clashing_columns(spark, documents):
    assert suffix_dedup.removal_report(documents([])).count() == 0
    df = spark.createDataFrame([(1, "t" * 10, 5, "a")], "doc_id long, text string, spans int, at string")
    row = suffix_dedup.remove_repeats(df).first()
    assert (row["at"], row.n_bytes, row.spans) == ("a", 10, [])


def test_whole_characters():
    text = "aéb".encode()  # é is bytes 1 and 2
    assert suffix_dedup._whole_characters(text, [(0, 2)]) == [(0, 1)]
    assert suffix_dedup._whole_characters(text, [(2, 4)]) == [(3, 4)]
    assert suffix_dedup._whole_characters(text, [(1, 3)]) == [(1, 3)]
    assert suffix_dedup._whole_characters(text, [(2, 3)]) == []


@pytest.mark.parametrize("seed", range(5))
def test_smaller_before(seed):
    values = np.random.default_rng(seed).integers(0, 50, 200)
    want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
    assert suffix_dedup.smaller_before(values).tolist() == want
