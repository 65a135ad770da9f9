from __future__ import annotations

import re

import corpus_pipeline
from clipgrid.llm import mixing
from corpus_samples import ODD, prose
from test_mixing import brute_targets
from test_simhash import brute_groups, brute_print
from test_suffix_dedup import brute as brute_removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(seed, words=160):
    return prose(seed, words).replace(" ", ". ", 8)


def corpus():
    passage = prose(77, 60)
    rows = [(i, good(i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(30 + i, good(30 + i) + " " + passage, "en", "s0") for i in range(5)]
    rows += [(40, rows[3][1], "en", "s1"), (41, rows[4][1].replace("river", "River", 1), "en", "s2")]
    rows += [(50 + i, " | ".join(prose(i, 100).split()) + " !!" * 80, "en", "s2") for i in range(6)]
    return rows, passage


def stages(spark, df):
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        yield name, docs


def test_stages_against_brute_force(spark, documents):
    rows, passage = corpus()
    found = dict(stages(spark, documents(rows)))
    kept = [r for r in rows if r[0] < 50]
    assert sorted(r.doc_id for r in found["quality_rules"].collect()) == [r[0] for r in kept]
    groups = brute_groups([brute_print(r[1]) for r in kept])
    first = [r for i, r in enumerate(kept) if groups[i] == i]
    assert sorted(r.doc_id for r in found["simhash_near_duplicates"].collect()) == [r[0] for r in first] and len(first) < len(kept)
    cleaned = {r.doc_id: r for r in found["suffix_array_dedup"].collect()}
    want = brute_removed([r[:2] for r in first])
    assert {d: len(r.text.encode()) for d, r in cleaned.items()} == {d: w[0] - w[1] for d, w in want.items()}
    assert passage in cleaned[30].text and not any(passage in cleaned[d].text for d in range(31, 35))
    assert all(r.n_chars == len(r.text) for r in cleaned.values())
    sizes = {}
    for r in cleaned.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"\S+", r.text))
    targets = brute_targets(sizes, mixing.WEIGHTS, 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        words = sum(len(r.text.split()) for r in found["source_mixing"].collect() if r.source == s)
        assert abs(words - targets[s]) <= 170
    encoded = found["byte_level_bpe"].collect()
    assert len(encoded) == found["source_mixing"].count() and all(r.decodes and r.n_tokens == len(r.ids) for r in encoded)
    for name in list(found)[:-1]:
        assert found[name].columns == COLUMNS


def test_run_reads_its_table(spark, documents, tmp_path):
    rows, _ = corpus()
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == ["doc_id", "source", "n_tokens", "ids", "decodes"] and 30 <= result.count() <= 80


def test_odd_rows_and_clashing_columns(spark, documents):
    odd = [(*r, None, None)[:4] for r in ODD] + corpus()[0][:12]
    extra = documents(odd).selectExpr("*", "'q' AS quality", "'k' AS kept", "1 AS row", "2 AS spans", "3 AS times", "4 AS size", "5 AS fp", "6 AS _text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, "")
        assert out.columns == extra.columns, name
        out.collect()
        assert stage(spark, extra.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, extra, "").count() == len(odd)
