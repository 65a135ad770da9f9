"""Sampling, numbering, chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from clipgrid.operators import chunks as K
from clipgrid.operators import sampling as P
from clipgrid.operators.scoring import Plugin, Registry, chunk_propagator
from clipgrid.operators.skew import join_by_group, number_rows, unfold
from clipgrid.operators.spans import union_runs


def test_sampling_equals_numpy(spark):
    clips = [(f"{n}_{fps}", n, fps) for n in (0, 1, 2, 3, 7, 30, 61, 300, 1001) for fps in (23.976, 24.0, 29.97, 30.0, 1.0, 240.0)]
    df = spark.createDataFrame(clips, "vid string, num_frames long, video_fps double")
    got = {}
    for r in P.sample_frames(df, fps_target=3.0).collect():
        got.setdefault(r["vid"], {})[r["sample_idx"]] = r["frame_idx"]
    for vid, n, fps in clips:
        count = min(n, max(1, round(n / fps * 3.0)))
        expected = [n - 1] if count == 1 else np.linspace(0, max(0, n - 1), count).round().astype(int).tolist()
        assert [got.get(vid, {})[i] for i in range(count)] == expected, vid


def test_unusable_rates_fall_back(spark):
    df = spark.createDataFrame([(v,) for v in ("25", "0", "-3", "x", None, "NaN", "29.97")], "t string")
    assert [r[0] for r in df.select(P.source_fps(F.col("t"))).collect()] == [25.0, 30.0, 30.0, 30.0, 30.0, 30.0, 29.97]
    assert [r[0] for r in df.select(P.target_fps(F.col("t"))).collect()] == [25.0, 3.0, 3.0, 3.0, 3.0, 3.0, 29.97]


def test_earliest_frame_wins_a_tie(spark):
    df = spark.createDataFrame([("a", 2, 20, 0.9), ("a", 1, 10, 0.9), ("a", 0, 0, 0.1)], "vid string, sample_idx long, frame_idx long, score double")
    r = P.pick_key_frames(df).first()
    assert (r["key_frame_idx"], r["frame_idx"], r["num_sampled_frames"], r["max_similarity"]) == (1, 10, 3, 0.9)


@pytest.mark.parametrize("segment", [1, 7, 1000])
def test_numbering_one_hot_key(spark, segment):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 500, 3000)
    data = [("hot" if i % 3 else f"k{i % 50}", int(v), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "k string, v long, i long")
    numbered = number_rows(df, ["k"], [F.col("v"), F.col("i")], F.floor(F.col("v") / segment), "n")
    got = {}
    for r in numbered.collect():
        got.setdefault(r["k"], []).append((r["n"], r["v"], r["i"]))
    for entries in got.values():
        entries.sort()
        assert [e[0] for e in entries] == list(range(1, len(entries) + 1))
        assert [e[1:] for e in entries] == sorted(e[1:] for e in entries)


def test_unfold_in_blocks(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 7)], "vid string, n long")
    got = rows(unfold(df, F.col("n"), "i", ["vid"], block=4).select("vid", "i"))
    assert got == [("a", i) for i in range(10)] + [("c", i) for i in range(7)]


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 9}", i) for i in range(500)], "k string, i long")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3)], "k string, v long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(join_by_group(left, right, ["k"], ["i"], how)) == rows(left.join(right, "k", how))
    with pytest.raises(ValueError, match="full"):
        join_by_group(left, right, ["k"], ["i"], "full")


def loop_chunks(n, size, overlap):
    chunks, start = [], 0
    while start < n:
        end = min(start + size, n)
        chunks.append((start, end))
        if end >= n:
            break
        start = end - overlap
    return chunks


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (10, 0), (5, 4)])
def test_chunks_equal_the_loop(spark, size, overlap):
    data = [(str(n), n, k) for n in range(0, 45) for k in (0, n // 2, n - 1, n)]
    df = spark.createDataFrame([(f"{v}_{k}", n, k) for v, n, k in data], "vid string, num_frames long, key_frame_idx long")
    cut = {}
    for r in K.cut_chunks(df.dropDuplicates(["vid"]), size, overlap).collect():
        cut.setdefault(r["vid"], []).append((r["chunk_id"], r["chunk_start"], r["chunk_end"]))
    main = {r["vid"]: r["m"] for r in df.select("vid", K.main_chunk(F.col("key_frame_idx"), F.col("num_frames"), size, overlap).alias("m")).collect()}
    for v, n, k in data:
        chunks = loop_chunks(n, size, overlap)
        assert [c[1:] for c in sorted(cut.get(f"{v}_{k}", []))] == chunks
        holding = [i for i, (a, b) in enumerate(chunks) if a <= k < b]
        assert main[f"{v}_{k}"] == (holding[0] if holding else None)


def test_overlap_must_be_smaller_than_the_chunk():
    for size, overlap in ((5, 5), (5, 6), (0, 0), (5, -1)):
        with pytest.raises(ValueError, match="overlap"):
            K.check_chunking(size, overlap)


def test_merge_equals_the_weighted_mean(spark):
    data = [(g, b, back, o) for o in (7, 10) for back in (True, False) for b in (20,) for g in range(5, 36)]
    df = spark.createDataFrame(data, "g long, b long, back boolean, o int")
    for overlap in (7, 10):
        part = df.filter(F.col("o") == overlap)
        source = K.merge_source(F.col("g"), F.col("b"), F.col("back"), overlap)
        for r in part.withColumn("s", source).collect():
            g, b = r["g"], r["b"]
            if (g < b) if r["back"] else (g >= b):
                weight = 1.0
            else:
                weight = min(1.0, max(0.0, ((g - b) if r["back"] else (b - g)) / overlap))
            for old in (0, 1):
                for new in (0, 1):
                    expected = (1 - weight) * old + weight * new > 0.5
                    got = {"new": new, "old": old, "both": old and new}[r["s"]]
                    assert bool(got) == bool(expected), (r, old, new)


def drift(chunk_id, start, end, prompt_idx, mask):
    """A propagator whose result depends on chunk and distance: shift right, and grow on even chunks."""
    return {f: {(y, x + d) for y, x in mask for d in range(f - prompt_idx + 50, f - prompt_idx + 51 + (chunk_id % 2 == 0))} for f in range(start, end)}


def sequential(n, key, prompt, size, overlap):
    """All chunks one after another: the main one, then back, then forward."""
    chunks = loop_chunks(n, size, overlap)
    main = next(i for i, (a, b) in enumerate(chunks) if a <= key < b)
    masks = drift(main, *chunks[main], key, prompt)

    def merge(new, weight_of):
        for g, mask in new.items():
            if g not in masks:
                masks[g] = mask
                continue
            w = weight_of(g)
            old = masks[g]
            masks[g] = {p for p in old | mask if (1 - w) * (p in old) + w * (p in mask) > 0.5}

    for i in range(main - 1, -1, -1):
        edge = chunks[i + 1][0]
        if edge in masks:
            merge(drift(i, *chunks[i], edge, masks[edge]), lambda g: 1 if g < edge else min(1, (g - edge) / overlap))
    for i in range(main + 1, len(chunks)):
        edge = chunks[i - 1][1]
        if edge - 1 in masks:
            merge(drift(i, *chunks[i], edge - 1, masks[edge - 1]), lambda g: 1 if g >= edge else max(0, min(1, (edge - g) / overlap)))
    return masks


@pytest.mark.parametrize(("size", "overlap"), [(6, 2), (6, 4)])
def test_waves_equal_the_sequential_loop(spark, size, overlap):
    clips = [("a", 17, 9), ("b", 5, 0), ("c", 13, 12), ("d", 4, 9)]
    prompt = {(0, 0), (0, 1), (1, 3)}
    df = spark.createDataFrame(clips, "vid string, num_frames long, key_frame_idx long")
    frames = spark.createDataFrame([(v, k, 4, 4000) for v, _, k in clips], "vid string, frame_idx long, height long, width long")
    spans = spark.createDataFrame([(v, k, y, x, x + 1) for v, _, k in clips for y, x in prompt], "vid string, frame_idx long, y long, x0 long, x1 long")

    def propagate(chunks, prompt_frames, prompt_spans):
        sizes = prompt_frames.select("vid", "height", "width")
        length = F.col("chunk_end") - F.col("chunk_start")
        grid = unfold(chunks.join(sizes, "vid"), length, "local", ["vid"]).withColumn("frame_idx", F.col("chunk_start") + F.col("local"))
        shift = F.col("frame_idx") - F.col("prompt_idx") + 50
        wide = F.when(F.col("chunk_id") % 2 == 0, 1).otherwise(0)
        moved = grid.select("vid", "frame_idx", shift.alias("shift"), wide.alias("wide")).join(prompt_spans.drop("frame_idx"), "vid")
        runs = moved.select("vid", "frame_idx", "y", (F.col("x0") + F.col("shift")).alias("x0"), (F.col("x1") + F.col("shift") + F.col("wide")).alias("x1"))
        return grid.select("vid", "frame_idx", "height", "width"), union_runs(runs, ["vid", "frame_idx"])

    out_frames, out_spans = K.propagate_in_chunks(df, frames, spans, propagate, size, overlap)
    got = {}
    for r in out_spans.collect():
        got.setdefault((r["vid"], r["frame_idx"]), set()).update((r["y"], x) for x in range(r["x0"], r["x1"]))
    have = {(r["vid"], r["frame_idx"]) for r in out_frames.collect()}
    expected = {}
    for vid, n, key in clips:
        if key < n:
            for f, mask in sequential(n, key, prompt, size, overlap).items():
                expected[(vid, f)] = mask
    assert have == set(expected)
    assert got == {k: m for k, m in expected.items() if m}


@pytest.mark.parametrize(("size", "overlap"), [(6, 0), (6, 2), (6, 3), (6, 4), (50, 8)])
def test_a_walk_through_chunks_equals_the_sequential_loop(size, overlap):
    prompt = {(0, 0), (0, 1), (1, 3)}

    def apply(row):
        at = row.iloc[0]
        mask = {(r["y"], x) for r in at["prompt"] for x in range(r["x0"], r["x1"])}
        masks = drift(at["chunk_id"], at["chunk_start"], at["chunk_end"], at["prompt_idx"], mask)
        yield from (pd.DataFrame([("v", f, y, x, x + 1) for y, x in m], columns=["vid", "frame_idx", "y", "x0", "x1"]) for f, m in masks.items())

    for n, key in ((17, 9), (5, 0), (13, 12), (40, 3), (40, 39), (1, 0)):
        chunks = loop_chunks(n, size, overlap)
        main = next(i for i, (a, b) in enumerate(chunks) if a <= key < b)
        first = {"vid": "v", "num_frames": n, "main_chunk": main, "chunk_id": main, "chunk_start": chunks[main][0], "chunk_end": chunks[main][1], "prompt_idx": key}
        row = pd.DataFrame([first | {"prompt": [{"y": y, "x0": x, "x1": x + 1} for y, x in prompt]}])
        got = {}
        for part in K.walk_chunks(apply, row, size, overlap):
            for r in part.itertuples():
                assert len(part) > 0 and r.vid == "v"
                got.setdefault(r.frame_idx, []).extend((r.y, x) for x in range(r.x0, r.x1))
        assert all(len(set(m)) == len(m) for m in got.values())
        if overlap:
            assert {f: set(m) for f, m in got.items()} == sequential(n, key, prompt, size, overlap)
        else:  # without a shared frame nothing is handed on
            assert set(got) == set(range(*chunks[main]))


def test_jobs_do_not_grow_with_the_length_of_a_clip(spark):
    def hold(model, row):
        at = row.iloc[0]
        frames = range(at["chunk_start"], at["chunk_end"])
        return pd.DataFrame([("v", f, r["y"], r["x0"], r["x1"]) for f in frames for r in at["prompt"]], columns=["vid", "frame_idx", "y", "x0", "x1"])

    jobs = []
    for n in (20, 300):
        spark.sparkContext.setJobGroup(f"walk {n}", "")
        clips = spark.createDataFrame([("v", n, 9)], "vid string, num_frames long, key_frame_idx long")
        frames = spark.createDataFrame([("v", 9, 4, 40)], "vid string, frame_idx long, height long, width long")
        spans = spark.createDataFrame([("v", 9, 2, 3, 7)], "vid string, frame_idx long, y long, x0 long, x1 long")
        out_frames, out_spans = K.propagate_in_chunks(clips, frames, spans, chunk_propagator(Registry({"p": Plugin(hold)}), "p"), 8, 2)
        assert sorted(r.frame_idx for r in out_frames.collect()) == list(range(n))
        assert {tuple(r) for r in out_spans.collect()} == {("v", f, 2, 3, 7) for f in range(n)}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 3  # adaptive plans differ by a job or two; a wave has several, and the long clip has 49 chunks more
