"""Mask algebra against dense arrays."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import pixels, rows
from pyspark.sql import functions as F

from clipgrid.functions.scores import round_half_up
from clipgrid.operators import overlap as O
from clipgrid.operators import spans as S
from clipgrid.operators import packed as PK
from clipgrid.operators import tubes as T
from clipgrid.operators import tiles as tiling
from clipgrid.operators.skew import NEAR, join_by_group
from clipgrid.operators.tiles import meetings, tiled_overlaps
from clipgrid.operators.outcomes import mask_count_reason, outcome_rows, propagation_method, refine_reason
from clipgrid.schemas import MASK_FRAMES, MASK_SPANS

H, W = 13, 17


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(3)
    masks = {("a", t, f): rng.random((H, W)) < p for t, p in enumerate((0.15, 0.5, 0.85)) for f in range(2)}
    masks[("a", 0, 0)][:] = False
    masks[("a", 2, 1)][:] = True
    return masks


def runs_of(mask):
    for y in range(mask.shape[0]):
        x = 0
        while x < mask.shape[1]:
            if mask[y, x]:
                start = x
                while x < mask.shape[1] and mask[y, x]:
                    x += 1
                yield y, start, x
            else:
                x += 1


def tables(spark, masks):
    spans = [(*k, y, a, b) for k, m in masks.items() for y, a, b in runs_of(m)]
    frames = [(*k, *m.shape) for k, m in masks.items()]
    return spark.createDataFrame(spans, MASK_SPANS), spark.createDataFrame(frames, MASK_FRAMES)


def same(df, masks):
    got = pixels(df, "vid", "tube_id", "frame_idx")
    for key, mask in masks.items():
        assert got.get(key, set()) == {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}, key


def test_union_of_overlapping_and_touching_runs(spark):
    data = [("a", 0, 0, 0, 0, 3), ("a", 0, 0, 0, 2, 5), ("a", 0, 0, 0, 5, 6), ("a", 0, 0, 0, 8, 9), ("a", 0, 0, 1, 4, 4)]
    spans = spark.createDataFrame(data * 3, MASK_SPANS)
    assert rows(S.union_runs(spans)) == [("a", 0, 0, 0, 0, 6), ("a", 0, 0, 0, 8, 9)]


def test_intersection(spark, dense):
    spans, _ = tables(spark, dense)
    a = spans.filter("tube_id = 1").drop("tube_id")
    b = spans.filter("tube_id = 2").drop("tube_id")
    got = pixels(S.intersect_runs(a, b, ["vid", "frame_idx"]), "vid", "frame_idx")
    for f in range(2):
        both = dense[("a", 1, f)] & dense[("a", 2, f)]
        assert got[("a", f)] == {(int(y), int(x)) for y, x in zip(*np.nonzero(both))}


def test_statistics(spark, dense):
    spans, frames = tables(spark, dense)
    got = {(r["vid"], r["tube_id"], r["frame_idx"]): r for r in S.mask_stats(spans, frames).collect()}
    for key, mask in dense.items():
        r, (ys, xs) = got[key], np.nonzero(mask)
        assert r["area"] == mask.sum() and abs(r["coverage"] - mask.mean() * 100) < 1e-9
        box = (r["xmin"], r["ymin"], r["xmax"], r["ymax"])
        assert box == ((xs.min(), ys.min(), xs.max(), ys.max()) if len(xs) else (None,) * 4)


def test_box_and_extent_lose_the_last_line(spark):
    boxes = spark.createDataFrame([("a", (2, 3, 6, 8))], "vid string, bbox struct<xmin:int,ymin:int,xmax:int,ymax:int>")
    spans = S.box_runs(boxes, ["vid"])
    frames = spark.createDataFrame([("a", 20, 20)], "vid string, height int, width int")
    r = S.mask_stats(spans, frames, ["vid"]).first()
    assert (r["area"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) == (20, 2, 3, 5, 7)
    empty = spark.createDataFrame([("a", (2, 3, 2, 8)), ("b", (-4, -4, -1, 2))], boxes.schema)
    assert S.box_runs(empty, ["vid"]).count() == 0


def grow(mask, r):
    padded = np.pad(mask, r, constant_values=False)
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1)).any((2, 3))


def shrink(mask, r):
    padded = np.pad(mask, r, constant_values=True)
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1)).all((2, 3))


@pytest.mark.parametrize("radius", [1, 2])
def test_dilate_and_erode(spark, dense, radius):
    spans, frames = tables(spark, dense)
    sized = spans.join(frames, ["vid", "tube_id", "frame_idx"])
    same(S.dilate(sized, radius), {k: grow(m, radius) for k, m in dense.items()})
    same(S.erode(sized, radius), {k: shrink(m, radius) for k, m in dense.items()})


def test_close_then_open(spark, dense):
    spans, frames = tables(spark, dense)
    same(S.close_open(spans, frames), {k: grow(shrink(shrink(grow(m, 2), 2), 1), 1) for k, m in dense.items()})


@pytest.mark.parametrize(("height", "width"), [(13, 17), (5, 40), (31, 6), (1, 1)])
def test_nearest_resize(spark, dense, height, width):
    spans, frames = tables(spark, dense)
    sized = spans.join(frames, ["vid", "tube_id", "frame_idx"])
    ys = np.floor(np.arange(height) * (H / height)).astype(int)
    xs = np.floor(np.arange(width) * (W / width)).astype(int)
    same(S.union_runs(S.resize_runs(sized, F.lit(height), F.lit(width))), {k: m[np.ix_(ys, xs)] for k, m in dense.items()})


@pytest.mark.parametrize("count", [1, 5, 7, 400])
def test_sample_points(spark, dense, count):
    spans, frames = tables(spark, dense)
    got = {}
    for r in S.sample_points(spans, frames, count).collect():
        got.setdefault((r["vid"], r["tube_id"], r["frame_idx"]), set()).add((r["x"], r["y"]))
    for key, mask in dense.items():
        ys, xs = np.nonzero(mask)
        if len(xs) == 0:
            expected = {(W // 2, H // 2)}
        elif len(xs) <= count:
            expected = set(zip(xs.tolist(), ys.tolist()))
        else:
            at = np.linspace(0, len(xs) - 1, count, dtype=int)
            expected = set(zip(xs[at].tolist(), ys[at].tolist()))
        assert got[key] == expected, key


BOXES = [(-3, -2, 6, 5), (3, 3, 9, 9), (10, 5, 40, 40), (5, 5, 5, 9), (20, 2, 30, 6), (-9, -9, -1, -1)]


def clamped_iou(mask, box):
    h, w = mask.shape
    x1, x2 = max(0, min(box[0], w - 1)), max(0, min(box[2], w))
    y1, y2 = max(0, min(box[1], h - 1)), max(0, min(box[3], h))
    if x2 <= x1 or y2 <= y1:
        return 0.0
    inter = mask[y1:y2, x1:x2].sum()
    union = mask.sum() + (x2 - x1) * (y2 - y1) - inter
    return inter / union if union else 0.0


@pytest.mark.parametrize("box", BOXES)
def test_mask_box_overlap(spark, dense, box):
    spans, frames = tables(spark, dense)
    boxes = spark.createDataFrame([("a", 1, box)], "vid string, frame_idx long, bbox struct<xmin:int,ymin:int,xmax:int,ymax:int>")
    got = {r["tube_id"]: r["iou"] for r in O.mask_box_iou(spans, frames, boxes).collect()}
    assert set(got) == {0, 1, 2}
    for tube, iou in got.items():
        assert abs(iou - clamped_iou(dense[("a", tube, 1)], box)) < 1e-12
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(W, box[2]), min(H, box[3])
    size = max(0, x1 - x0) * max(0, y1 - y0)
    for mode in ("relative", "absolute"):
        for r in O.tube_scores(spans, frames, boxes, mode).collect():
            mask = dense[("a", r["tube_id"], 1)]
            inter = mask[y0:y1, x0:x1].sum() if size else 0
            base = mask.sum() if mode == "relative" else size
            assert abs(r["ratio"] - (inter / base if base else 0)) < 1e-12
    with pytest.raises(ValueError, match="relative"):
        O.tube_scores(spans, frames, boxes, "other")


def test_first_tube_wins_a_tie(spark):
    scores = spark.createDataFrame([("a", 3, 0.5), ("a", 1, 0.5), ("a", 2, 0.1), ("b", 1, 0.2)], "vid string, tube_id long, ratio double")
    assert rows(O.pick_tubes(scores, 0.3)) == [("a", 1, 0.5)]
    scores = scores.withColumnRenamed("ratio", "iou")
    assert rows(O.pick_candidates(scores)) == [("a", 1, 0.5, 3), ("b", 1, 0.2, 1)]


def test_hold(spark):
    clips = spark.createDataFrame(
        [("a", 4, 2, 9, 9), ("b", 3, 3, 9, 9)], "vid string, num_frames long, key_frame_idx long, height long, width long"
    )
    prompt = spark.createDataFrame([("a", 1, 2, 4), ("b", 1, 2, 4)], "vid string, y long, x0 long, x1 long")
    frames, spans = T.hold(clips, prompt)
    assert rows(frames.select("vid", "frame_idx", "forward")) == [("a", 0, False), ("a", 1, False), ("a", 2, True), ("a", 3, True)]
    assert rows(spans) == [("a", f, 1, 2, 4) for f in range(4)]


def test_extend_keeps_what_a_tube_owns(spark):
    frames = spark.createDataFrame([("a", 0, 2, 9, 9), ("a", 0, 4, 9, 9), ("a", 1, 5, 9, 9)], MASK_FRAMES)
    spans = spark.createDataFrame([("a", 0, 2, 0, 0, 1), ("a", 0, 4, 0, 3, 5)], MASK_SPANS)
    clips = spark.createDataFrame([("a", 6)], "vid string, num_frames long")
    all_frames, all_spans = T.extend_tubes(clips, frames, spans)
    assert rows(all_frames.select("tube_id", "frame_idx")) == [(0, 0), (0, 1), (0, 2), (0, 4), (0, 5)] + [(1, f) for f in range(6)]
    assert rows(all_spans.select("frame_idx", "x0", "x1")) == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (4, 3, 5), (5, 3, 5)]


def test_existing_frames_are_not_replaced(spark):
    schema = "vid string, frame_idx long, x0 long"
    existing = spark.createDataFrame([("a", 1, 10)], schema)
    new = spark.createDataFrame([("a", 1, 99), ("a", 2, 20)], schema)
    merged = T.keep_existing(existing, new, existing, ["vid", "frame_idx"])
    assert rows(merged) == [("a", 1, 10), ("a", 2, 20)]


def test_later_write_wins(spark):
    frames = spark.createDataFrame([("a", 0, 1, 5), ("a", 0, 2, 6), ("a", 1, 1, 7)], "vid string, frame_idx long, write_rank int, height int")
    spans = spark.createDataFrame([("a", 0, 1, 0, 0, 9), ("a", 1, 1, 0, 0, 3)], "vid string, frame_idx long, write_rank int, y long, x0 long, x1 long")
    kept_frames, kept_spans = T.later_write_wins(frames, spans)
    assert rows(kept_frames) == [("a", 0, 6), ("a", 1, 7)]
    assert rows(kept_spans) == [("a", 1, 0, 0, 3)]


def test_missing_frames_become_empty_masks(spark):
    clips = spark.createDataFrame([("a", 3), ("b", 1)], "vid string, num_frames long")
    frames = spark.createDataFrame([("a", 1, 11, 22)], "vid string, frame_idx long, height long, width long")
    assert rows(T.fill_missing(clips, frames)) == [
        ("a", 0, 11, 22, True), ("a", 1, 11, 22, False), ("a", 2, 11, 22, True), ("b", 0, 480, 640, True),
    ]


def test_outcomes(spark):
    clips = spark.createDataFrame(
        [("a", "tube_selection", True, True), ("b", "box_propagation", True, False), ("c", "no_output", False, False), ("d", "tube_selection", True, True)],
        "vid string, method string, box_ok boolean, tubes_ok boolean",
    )
    frames = spark.createDataFrame([("a", i) for i in range(3)] + [("d", 0)], "vid string, frame_idx long")
    got = {r["vid"]: (r["status"], r["failure_reason"], r["num_masks"]) for r in outcome_rows(clips, frames).collect()}
    assert got == {
        "a": ("success", None, 3),
        "b": ("failed", "oom_or_propagation_failed", 0),
        "c": ("failed", "no_masks_generated", 0),
        "d": ("failed", "insufficient_masks_propagation_failed", 0),
    }


def test_method_choice(spark):
    t, f, none = F.lit(True), F.lit(False), F.lit(None).cast("long")
    cases = [
        ((t, t, t, F.lit(1)), "tube_selection"), ((t, t, t, none), "box_propagation"), ((t, f, t, none), "tube_selection"),
        ((t, t, f, none), "box_propagation"), ((f, t, t, none), "no_output"),
    ]
    row = spark.range(1).select(*[propagation_method(*c).alias(str(i)) for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [expected for _, expected in cases]
    reason = spark.range(1).select(refine_reason(mask_count_reason(F.lit(0)), F.lit("x"), t, f)).first()[0]
    assert reason == "oom_or_propagation_failed"


def _random_masks(spark, seed, count=25, height=14, width=17):
    """Canonical runs, frames, and the pixels as arrays."""
    rng = np.random.default_rng(seed)
    dense = {i: rng.random((height, width)) < rng.choice([0, 0.1, 0.5, 0.9, 1]) for i in range(count)}
    cells = [(f"v{i % 5}", i // 5, 0, int(y), int(x), int(x) + 1) for i, a in dense.items() for y, x in zip(*np.nonzero(a), strict=True)]
    spans = S.union_runs(spark.createDataFrame(cells, MASK_SPANS))
    frames = spark.createDataFrame([(f"v{i % 5}", i // 5, 0, height, width) for i in dense], MASK_FRAMES)
    return spans, frames, {(f"v{i % 5}", i // 5): a for i, a in dense.items()}


def test_packed_masks_equal_dense_arrays(spark):
    spans, frames, dense = _random_masks(spark, 3)
    packed = PK.pack_masks(spans, frames).cache()
    assert {(r.vid, r.tube_id) for r in packed.collect()} == set(dense)
    assert rows(PK.unpack_masks(packed)) == rows(spans.select("vid", "tube_id", "frame_idx", "y", "x0", "x1"))
    stats = S.mask_stats(spans, frames)
    assert rows(PK.packed_stats(packed).select(stats.columns)) == rows(stats)
    two = packed.alias("a").join(packed.alias("b"), F.expr("a.vid = b.vid AND a.tube_id < b.tube_id"))
    a, b = F.col("a.rects"), F.col("b.rects")
    found = two.select("a.vid", "a.tube_id", F.col("b.tube_id").alias("other"), PK.shared_area(a, b).alias("i"), PK.joint_area(a, b).alias("u")).collect()
    assert len(found) == 50
    for r in found:
        left, right = dense[r.vid, r.tube_id], dense[r.vid, r.other]
        assert (r.i, r.u) == ((left & right).sum(), (left | right).sum())
    one = PK.unite_packed(packed, ["vid", "frame_idx"])
    for r in one.withColumn("area", PK.area(F.col("rects"))).collect():
        assert r.area == np.any([a for (v, _), a in dense.items() if v == r.vid], axis=0).sum()


def test_packed_overlap_with_boxes_does_not_unfold(spark):
    spans, frames, dense = _random_masks(spark, 4)
    box = "struct<xmin:int,ymin:int,xmax:int,ymax:int>"
    boxes = spark.createDataFrame([("v0", 0, (2, 3, 9, 12)), ("v1", 0, (-5, -5, 100, 100)), ("v2", 0, (5, 5, 5, 9))], f"vid string, frame_idx long, bbox {box}")
    packed = PK.pack_masks(spans, frames)
    want = O.mask_box_iou(spans, frames, boxes)
    columns = ["vid", "tube_id", "frame_idx", "area", "inter", "box_pixels", "iou"]
    assert rows(PK.packed_box_iou(packed, boxes).select(columns)) == rows(want.select(columns))
    stored = spark.createDataFrame(packed.collect(), packed.schema)
    for df in (PK.packed_box_iou(stored, boxes), PK.packed_stats(stored)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Generate" in line and "rects" in line.split("],")[0] for line in plan.splitlines())


def test_packed_masks_are_smaller(spark, tmp_path):
    from clipgrid.sinks.tables import write_masks, write_packed_masks

    height, width = 200, 300
    cells = [(f"v{i % 40}", i % 3, i // 120, 20 + i % 50 + y, 30 + i % 70, 130 + i % 90) for i in range(600) for y in range(90)]
    spans = S.union_runs(spark.createDataFrame(cells, MASK_SPANS))
    frames = spark.createDataFrame(sorted({(*c[:3], height, width) for c in cells}), MASK_FRAMES)
    write_masks(frames, spans, str(tmp_path / "runs"), buckets=2)
    write_packed_masks(PK.pack_masks(spans, frames), str(tmp_path / "packed"), buckets=2)
    size = {n: sum(f.stat().st_size for f in (tmp_path / n).rglob("*.parquet")) for n in ("runs", "packed")}
    assert size["packed"] < 0.7 * size["runs"], size
    assert spark.read.parquet(str(tmp_path / "packed")).count() == frames.count()


def test_growth_takes_few_sweeps():
    assert len(S.sweeps(16)) <= 5 and len(S.sweeps(1000)) <= 8
    for radius in range(1, 200):
        steps, reach = S.sweeps(radius), S.sweeps(radius)[0]
        for step in steps[1:]:
            assert step <= 2 * reach + 1  # no line between the copies is missed
            reach += step
        assert reach == radius


@pytest.mark.parametrize("radii", [(1, 2, 3, 4), (5, 7, 8), (11, 16, 20)])
def test_growth_at_borders_equals_dense_arrays(spark, radii):
    spans, frames, dense = _random_masks(spark, 6, count=15)
    sized = spans.join(frames, ["vid", "tube_id", "frame_idx"]).cache()
    for radius in radii:
        for operation, outside in ((S.dilate, False), (S.erode, True)):
            found = pixels(operation(sized, radius), "vid", "tube_id")
            for key, a in dense.items():
                padded = np.pad(a, radius, constant_values=outside)
                windows = np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1))
                want = windows.all(axis=(2, 3)) if outside else windows.any(axis=(2, 3))
                assert found.get(key, set()) == {(int(y), int(x)) for y, x in zip(*np.nonzero(want), strict=True)}, (key, radius)


def _crowd(spark, seed, count, side=512, most=40):
    """Masks of a few rectangles and boxes on one frame, as rows and as sets of pixels."""
    rng = random.Random(seed)
    spans, masks, boxes = set(), {}, []
    for tube in range(count):
        cells = set()
        for _ in range(2):
            x, y, w, h = rng.randrange(side - 4), rng.randrange(side - 4), rng.randrange(1, most), rng.randrange(1, 6)
            cells |= {(i, j) for i in range(y, min(side, y + h)) for j in range(x, min(side, x + w))}
        masks[tube] = cells
        for y in {i for i, _ in cells}:
            row = sorted(j for i, j in cells if i == y)
            cuts = [k for k in range(1, len(row)) if row[k] != row[k - 1] + 1]
            for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True):
                spans.add(("v", tube, 0, y, row[a], row[b - 1] + 1))
        x, y = rng.randrange(-20, side), rng.randrange(-20, side)
        boxes.append((tube, x, y, x + rng.randrange(0, most), y + rng.randrange(0, most)))
    boxes += [(count, -9, -9, 10**9, 10**9), (count + 1, 0, 0, side, 3), (count + 2, 5, 5, 5, 9), (count + 3, 9, 9, 2, 2)]
    runs = spark.createDataFrame(sorted(spans), "vid string, tube_id long, frame_idx long, y long, x0 long, x1 long")
    frames = spark.createDataFrame([("v", t, 0, side, side) for t in masks], "vid string, tube_id long, frame_idx long, height long, width long")
    rows = [("v", 0, b, corners) for b, *corners in boxes] + [("v", 0, 999, None), ("w", 0, 1, (0, 0, 9, 9)), (None, 0, 1, (0, 0, 9, 9))]
    kind = "vid string, frame_idx long, box_id long, bbox struct<xmin:int,ymin:int,xmax:int,ymax:int>"
    return runs, frames, spark.createDataFrame(rows, kind), masks, boxes


@pytest.mark.parametrize("tile", [(64, 64), (7, 13), (1, 1000), (512, 512)])
def test_tiles_count_each_shared_pixel_once(spark, tile):
    runs, frames, boxes, masks, corners = _crowd(spark, 3, 25, side=120)
    want = {}
    for b, x0, y0, x1, y1 in corners:
        x0, y0, x1, y1 = max(0, x0), max(0, y0), min(120, x1), min(120, y1)
        for t, cells in masks.items():
            shared = sum(y0 <= i < y1 and x0 <= j < x1 for i, j in cells)
            if shared:
                pixels = (x1 - x0) * (y1 - y0)
                want[t, b] = (len(cells), pixels, shared, round(shared / (len(cells) + pixels - shared), 9))
    found = {(r.tube_id, r.box_id): (r.area, r.box_pixels, r.inter, round(r.iou, 9)) for r in tiled_overlaps(runs, frames, boxes, tile=tile).collect()}
    assert found == want


def test_fewer_rows_meet_in_tiles(spark):
    runs, _, boxes, _, _ = _crowd(spark, 4, 150)
    small = boxes.filter("box_id < 150 AND bbox IS NOT NULL").select("vid", "frame_idx", "box_id", "bbox.*")
    small = small.filter("xmin >= 0 AND ymin >= 0 AND xmax <= 512 AND ymax <= 512")
    keys = ["vid", "tube_id", "frame_idx"]
    whole, tiled = (meetings(runs, small, keys, "box_id", t).count() for t in ((512, 512), (64, 64)))
    assert whole >= 15 * tiled


def test_tiles_need_a_pixel_and_empty_tables_give_nothing(spark):
    runs, frames, boxes, _, _ = _crowd(spark, 5, 3)
    with pytest.raises(ValueError, match="at least one pixel"):
        tiled_overlaps(runs, frames, boxes, tile=(0, 8))
    assert tiled_overlaps(runs.limit(0), frames, boxes).count() == 0
    assert tiled_overlaps(runs, frames, boxes.limit(0)).count() == 0


def test_boxes_of_all_clips_are_not_broadcast(spark):
    frames = spark.range(40).select(
        F.concat(F.lit("v"), "id").alias("vid"), F.lit(0).cast("long").alias("tube_id"), F.lit(0).cast("long").alias("frame_idx"),
        F.lit(9).cast("long").alias("height"), F.lit(9).cast("long").alias("width"),
    )
    runs = frames.select("vid", "tube_id", "frame_idx", F.lit(1).cast("long").alias("y"), F.lit(2).cast("long").alias("x0"), F.lit(5).cast("long").alias("x1"))
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("xmin", 0), ("ymin", 0), ("xmax", 4), ("ymax", 4))])
    boxes = frames.select("vid", "frame_idx", box.alias("bbox"))
    for scores in (O.mask_box_iou(runs, frames, boxes), O.tube_scores(runs, frames, boxes, "absolute"), PK.packed_box_iou(PK.pack_masks(runs, frames), boxes)):
        assert {r.inter for r in scores.collect()} == {2}
        assert "Broadcast" not in scores._jdf.queryExecution().executedPlan().toString()


def test_salted_groups_are_broadcast_only_by_their_real_size(spark, tmp_path):
    # Compressed to far less than the threshold, copied and in memory to more.
    spark.range(60000).select(F.concat(F.lit("group-of-one-name-"), "id").alias("k"), F.lit("x" * 40).alias("v")).write.parquet(f"{tmp_path}/g")
    groups = spark.read.parquet(f"{tmp_path}/g")
    for few, wanted in ((False, "SortMergeJoin"), (True, "BroadcastHashJoin")):
        joined = join_by_group(groups.select("k"), groups.filter("k < 'group-of-one-name-10'") if few else groups, ["k"], ["k"], "left")
        joined.write.mode("overwrite").parquet(f"{tmp_path}/out")
        joined.collect()
        assert wanted in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("runs, tiles", [(64, 16), (4, 16), (64, 1), (0, 0)])
def test_masks_whole_or_cut_give_the_same_pairs(spark, monkeypatch, runs, tiles):
    spans, frames, boxes, masks, corners = _crowd(spark, 6, 20, side=120)
    monkeypatch.setattr(tiling, "WHOLE_RUNS", runs)
    monkeypatch.setattr(tiling, "WHOLE_TILES", tiles)
    want = {}
    for b, x0, y0, x1, y1 in corners:
        x0, y0, x1, y1 = max(0, x0), max(0, y0), min(120, x1), min(120, y1)
        shared = {t: sum(y0 <= i < y1 and x0 <= j < x1 for i, j in cells) for t, cells in masks.items()}
        want |= {(t, b): (len(masks[t]), n) for t, n in shared.items() if n}
    found = tiled_overlaps(spans, frames, boxes, tile=(16, 16)).collect()
    assert {(r.tube_id, r.box_id): (r.area, r.inter) for r in found} == want and len(found) == len(want)


def test_pairs_of_small_masks_are_not_shuffled(spark):
    spans, frames, boxes, _, _ = _crowd(spark, 7, 10, side=120)
    plan = tiled_overlaps(spans, frames, boxes)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("SortMergeJoin")[0]
    assert "Union" in above and "Exchange" not in above and "Aggregate" not in above


def _rect_masks(spark):
    """Masks of one, equal, touching, crossing and distant rectangles, as rows and as sets of pixels."""
    rng = random.Random(8)
    rects = [(t, y, y + rng.randrange(1, 9), x, x + rng.randrange(1, 30)) for t in range(12) for y, x in [(rng.randrange(90), rng.randrange(90))]]
    rects += [(t, y, y + 3, x, x + rng.randrange(1, 30)) for t in range(12, 24) for y, x in [(rng.randrange(90), rng.randrange(90)) for _ in range(3)]]
    rects += [(24, 5, 8, 10, 20)] * 40 + [(25, 5, 8, 10, 20), (25, 8, 11, 10, 20), (25, 6, 9, 0, 119), (26, 0, 2, 0, 2), (26, 110, 112, 110, 112)]
    rects += [(27, 4, 4, 1, 9), (27, 4, 6, 9, 9), (28, 0, 120, 0, 120), (29, 3, 3, 0, 9), (29, 3, 5, 7, 9)]
    masks = {}
    for t, y0, y1, x0, x1 in rects:
        masks.setdefault(t, set()).update((i, j) for i in range(y0, y1) for j in range(x0, x1))
    known = [("v", t, 0, *sides) for t, *sides in rects] + [("v", None, 0, 0, 9, 0, 9), (None, 1, 0, 0, 9, 0, 9), ("v", 1, 0, None, 9, 0, 9)]
    return spark.createDataFrame(known, "vid string, tube_id long, frame_idx long, y0 long, y1 long, x0 long, x1 long"), rects, masks


def test_masks_of_one_rectangle_need_no_lines(spark):
    rows_in, rects, masks = _rect_masks(spark)
    solid, spans = S.solid_masks(rows_in)
    distinct = {t: {r for r in rects if r[0] == t and r[2] > r[1] and r[4] > r[3]} for t in masks}
    assert sorted((r.tube_id, r.y0, r.y1, r.x0, r.x1) for r in solid.collect()) == sorted(r for s in distinct.values() if len(s) == 1 for r in s)
    assert pixels(spans, "tube_id") == {(t,): masks[t] for t, s in distinct.items() if len(s) > 1}
    boxed = {}
    for r in S.rectangles(spans).collect():
        cells = {(i, j) for i in range(r.y0, r.y1) for j in range(r.x0, r.x1)}
        assert not boxed.setdefault(r.tube_id, set()) & cells
        boxed[r.tube_id] |= cells
    assert boxed == {t: masks[t] for t, s in distinct.items() if len(s) > 1}


@pytest.mark.parametrize("tile, runs, tiles", [((16, 16), 64, 16), ((7, 13), 2, 4), ((64, 64), 0, 0), ((16, 16), 64, 10**6)])
def test_masks_of_one_rectangle_and_others_meet_the_same_boxes(spark, monkeypatch, tile, runs, tiles):
    monkeypatch.setattr(tiling, "WHOLE_RUNS", runs)
    monkeypatch.setattr(tiling, "WHOLE_TILES", tiles)
    rows_in, _, masks = _rect_masks(spark)
    _, _, boxes, _, corners = _crowd(spark, 9, 30, side=120)
    frames = rows_in.selectExpr("vid", "tube_id", "frame_idx", "120L AS height", "120L AS width")
    solid, spans = S.solid_masks(rows_in)
    found = tiled_overlaps(spans, frames, boxes, tile=tile, solid=solid).collect()
    want = {}
    for b, x0, y0, x1, y1 in corners:
        x0, y0, x1, y1 = max(0, x0), max(0, y0), min(120, x1), min(120, y1)
        shared = {t: sum(y0 <= i < y1 and x0 <= j < x1 for i, j in cells) for t, cells in masks.items()}
        want |= {(t, b): (len(masks[t]), (x1 - x0) * (y1 - y0), n) for t, n in shared.items() if n}
    assert {(r.tube_id, r.box_id): (r.area, r.box_pixels, r.inter) for r in found} == want and len(found) == len(want)


def test_pairs_of_rectangles_are_compared_in_compiled_code_and_sorted_by_one_number(spark):
    rows_in, _, _ = _rect_masks(spark)
    _, _, boxes, _, _ = _crowd(spark, 9, 10, side=120)
    frames = rows_in.selectExpr("vid", "tube_id", "frame_idx", "120L AS height", "120L AS width")
    solid, spans = S.solid_masks(rows_in)
    pairs = tiled_overlaps(spans, frames, boxes, solid=solid)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "SortMergeJoin [_cell" in line]
    assert joins and "*(" in joins[0] and "lambda" not in joins[0]
    # Boxes are dealt to their tiles once, whichever masks meet them there.
    assert len(joins) > 1 and "ReusedExchange" in plan


def test_halves_go_up_in_doubles_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    pairs = [(i, u) for a in range(8) for b in range(8) for u in [2**a * 5**b] for i in range(1, min(u, 40))]
    found = spark.createDataFrame(pairs, "i long, u long").select("i", "u", round_half_up(F.col("i") / F.col("u"), 6).alias("r")).collect()
    values = ", ".join(f"({i}, {u})" for i, u in pairs)
    want = duckdb.sql(f"SELECT i, u, round(i / u::DOUBLE, 6) FROM (VALUES {values}) t(i, u)").fetchall()
    assert sorted((r.i, r.u, r.r) for r in found) == sorted((i, u, r) for i, u, r in want)


def test_runs_are_united_in_one_order_without_a_table_of_runs(spark):
    kind = "vid string, tube_id long, frame_idx long, y long, x0 long, x1 long"
    rng = random.Random(9)
    parts = [("v", 0, f, y, x, x + rng.randrange(0, 9)) for f in range(3) for y in range(4) for x in rng.sample(range(60), 14)]
    spans = spark.createDataFrame([*parts, ("v", 0, 9, 0, 0, 50), ("v", 0, 9, 0, 5, 8), ("v", 0, 9, 0, 50, 51), ("v", 0, 9, 0, 60, 61)], kind)
    united = S.union_runs(spans)
    want = {}
    for r in spans.collect():
        want.setdefault((r.frame_idx, r.y), set()).update(range(r.x0, r.x1))
    expected = [("v", 0, f, y, a, b) for (f, y), cells in want.items() for a, b in _stretches(sorted(cells))]
    assert rows(united) == sorted(expected)
    assert "Aggregate" not in united._jdf.queryExecution().executedPlan().toString().rsplit("Initial Plan", 1)[-1].split("Window", 1)[0]


def _stretches(cells):
    begins = [x for x in cells if x - 1 not in cells]
    ends = [x + 1 for x in cells if x + 1 not in cells]
    return zip(begins, ends, strict=True)


def test_extending_copies_no_tube_and_deals_out_long_ones(spark):
    long, short = 3 * NEAR, 5
    clips = spark.createDataFrame([("a", long), ("b", short)], "vid string, num_frames long")
    frames = spark.createDataFrame([("a", 0, 2 * NEAR, 9, 9), ("a", 1, 7, 9, 9), ("a", 1, 9, 9, 9), ("b", 0, 0, 9, 9), ("b", 0, 4, 9, 9)], MASK_FRAMES)
    spans = spark.createDataFrame(
        [("a", 0, 2 * NEAR, 0, 0, 1), ("a", 0, 2 * NEAR, 0, 4, 6), ("a", 1, 7, 3, 1, 2), ("a", 1, 9, 4, 2, 3), ("b", 0, 0, 1, 1, 3), ("b", 0, 4, 1, 5, 6)], MASK_SPANS
    )
    _, grown = T.extend_tubes(clips, frames, S.union_runs(spans))
    want = [("a", 0, f, 0, *x) for f in range(long) for x in ((0, 1), (4, 6))]
    want += [("a", 1, f, 3, 1, 2) for f in range(8)] + [("a", 1, f, 4, 2, 3) for f in range(9, long)]
    want += [("b", 0, 0, 1, 1, 3), ("b", 0, 4, 1, 5, 6)]
    assert rows(grown) == sorted(want)
    plan = grown._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "Join Cross" not in plan
