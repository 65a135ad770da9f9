"""Files in, files out: annotations, record trees, listings, sinks, incremental runs."""

from __future__ import annotations

import base64
import json

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipgrid import sinks
from clipgrid.operators import resume as W
from clipgrid.operators.joins import attach_existing, filter_existing, lookup_fps
from clipgrid.operators.sampling import number_sentences, pick_key_frames
from clipgrid.operators.spans import union_runs
from clipgrid.schemas import ANNOTATION_STRINGS, ANNOTATION_STRUCTS, GROUNDING, KEY_FRAME, MASK_FRAMES, MASK_SPANS
from clipgrid.session import cut_lineage, ensure_checkpoint_dir
from clipgrid.sinks import compaction
from clipgrid.sinks.compaction import compact
from clipgrid.sources import annotations as N
from clipgrid.sources import media as M
from clipgrid.sources import records as R
from clipgrid.sources import tubes as TB
from clipgrid.sources.listing import walk_files
from clipgrid.streaming.incremental import current_rows, run_incremental, run_stateful


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = content if isinstance(content, bytes) else (content if isinstance(content, str) else json.dumps(content)).encode()
    path.write_bytes(data)


def test_list_annotations_with_text(spark, tmp_path):
    write(tmp_path / "ann.json", [{"vid": "a", "fps": 25.0, "captions": ["x", "y"]}, {"vid": "", "captions": ["z"]}, {"vid": "b", "captions": None}, {"vid": "a", "captions": ["w"]}])
    clips = N.string_captions(N.read_annotations(spark, str(tmp_path), ANNOTATION_STRINGS))
    numbered = number_sentences(clips, order=("ann_pos", "cap_pos"))
    assert rows(numbered.select("vid", "text_query", "video_fps", "sentence_index")) == [("a", "w", 30.0, 3), ("a", "x", 25.0, 1), ("a", "y", 25.0, 2)]


def test_list_annotations_by_line(spark, tmp_path):
    write(tmp_path / "a.jsonl", "\n".join(json.dumps({"vid": str(i), "captions": [f"c{i}"]}) for i in range(5)))
    clips = N.string_captions(N.read_annotations(spark, str(tmp_path), ANNOTATION_STRINGS, lines=True))
    assert clips.count() == 5


STRUCTS = [
    {
        "vid": "a",
        "temporal_gt": {"begin": 1, "end": 9},
        "used_relation": "near",
        "captions": [{"description": "d1", "type": "sub", "target_id": "7"}, {"description": "d2"}],
        "questions": [{"description": "q1", "type": "sub"}],
    },
    {"vid": "b", "questions": [{"description": "q2", "type": "obj"}]},
]


def test_list_annotations_with_structs(spark, tmp_path):
    write(tmp_path / "ann.json", STRUCTS)
    annotations = N.read_annotations(spark, str(tmp_path), ANNOTATION_STRUCTS)
    everything = number_sentences(N.struct_captions(annotations))
    got = rows(everything.select("vid", "sentence_index", "text_query", "is_interrogative", "caption_type"))
    assert got == [("a", 1, "d1", False, "sub"), ("a", 2, "d2", False, None), ("a", 3, "q1", True, "sub"), ("b", 1, "q2", True, "obj")]
    assert N.struct_captions(annotations, "declarative").count() == 2
    assert rows(N.struct_captions(annotations, "both", "sub").select("text_query")) == [("d1",), ("q1",)]
    row = everything.filter("text_query = 'd1'").first()
    assert row["ann_temporal_gt"] == {"begin": 1, "end": 9} and row["ann_target_id"] == "7"
    with pytest.raises(ValueError, match="sentence type"):
        N.struct_captions(annotations, "other")


def test_map_annotations(spark, tmp_path):
    write(tmp_path / "ann.json", {"1_x.mp4": {"caption": "a man", "bbox": [[1, 2]]}, "2_y.mkv": {"caption": ""}, "3.z.mp4": {"English": "e"}})
    maps = N.read_annotation_map(spark, str(tmp_path))
    assert rows(N.map_captions(maps).select("vid", "text_query")) == [("1_x", "a man")]
    assert rows(N.map_captions(maps, "English").select("vid", "text_query")) == [("3.z", "e")]


def test_sentences_are_required(spark):
    df = spark.createDataFrame([("a", " ")], "vid string, text_query string")
    with pytest.raises(Exception, match="text query is empty"):
        N.require_query(df).collect()
    with pytest.raises(ValueError, match="columns: caption"):
        N.caption_column("English", ["caption"])


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "stage1"
    meta = {"text_query": "q", "key_frame_idx": 3}
    for place in ("v/1", "v/2", "v/10", "w", "mixed/1", "mixed"):
        write(root / place / "metadata.json", meta)
        write(root / place / "key_frame.png", b"png")
    write(root / "noimage/1/metadata.json", meta)
    write(root / "noquery/1/metadata.json", {"key_frame_idx": 1})
    write(root / "noquery/1/key_frame.png", b"png")
    write(root / "hollow/metadata.json", meta)
    write(root / "hollow/key_frame.png", b"png")
    write(root / "hollow/5/other.txt", b"x")
    write(root / "with space+plus/1/metadata.json", meta)
    write(root / "with space+plus/1/key_frame.png", b"png")
    return tmp_path


def test_record_scan(spark, tree):
    got = R.read_key_frames(spark, str(tree))
    assert {r["vid"] for r in got.collect()} == {"v_1", "v_2", "v_10", "w", "mixed_1", "with space+plus_1"}
    assert got.filter("vid = 'w'").first()["key_frame_path"] == f"{tree}/stage1/w/key_frame.png"
    assert [r["vid"] for r in R.read_key_frames(spark, str(tree), limit=4).collect()] == ["mixed_1", "v_1", "v_2", "v_10"]


def test_paths_are_placed_without_patterns(spark):
    from itertools import product

    parts = ["stage1", "xstage1", "a", "", "7", "über", "n\nl"]
    paths = ["/".join(p) for n in range(1, 7) for p in product(parts[: 7 if n < 5 else 4], repeat=n)] + ["/x", None]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    pattern = r"(?s)^(.*?)/?stage1/([^/]+)(?:/([^/]+))?/([^/]+)\z"
    part = lambda i: F.regexp_extract("path", pattern, i)
    want = files.select("path", part(1), part(2), F.nullif(part(3), F.lit("")), part(4)).filter(part(2) != "")
    placed = R.place_records(files, "stage1")
    assert placed.columns == ["path", "root", "base_vid", "idx", "name"]
    assert rows(placed) == rows(want) and len(rows(want)) > 100
    deep = files.select(F.concat(F.lit("/r/out/"), "path").alias("path"))
    part = lambda i: F.regexp_extract("path", pattern.replace("stage1", "out/stage1"), i)
    assert rows(R.place_records(deep, "out/stage1")) == rows(deep.select("path", part(1), part(2), F.nullif(part(3), F.lit("")), part(4)).filter(part(2) != ""))
    folder = F.regexp_replace("path", r"(?s)/[^/]*\z", "")
    assert files.filter(~R.folder_of(F.col("path")).eqNullSafe(folder)).count() == 0
    records = files.select("path", F.lit("?").alias("vid"), F.lit("q").alias("text_query"))
    plan = R.scan_key_frames(records, files, limit=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "_salt" not in plan
    # The names are made in a row of their own, so no filter makes the path again on the way to the input.
    assert "stack(1" in plan


def test_preferred_layout(spark):
    records = spark.createDataFrame(
        [("/b/stage1/a/1/metadata.json", "x", "new"), ("/b/p/stage1/a/1/metadata.json", "x", "old"), ("/b/p/stage1/c/2/metadata.json", "x", "old"), ("/b/q/stage1/c/2/metadata.json", "x", "other")],
        "path string, vid string, text_query string",
    )
    images = ["/b/stage1/a/1/key_frame.png", "/b/p/stage1/c/2/key_frame.png"]
    files = records.select("path").union(spark.createDataFrame([(p,) for p in images], "path string"))
    got = R.preferred_records(records, files, ["p"], root="/b")
    assert rows(got.select("vid", "text_query")) == [("a_1", "new"), ("c_2", "old")]


def test_listing_and_inline_images(spark, tmp_path):
    write(tmp_path / "one/b.png", b"\x00" * 100)
    write(tmp_path / "two/b.png", b"other")
    write(tmp_path / "two/c.bmp", b"c")
    roots = [str(tmp_path / "one"), str(tmp_path / "two")]
    catalog = {r["basename"]: r["path"] for r in M.catalog_by_name(M.list_files(spark, roots)).collect()}
    assert catalog == {"b.png": f"{tmp_path}/one/b.png", "c.bmp": f"{tmp_path}/two/c.bmp"}
    images = M.list_files(spark, roots[:1], content=True)
    row = images.select(M.inline_image(F.col("content")).alias("b"), M.mime_type(F.col("path")).alias("m")).first()
    assert base64.b64decode(row["b"]) == b"\x00" * 100 and row["m"] == "image/png" and "\n" not in row["b"]


def frames_in(spark, names, order):
    files = spark.createDataFrame([(f"/d/{n}",) for n in names], "path string")
    return [r["name"] for r in M.order_frames(files, order).orderBy("frame_idx").collect()]


def test_frame_orders(spark):
    names = ["10.jpg", "9.PNG", "f_2_7.jpg", "cover.bmp", "002.jpeg", "notes.txt"]
    assert frames_in(spark, names, "first_number") == ["002.jpeg", "f_2_7.jpg", "9.PNG", "10.jpg", "cover.bmp"]
    assert frames_in(spark, names, "all_digits") == ["002.jpeg", "9.PNG", "10.jpg", "cover.bmp", "f_2_7.jpg"]
    assert frames_in(spark, names, "text") == ["002.jpeg", "10.jpg", "9.PNG", "cover.bmp", "f_2_7.jpg"]
    with pytest.raises(ValueError, match="order"):
        frames_in(spark, names, "size")


def test_clip_media_and_sizes(spark):
    paths = ["/v/a/a.mkv", "/v/a/a.mp4", "/v/b/img/1.jpg", "/v/b/img/2.jpg", "/v/c/other.mp4", "/v/d/d.avi", "/v/d/img/1.jpg"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert rows(M.clip_media(files)) == [("a", "/v/a/a.mp4"), ("b", "/v/b/img"), ("d", "/v/d/d.avi")]
    sizes = spark.createDataFrame([("/v/b/img/1.jpg", 64, 48)], "path string, width int, height int")
    assert rows(M.clip_metadata(files, sizes)) == [("/v/b/img", 2, 64, 48), ("/v/d/img", 1, 0, 0)]
    clips = spark.createDataFrame([("/v/b/img/1.jpg",), ("/x",)], "key_frame_path string")
    assert rows(M.with_image_size(clips, sizes)) == [("/v/b/img/1.jpg", 64, 48), ("/x", 1920, 1080)]


def test_stale_paths(spark):
    files = spark.createDataFrame([("/r1/s/a.mp4", 0), ("/r2/s/a.mp4", 1), ("/r2/s/b.mp4", 1), ("/r1/deep/c.mp4", 0), ("/mnt/z/d.mp4", 2)], "path string, root_rank int")
    wanted = ["/r2/s/a.mp4", "/old/data/s/a.mp4", "/old/data/s/b.mp4", "/gone/c.mp4", "/mnt/data/z/d.mp4", "/none/x.mp4", "", None]
    clips = spark.createDataFrame(list(enumerate(wanted)), "i int, video_path string")
    got = [r["video_path"] for r in M.repair_paths(clips, files, ["/r1", "/r2"]).orderBy("i").collect()]
    assert got == ["/r2/s/a.mp4", "/r1/s/a.mp4", "/r2/s/b.mp4", "/r1/deep/c.mp4", "/mnt/z/d.mp4", "/none/x.mp4", "", None]


def test_tube_states(spark):
    clips = spark.createDataFrame([("a", "p", "v"), ("b", "p", "v"), ("c", "p", "v"), ("d", "p", "other")], "base_vid string, prompt string, video_path string")
    sets = spark.createDataFrame([("a", "p", "v", 1, 2), ("b", "p", "v", 2, 0), ("c", "p", "v", 3, 2), ("d", "p", "v", 4, 2)], "base_vid string, prompt string, video_path string, set_id long, num_tubes int")
    frames = spark.createDataFrame([(1,), (1,), (4,)], "set_id long")
    got = {r["base_vid"]: r["tube_state"] for r in TB.attach_tube_sets(clips, sets, frames).collect()}
    assert got == {"a": "tubes", "b": "zero", "c": "not_found", "d": "not_found"}
    named = spark.createDataFrame([("a", "dog", 1), ("a", "cat", 2), ("a", None, 3), ("b", None, 4)], "base_vid string, object_name string, set_id long")
    assert rows(TB.find_tube_set(named).select("base_vid", "set_id")) == [("a", 2), ("b", 4)]
    assert rows(TB.find_tube_set(named, "dog").select("set_id")) == [(1,)]


def test_joins_with_files_and_rates(spark):
    files = spark.createDataFrame([("/m/1",)], "path string")
    df = spark.createDataFrame([("1",), ("2",)], "i string")
    path = F.concat(F.lit("/m/"), "i")
    assert rows(attach_existing(df, files, path, "mask_path")) == [("1", "/m/1"), ("2", None)]
    assert rows(filter_existing(df.withColumn("p", path), files, "p").select("i")) == [("1",)]
    stated = spark.createDataFrame([("1", 0, 10.0), ("1", 1, None), ("2", 0, 5.0), ("2", 1, 6.0)], "vid string, pos int, fps double")
    clips = spark.createDataFrame([("1",), ("2",), ("3",)], "vid string")
    assert rows(lookup_fps(clips, stated, "pos")) == [("1", 30.0), ("2", 6.0), ("3", 30.0)]
    assert rows(lookup_fps(clips, stated, "pos", last_wins=False)) == [("1", 10.0), ("2", 5.0), ("3", 30.0)]


def test_resume_policies(spark):
    clips = spark.createDataFrame([(v,) for v in "abcde"], "vid string")
    files = spark.createDataFrame([("a", n) for n in W.KEY_FRAME_FILES] + [("b", "metadata.json"), ("b", "metadata.json"), ("b", "key_frame.png")], "vid string, name string")
    assert rows(W.drop_finished_key_frames(clips, files, ["vid"])) == [(v,) for v in "bcde"]
    outcomes = spark.createDataFrame([("a", "success", 3), ("b", "success", 0), ("c", "failed", 0), ("d", None, 2)], "vid string, status string, num_masks int")
    assert rows(W.drop_by_status(clips, outcomes)) == [("b",), ("e",)]
    assert rows(W.drop_by_status(clips, outcomes, retry_failed=True)) == [("b",), ("c",), ("e",)]
    assert rows(W.drop_then_limit(clips, 1, outcomes)) == [("b",)]
    done = spark.createDataFrame([("a", True), ("b", True), ("c", None)], "vid string, success boolean")
    masks = spark.createDataFrame([("a",), ("c",)], "vid string")
    assert rows(W.drop_succeeded(clips, done, masks)) == [(v,) for v in "bcde"]
    order = spark.createDataFrame([("v_10",), ("v_9",), ("v_x",), ("a",)], "vid string")
    assert [r[0] for r in W.take_first(order, 4).collect()] == ["a", "v_x", "v_9", "v_10"]
    assert [r[0] for r in W.take_first(order, 4, numeric=False).collect()] == ["a", "v_10", "v_9", "v_x"]


def test_batches(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("vid"))
    sizes = W.request_batches(df, 16, buckets=4).groupBy("bucket", "batch_id").count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) == 16
    for bucket in range(4):
        part = sorted((r["batch_id"], r["count"]) for r in sizes if r["bucket"] == bucket)
        assert [b for b, _ in part] == list(range(len(part))) and all(c == 16 for _, c in part[:-1])


def test_grounding_sink(spark, tmp_path):
    data = [("v_1", "q", None, "m", True, (1, 2, 3, 4), 0.5, None, None, None, None, {"mask_coverage": 1.0}), ("v_2", "é", None, "m", False, None, None, None, None, None, "x", {})]
    df = spark.createDataFrame(data, GROUNDING)
    sinks.write_grounding(df, str(tmp_path / "g"))
    text = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert all(list(t) == [*GROUNDING.fieldNames(), "run"] for t in text)
    assert sorted(map(str, R.read_grounding(spark, str(tmp_path / "g")).collect())) == sorted(map(str, df.collect()))


def test_a_forced_rerun_replaces_rows(spark, tmp_path):
    rows_of = lambda ok: [(f"v_{i}", "q", None, "m", ok, None, None, None, None, None, None, {}) for i in range(5)]
    for ok in (False, True):
        sinks.write_grounding(spark.createDataFrame(rows_of(ok), GROUNDING), str(tmp_path / "g"))
        sinks.write_outcomes(spark.createDataFrame([(f"v_{i}", ok) for i in range(5)], "vid string, success boolean"), str(tmp_path / "o"), "s")
    assert [r["success"] for r in R.read_grounding(spark, str(tmp_path / "g")).collect()] == [True] * 5
    assert [r["success"] for r in R.read_outcomes(spark, str(tmp_path / "o")).collect()] == [True] * 5
    sets = spark.createDataFrame([(1, "dog", None, "v")], "set_id long, prompt string, object_name string, video_path string")
    for tubes in (3, 2):
        frames = spark.createDataFrame([("v_1", t, 0, 4, 4, 1) for t in range(tubes)], "vid string, tube_id long, frame_idx long, height long, width long, set_id long")
        sinks.write_tube_sets(sets, frames, str(tmp_path / "t"), run=9 - tubes)
    header, tubes = R.read_tube_sets(spark, str(tmp_path / "t"))
    assert header.first()["num_tubes"] == 2 and tubes.count() == 2


def test_a_hot_video_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        frames = spark.range(200_000).select(F.lit("v_1").alias("vid"), F.col("id").alias("frame_idx"), F.lit(4).alias("height"), F.lit(4).alias("width"))
        sinks.write_masks(frames.repartition(8), spark.createDataFrame([("v_1", 0, 0, 0, 1)], "vid string, frame_idx long, y long, x0 long, x1 long"), str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "m/mask_frames").glob("*/part-*"))) > 4
    assert spark.read.parquet(str(tmp_path / "m/mask_frames")).count() == 200_000


def test_clips_without_media_fail_and_stay(spark):
    from clipgrid.plans.propagation import propagate

    keys = spark.createDataFrame(
        [("a_1", "/a", "dog", "q", 0, 0), ("b_1", None, "dog", "q", 0, 0), ("c_1", "/c", "dog", "q", 0, 0)],
        "vid string, video_path string, target_object string, text_query string, original_frame_idx long, key_frame_idx long",
    )
    box = spark.createDataFrame([(v, True, (0, 0, 2, 2), None) for v in ("a_1", "b_1", "c_1")], "vid string, success boolean, bbox struct<xmin:int,ymin:int,xmax:int,ymax:int>, answer string")
    media = spark.createDataFrame([("/a", 3, 4, 4)], "video_path string, num_frames long, height long, width long")
    sets = spark.createDataFrame([], "set_id long, base_vid string, prompt string, video_path string, num_tubes int")
    frames = spark.createDataFrame([], "set_id long, tube_id long, frame_idx long, height long, width long")
    spans = spark.createDataFrame([], "set_id long, tube_id long, frame_idx long, y long, x0 long, x1 long")
    found = propagate(keys, box, media, sets, frames, spans, "relative", 0.2).outcomes
    got = {r["vid"]: (r["method"], r["failure_reason"], r["num_masks"]) for r in found.collect()}
    assert got == {"a_1": ("box_propagation", None, 3), "b_1": ("no_output", "video_not_found", 0), "c_1": ("no_output", "video_not_found", 0)}


def test_clips_share_a_set_and_its_tubes_are_not_copied(spark):
    from clipgrid.plans.propagation import propagate

    # Two sentences pick the same tube, one the other, one none and is held, one has an empty box.
    picks = [("v_1", 0, (0, 0, 3, 3)), ("v_2", 1, (0, 0, 3, 3)), ("v_3", 0, (5, 5, 8, 8)), ("v_4", 0, (3, 3, 4, 5)), ("v_5", 0, (0, 0, 0, 0))]
    keys = spark.createDataFrame(
        [(v, "/v", "dog", "q", f, 0) for v, f, _ in picks], "vid string, video_path string, target_object string, text_query string, original_frame_idx long, key_frame_idx long"
    )
    boxes = spark.createDataFrame([(v, True, b, None) for v, _, b in picks], "vid string, success boolean, bbox struct<xmin:int,ymin:int,xmax:int,ymax:int>, answer string")
    media = spark.createDataFrame([("/v", 40, 9, 9)], "video_path string, num_frames long, height long, width long")
    sets = spark.createDataFrame([(7, "v", "dog", "/v", 2), (3, "v", "dog", "/v", 2)], "set_id long, base_vid string, prompt string, video_path string, num_tubes int")
    frames = [(7, 0, f, 9, 9) for f in range(30)] + [(7, 1, f, 9, 9) for f in range(3)] + [(3, 0, 0, 9, 9)]
    spans = [(7, 0, f, y, 0, 2) for f in range(29) for y in (0, 1)] + [(7, 1, f, 6, 5, 8) for f in range(3)] + [(3, 0, 0, 0, 0, 9)]
    found = propagate(
        keys, boxes, media, sets,
        spark.createDataFrame(frames, "set_id long, tube_id long, frame_idx long, height long, width long"),
        union_runs(spark.createDataFrame(spans, "set_id long, tube_id long, frame_idx long, y long, x0 long, x1 long"), ["set_id", "tube_id", "frame_idx"]),
        "relative", 0.5,
    )
    tube = {"v_1": 0, "v_2": 0, "v_3": 1}
    want_frames = [(v, f[2], 9, 9) for v, t in tube.items() for f in frames if f[:2] == (7, t)]
    want_spans = [(v, *s[2:]) for v, t in tube.items() for s in spans if s[:2] == (7, t)]
    held = {r["vid"] for r in found.outcomes.filter("method = 'box_propagation'").collect()}
    assert "v_4" in held and not held & set(tube)
    assert rows(found.frames) == sorted(want_frames + [(v, f, 9, 9) for v in held for f in range(40)])
    assert rows(found.spans.filter("vid <> 'v_5'")) == sorted(want_spans + [("v_4", f, y, 3, 4) for f in range(40) for y in (3, 4)])
    assert {r["vid"]: r["selected_tube_id"] for r in found.outcomes.collect()} == {"v_4": None, "v_5": None, **tube}
    for side in (found.frames, found.spans):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "_salt" not in plan and "Join Cross" not in plan


def test_sentence_numbers_do_not_follow_the_packing_of_files(spark, tmp_path):
    schema = T.StructType([T.StructField("vid", T.StringType()), T.StructField("captions", T.ArrayType(T.StringType())), T.StructField("fps", T.DoubleType())])
    for name in ("a", "b"):
        lines = [json.dumps({"vid": "v", "captions": [f"{name}{i}"], "fps": 1.0}) for i in range(300)]
        write(tmp_path / f"ann/{name}.json", "\n".join(lines))
    found = []
    for size in ("1m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            clips = N.string_captions(N.read_annotations(spark, str(tmp_path / "ann"), schema, lines=True))
            found.append({r["text_query"]: r["sentence_index"] for r in number_sentences(clips).collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == {f"{n}{i}": 300 * (n == "b") + i + 1 for n in "ab" for i in range(300)}


def test_clip_metadata_by_number(spark):
    names = ["10.jpg", "2.jpg", "1.bmp"]
    files = spark.createDataFrame([(f"/v/a/{n}",) for n in names] + [("/v/b/x.png",), ("/v/b/10.png",)], "path string")
    sizes = spark.createDataFrame([("/v/a/2.jpg", 2, 2), ("/v/a/1.bmp", 1, 1), ("/v/b/10.png", 9, 9)], "path string, width int, height int")
    assert rows(M.clip_metadata(files, sizes, "number")) == [("/v/a", 2, 2, 2), ("/v/b", 2, 9, 9)]
    assert rows(M.clip_metadata(files, sizes, "text")) == [("/v/a", 3, 1, 1), ("/v/b", 2, 9, 9)]


def test_key_frame_sink(spark, tmp_path):
    row = ("v_1", "v.mp4", "q", "dog", 3, 90, 10, 0.5, 3.0, 1, {}, "", "", "seg")
    sinks.write_key_frames(spark.createDataFrame([row], KEY_FRAME), str(tmp_path / "k"))
    got = spark.read.parquet(str(tmp_path / "k")).first()
    assert got["ann_temporal_gt"] is None and got["ann_used_relation"] is None
    assert got["ann_used_segment"] == "seg" and got["ann_target_id"] == ""


def test_mask_and_tube_sinks(spark, tmp_path):
    frames = spark.createDataFrame([("v_1", t, f, 4, 4) for t in range(2) for f in range(3)], MASK_FRAMES)
    spans = spark.createDataFrame([("v_1", 0, 0, 1, 0, 2)], MASK_SPANS)
    sinks.write_masks(frames, spans, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/mask_frames")).count() == 6
    assert rows(spark.read.parquet(str(tmp_path / "m/mask_spans")).drop("bucket")) == rows(spans)
    sets = spark.createDataFrame([(1, "A Dog!", None, "v"), (2, "cat", "named", "v")], "set_id long, prompt string, object_name string, video_path string")
    keyed = frames.withColumn("set_id", F.lit(1).cast("long"))
    sinks.write_tube_sets(sets, keyed, str(tmp_path / "t"))
    header = {r["set_id"]: r for r in spark.read.parquet(str(tmp_path / "t/tube_sets")).collect()}
    assert (header[1]["object_name"], header[1]["num_tubes"], header[1]["num_masks"]) == ("a_dog", 2, 6)
    assert (header[2]["object_name"], header[2]["num_tubes"]) == ("named", 0)
    assert spark.read.parquet(str(tmp_path / "t/tubes")).count() == 2


def test_outcome_sink_and_summary(spark, tmp_path):
    outcomes = spark.createDataFrame([("a", "success", 3)], "vid string, status string, num_masks int")
    sinks.write_outcomes(outcomes, str(tmp_path / "o"), "propagation")
    got = spark.read.parquet(str(tmp_path / "o")).first()
    assert got["stage"] == "propagation" and got["ts"] is not None
    key_frames = spark.createDataFrame([("a", "q", 3, 9), ("b", "r", 1, 2)], "vid string, text_query string, key_frame_idx int, num_sampled_frames int")
    masks = spark.createDataFrame([("a", 0), ("a", 1)], "vid string, frame_idx int")
    ends = spark.createDataFrame([("a", True, None)], "vid string, success boolean, error_message string")
    got = {r["vid"]: json.loads(r["summary"]) for r in sinks.run_summaries(key_frames, masks, ends).collect()}
    assert got["a"] == {"video_id": "a", "text_query": "q", "key_frame_idx": 3, "num_frames": 9, "num_masks": 2, "success": True, "error_message": None}
    assert got["b"]["success"] is False and got["b"]["num_masks"] == 0


def test_incremental_runs_see_each_file_once(spark, tmp_path):
    schema = T.StructType([T.StructField("vid", T.StringType()), T.StructField("n", T.LongType())])
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def process(batch):
        return batch.withColumn("twice", F.col("n") * 2)

    write(tmp_path / "in/1.json", '{"vid": "a", "n": 1}\n{"vid": "b", "n": 2}')
    assert run_incremental(spark, source, schema, process, out, state) == 1
    assert run_incremental(spark, source, schema, process, out, state) == 0
    write(tmp_path / "in/2.json", '{"vid": "c", "n": 3}')
    write(tmp_path / "in/3.json", '{"vid": "d", "n": 4}')
    assert run_incremental(spark, source, schema, process, out, state, max_files=1) == 2
    assert rows(spark.read.parquet(out).select("vid", "twice")) == [("a", 2), ("b", 4), ("c", 6), ("d", 8)]


def test_walk_lists_every_file_once(spark, tmp_path):
    names = ["a.png", "deep/er/and/deeper/b.png", "deep/c.txt", "deep/er/empty.png", "sp ace/ü+%41.png", "other/_x.png", "_hidden/y.png", ".z/w.png"]
    for root in ("one", "two"):
        for n in names[: 8 if root == "one" else 3]:
            write(tmp_path / root / n, "" if "empty" in n else n)
    (tmp_path / "one/no/files").mkdir(parents=True)
    roots = [str(tmp_path / r) for r in ("one", "two", "missing")]
    found = rows(walk_files(spark, roots))
    want = [(str(tmp_path / r / n), 0 if "empty" in n else len(n.encode()), i) for i, r in enumerate(("one", "two")) for n in names[: 5 if r == "one" else 3]]
    assert found == sorted(want)
    assert rows(walk_files(spark, [f"file://{r}/" for r in roots], ["*.txt"])) == [r for r in sorted(want) if r[0].endswith(".txt")]
    listed = M.list_files(spark, roots[:2]).select("path", "length", "root_rank")
    assert rows(listed) == [r for r in sorted(want) if r[1]]  # Spark's own listing leaves empty files out


def _totals(events):
    """Per clip: number of samples, best score, and the first sample that has it."""
    found = {}
    for vid, sample, score in events:
        found.setdefault(vid, []).append((score, -sample))
    return sorted((vid, len(own), max(own)[0], -max(own)[1]) for vid, own in found.items())


def test_totals_live_across_batches_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    schema = "vid string, sample_idx long, score double"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    waves = [
        [[("a", 1, 0.5), ("b", 2, 0.1)], [("a", 3, 0.5)]],
        [[("a", 0, 0.5), ("c", 4, 0.9)], [("b", 5, 0.7)], [("b", 6, 0.2)]],
        [[("c", 7, 1.0)]],
    ]

    def run():
        return run_stateful(spark, source, schema, lambda s: pick_key_frames(s, carry=()), out, state, max_files=1)

    def seen(upto=None):
        found = current_rows(spark, out, ["vid"], upto)
        return rows(found.select("vid", "num_sampled_frames", "max_similarity", "key_frame_idx"))

    so_far, batch, history = [], -1, []
    for w, wave in enumerate(waves):
        for f, events in enumerate(wave):
            write(tmp_path / f"in/{w}{f}.json", "\n".join(json.dumps(dict(zip(("vid", "sample_idx", "score"), e, strict=True))) for e in events))
        before = batch
        ran = run()
        so_far += [e for events in wave for e in events]
        batch = ran[-1]
        assert len(ran) >= len(wave) and ran[0] == before + 1
        assert seen() == _totals(so_far)
        history.append((batch, _totals(so_far)))
    assert all(seen(upto) == want for upto, want in history)
    assert run() == []
    for f in (tmp_path / f"state/commits/{batch}", tmp_path / f"state/commits/.{batch}.crc"):
        f.unlink(missing_ok=True)  # as if the job had been lost after it wrote its rows
    assert batch in run()
    assert seen() == _totals(so_far)


def _stored_files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("part-*")}


def test_compaction_leaves_one_row_per_clip(spark, tmp_path):
    path = tmp_path / "outcomes"
    clips = spark.range(60).select(F.concat(F.lit("v"), "id").alias("vid"), F.col("id"))
    for run in range(10):
        done = clips.filter(F.col("id") % (run + 1) == 0).select("vid", F.lit(f"run {run}").alias("reason"))
        sinks.write_outcomes(done, str(path), "a", run=run, buckets=4)
    before = rows(R.read_outcomes(spark, str(path)).select("vid", "reason"))
    assert spark.read.parquet(str(path)).count() > 150
    assert compact(spark, str(path), ["vid", "stage"]) == [0, 1, 2, 3]
    assert spark.read.parquet(str(path)).count() == 60
    assert rows(R.read_outcomes(spark, str(path)).select("vid", "reason")) == before
    assert compact(spark, str(path), ["vid", "stage"]) == []

    one = clips.filter("vid = 'v7'").select("vid", F.lit("late").alias("reason"))
    sinks.write_outcomes(one, str(path), "a", run=99, buckets=4)
    assert dict(rows(R.read_outcomes(spark, str(path)).select("vid", "reason")))["v7"] == "late"


def test_compaction_touches_changed_buckets_only_and_fails_whole(spark, tmp_path, monkeypatch):
    path = tmp_path / "tubes"
    table = spark.createDataFrame([(f"v{i}", i, i % 4) for i in range(40)], "vid string, n int, bucket int")
    for run, part in enumerate((table, table.filter("bucket = 2"))):
        part.withColumn("run", F.lit(run).cast("long")).write.mode("append").partitionBy("bucket").parquet(str(path))
    before = _stored_files(path)
    failing = lambda df, *rest: swap(df.withColumn("n", F.raise_error(F.lit("lost")).cast("int")), *rest)
    swap = compaction.swap_buckets
    monkeypatch.setattr(compaction, "swap_buckets", failing)
    with pytest.raises(Exception, match="lost"):
        compact(spark, str(path), ["vid"])
    assert _stored_files(path) == before and spark.read.parquet(str(path)).count() == 50
    monkeypatch.setattr(compaction, "swap_buckets", swap)
    assert compact(spark, str(path), ["vid"], many=True) == [2]
    after = _stored_files(path)
    assert {f: t for f, t in after.items() if "bucket=2" not in f} == {f: t for f, t in before.items() if "bucket=2" not in f}
    assert rows(spark.read.parquet(str(path)).select("vid", "n", "bucket")) == rows(table)
    assert compact(spark, str(path), ["vid"]) == []


def test_stored_tables_meet_without_a_shuffle(spark, tmp_path):
    clips = spark.range(300).select(F.concat(F.lit("v"), "id").alias("vid"), F.col("id").alias("n"))
    done = clips.filter("n % 3 = 0").select("vid", (F.col("n") % 2 == 0).alias("success"))
    have = clips.filter("n % 4 = 0").select("vid")
    stored = [sinks.tables.store_by_key(t, f"resume_{n}", str(tmp_path / n), buckets=4) for n, t in (("clips", clips), ("done", done), ("have", have))]
    stored[1] = sinks.tables.store_by_key(spark.createDataFrame([("v1", True)], "vid string, success boolean"), "resume_done", str(tmp_path / "done"), buckets=4)
    added = done.unionByName(spark.createDataFrame([("v1", True)], "vid string, success boolean"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for own, plain in ((W.drop_grounded(*stored[:2]), W.drop_grounded(clips, added)), (W.drop_succeeded(*stored), W.drop_succeeded(clips, added, have))):
            plan = own._jdf.queryExecution().executedPlan().toString()
            assert "LeftAnti" in plan and "Exchange" not in plan
            assert rows(own) == rows(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("clips", "done", "have"):
            spark.sql(f"DROP TABLE resume_{n}")


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    cut = cut_lineage(df)
    assert rows(cut) == rows(df) and cut.schema.names == df.schema.names
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
