"""Contracts between the steps: boxes, grounding rows, joined rows, registries."""

from __future__ import annotations

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from clipgrid.functions import boxes as B
from clipgrid.functions import choices as C
from clipgrid.operators.joins import propagation_inputs
from clipgrid.operators.scoring import Plugin, Registry, grounding_rows, run_propagators, run_scorers
from clipgrid.operators.validate import propagation_error, require_valid, split_valid
from clipgrid.plans.grounding import ground
from clipgrid.schemas import BOX, GROUNDING_COLUMNS, RAW_GROUNDING
from clipgrid.sources.records import typed_grounding

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_box_truncates_and_measures(spark):
    box = B.box_of(F.lit(12.9), F.lit(34.0), F.lit(56.2), F.lit("78"))
    row = one(spark, box.alias("b"), B.box_width(box).alias("w"), B.box_height(box).alias("h"), B.box_area(box).alias("a"))
    assert tuple(row["b"]) == (12, 34, 56, 78)
    assert (row["w"], row["h"], row["a"]) == (44, 44, 1936)


def test_inverted_box_is_an_error(spark):
    box = B.box_of(F.lit(5), F.lit(0), F.lit(4), F.lit(9))
    assert one(spark, B.box_error(box).alias("e"))["e"] == "inverted box"
    with pytest.raises(Exception, match="inverted box"):
        one(spark, B.checked_box(box).alias("b"))


def test_box_from_array(spark):
    array = F.array(*[F.lit(v) for v in (1, 2, 3, 4)])
    assert tuple(one(spark, B.box_of_array(array).alias("b"))["b"]) == (1, 2, 3, 4)
    assert one(spark, B.box_of_array(F.lit(None).cast("array<int>")).alias("b"))["b"] is None
    with pytest.raises(Exception, match="four box coordinates"):
        one(spark, B.box_of_array(F.array(F.lit(1), F.lit(2))).alias("b"))


def test_missing_coordinates_are_named(spark):
    none = F.lit(None).cast("int")
    row = one(spark, B.missing_sides(F.lit(1), none, F.lit(2), none).alias("m"), B.box_of(F.lit(1), none, F.lit(2), none).alias("b"))
    assert row["m"] == "ymin, ymax"
    assert row["b"] is None


def test_unknown_coordinate_mode(spark):
    box = B.box_of(F.lit(1), F.lit(1), F.lit(2), F.lit(2))
    with pytest.raises(Exception, match="unknown coordinate mode"):
        one(spark, B.decode_coordinates(box, F.lit(10), F.lit(10), "other").alias("b"))


def test_grounding_has_the_twelve_columns_in_order(spark):
    assert len(GROUNDING_COLUMNS) == 12
    records = spark.createDataFrame([("v_1", "a dog", "dog")], "vid string, text_query string, target_object string")
    raw = spark.createDataFrame([], RAW_GROUNDING)
    assert tuple(grounding_rows(records, raw, "m").columns) == GROUNDING_COLUMNS


@pytest.fixture
def records(spark):
    data = [("a_1", "a dog", "dog", "/m/a"), ("b_1", "a cat", "cat", None), ("c_1", "a cow", "cow", "/m/c")]
    return spark.createDataFrame(data, "vid string, text_query string, target_object string, mask_path string")


def test_success_row(spark, records):
    raw = spark.createDataFrame([("a_1", True, (1, 2, 30, 40), 0.81, 0.75, 12.3, "ignored")], RAW_GROUNDING)
    row = grounding_rows(records, raw, "m").filter("vid = 'a_1'").first()
    assert row["success"] and tuple(row["bbox"]) == (1, 2, 30, 40) and row["confidence"] == 0.81
    assert row["extras"] == {"clip_box_similarity": 0.81, "clip_mask_similarity": 0.75, "mask_coverage": 12.3}
    assert row["mask_path"] == "/m/a" and row["failure_reason"] is None and row["method"] == "m"
    assert row["answer"] is None and row["raw_output"] is None


def test_failure_rows(spark, records):
    raw = spark.createDataFrame([("a_1", False, (1, 2, 3, 4), 0.9, None, None, "subject_not_found")], RAW_GROUNDING)
    got = {r["vid"]: r for r in grounding_rows(records, raw, "m").collect()}
    assert got["a_1"]["failure_reason"] == "subject_not_found"
    assert got["b_1"]["failure_reason"] == "scorer_failed"
    for row in got.values():
        assert row["success"] is False and row["bbox"] is None and row["confidence"] is None
        assert row["mask_path"] is None and row["extras"] == {}


def test_confidence_falls_back_to_the_mask(spark, records):
    raw = spark.createDataFrame([("a_1", True, (1, 2, 3, 4), None, 0.75, None, None)], RAW_GROUNDING)
    assert grounding_rows(records, raw, "m").filter("vid = 'a_1'").first()["confidence"] == 0.75


def test_sparse_grounding_defaults(spark):
    text = '{"vid": "v_1", "text_query": "q", "bbox": {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}}'
    from clipgrid.schemas import GROUNDING

    parsed = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", GROUNDING).alias("r")).select("r.*")
    row = typed_grounding(parsed).first()
    assert row["success"] is False and row["method"] == "unknown" and row["extras"] == {}
    assert tuple(row["bbox"]) == (1, 2, 3, 4)


def test_json_round_trip(spark, records):
    from clipgrid.schemas import GROUNDING

    raw = spark.createDataFrame([("a_1", True, (1, 2, 30, 40), 0.81, 0.75, 12.3, None)], RAW_GROUNDING)
    before = grounding_rows(records, raw, "m")
    text = before.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("t"))
    after = typed_grounding(text.select(F.from_json("t", GROUNDING).alias("r")).select("r.*"))
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


KEY_FRAMES = "vid string, video_path string, key_frame_path string, original_frame_idx long, key_frame_idx long"
GROUNDED = "vid string, text_query string, target_object string, answer string, success boolean, method string"


def joined(spark, key_frame, box=(12, 34, 56, 78), answer=None, target="dog"):
    left = spark.createDataFrame([key_frame], KEY_FRAMES)
    right = spark.createDataFrame([(key_frame[0], "where is it?", target, answer, True, "m")], GROUNDED)
    return propagation_inputs(left, right.withColumn("bbox", F.lit(box).cast(BOX) if box is None else F.struct(
        *[F.lit(v).alias(n) for v, n in zip(box, B.SIDES)])))


def test_original_frame_is_preferred(spark):
    assert joined(spark, ("v_1", "v.mp4", "k.png", 128, 42)).first()["key_frame_idx"] == 128
    assert joined(spark, ("v_1", "v.mp4", "k.png", None, 42)).first()["key_frame_idx"] == 42


@pytest.mark.parametrize(
    ("answer", "target", "expected"), [("boy", "dog", "boy"), ("", "dog", "dog"), (None, None, "where is it?"), ("", "", "where is it?")]
)
def test_prompt_order(spark, answer, target, expected):
    assert joined(spark, ("v_1", "v.mp4", "k.png", 1, 2), answer=answer, target=target).first()["prompt"] == expected


def test_missing_fields_are_all_named(spark):
    rows = joined(spark, ("v_1", None, " ", None, None), box=None)
    error = rows.select(propagation_error(rows).alias("e")).first()["e"]
    assert error == "video_path, key_frame_idx, bbox, key_frame_path"
    with pytest.raises(Exception, match="v_1: missing or invalid video_path, key_frame_idx"):
        require_valid(rows, propagation_error(rows)).collect()


def test_box_may_be_optional(spark):
    rows = joined(spark, ("v_1", "v.mp4", "k.png", 1, 2), box=None)
    good, bad = split_valid(rows, propagation_error(rows))
    assert (good.count(), bad.first()["error"]) == (0, "bbox")
    good, bad = split_valid(rows, propagation_error(rows, require_bbox=False))
    assert (good.count(), bad.count()) == (1, 0)


def test_join_needs_both_sides(spark):
    left = spark.createDataFrame([("v_1", "v.mp4", "k.png", 1, 2)], KEY_FRAMES)
    right = spark.createDataFrame([("w_1", "q", None, None, True, "m")], GROUNDED).withColumn("bbox", F.lit(None).cast(BOX))
    assert propagation_inputs(left, right).count() == 0


def test_prompt_by_type(spark):
    def pick(kind, target, answer, override=None):
        column = C.prompt_by_type(
            F.lit(kind), F.lit(target), F.lit(answer), F.lit("query"), override=None if override is None else F.lit(override)
        )
        return one(spark, column.alias("p"))["p"]

    assert pick("declarative", "dog", "boy") == "dog"
    assert pick("interrogative", "dog", "boy") == "boy"
    assert pick("interrogative", "dog", None) == "query"
    assert pick("declarative", "dog", None, " cat ") == "cat"
    assert pick("declarative", "dog", None, "  ") == "dog"


def _ok(model, rows):
    return pd.DataFrame({"vid": rows["vid"], "success": True, "box_similarity": model})


def test_registry_lists_what_it_knows(spark, records):
    registry = Registry({"b": Plugin(_ok), "a": Plugin(_ok)})
    assert registry.names() == ("a", "b")
    with pytest.raises(ValueError, match="unknown method 'x'; available: a, b"):
        registry.get("x")
    with pytest.raises(ValueError, match="available: a, b"):
        ground(records, registry, "x")
    with pytest.raises(Exception, match="unknown method x; available: a, b"):
        run_scorers(records.withColumn("method", F.lit("x")), registry).collect()
    with pytest.raises(Exception, match="unknown method nope"):
        run_propagators(records.withColumn("backend", F.lit("nope")), registry).collect()


def test_finished_records_are_not_scored(spark, records):
    registry = Registry({"m": Plugin(_ok, load=lambda: 0.5)})
    done = spark.createDataFrame([("a_1",)], "vid string")
    assert {r["vid"] for r in ground(records, registry, "m", done).collect()} == {"b_1", "c_1"}
    assert ground(records, registry, "m", done, force=True).count() == 3
    # The limit comes before the finished ones are removed.
    assert {r["vid"] for r in ground(records, registry, "m", done, limit=2).collect()} == {"b_1"}
    assert ground(records, registry, "m", limit=2).count() == 2


def test_models_are_closed_and_errors_stay_with_their_row(spark, records, tmp_path):
    marker = str(tmp_path / "closed")

    def close(model):
        with open(marker, "a") as f:
            f.write("x")

    def score(model, rows):
        if (rows["vid"] == "b_1").any():
            raise RuntimeError("no such frame")
        return _ok(model, rows)

    registry = Registry({"m": Plugin(score, load=lambda: 0.5, close=close)})
    got = {r["vid"]: r for r in ground(records, registry, "m").collect()}
    assert got["b_1"]["failure_reason"] == "no such frame"
    assert got["a_1"]["success"] and got["c_1"]["confidence"] == 0.5
    assert 1 <= len(open(marker).read()) <= 3


def test_propagator_may_yield_nothing(spark):
    clips = spark.createDataFrame([("a", 3), ("b", 0)], "vid string, n int").withColumn("backend", F.lit("p"))

    def apply(model, rows):
        row = rows.iloc[0]
        for frame in range(row["n"]):
            yield pd.DataFrame({"vid": [row["vid"]], "frame_idx": [frame], "y": [0], "x0": [0], "x1": [2]})

    got = run_propagators(clips, Registry({"p": Plugin(apply)})).collect()
    assert sorted((r["vid"], r["frame_idx"]) for r in got) == [("a", 0), ("a", 1), ("a", 2)]
