"""Column layouts of the tables that flow between the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("xmin", "ymin", "xmax", "ymax")])

KEY_FRAME = T.StructType(
    [
        T.StructField("vid", T.StringType()),
        T.StructField("video_path", T.StringType()),
        T.StructField("text_query", T.StringType()),
        T.StructField("target_object", T.StringType()),
        T.StructField("key_frame_idx", T.LongType()),
        T.StructField("original_frame_idx", T.LongType()),
        T.StructField("num_sampled_frames", T.LongType()),
        T.StructField("max_similarity", T.DoubleType()),
        T.StructField("sampling_fps", T.DoubleType()),
        T.StructField("sentence_index", T.LongType()),
        T.StructField("ann_temporal_gt", T.MapType(T.StringType(), T.LongType())),
        T.StructField("ann_target_id", T.StringType()),
        T.StructField("ann_used_relation", T.StringType()),
        T.StructField("ann_used_segment", T.StringType()),
    ]
)

# The twelve columns of a grounding row, in the order readers expect.
GROUNDING_COLUMNS = (
    "vid",
    "text_query",
    "target_object",
    "method",
    "success",
    "bbox",
    "confidence",
    "answer",
    "mask_path",
    "raw_output",
    "failure_reason",
    "extras",
)

_NOT_TEXT = {
    "success": T.BooleanType(),
    "bbox": BOX,
    "confidence": T.DoubleType(),
    "extras": T.MapType(T.StringType(), T.DoubleType()),
}
GROUNDING = T.StructType([T.StructField(c, _NOT_TEXT.get(c, T.StringType())) for c in GROUNDING_COLUMNS])

# What a scorer returns for one row; everything else of the grounding row is filled in by the job.
RAW_GROUNDING = T.StructType(
    [
        T.StructField("vid", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("bbox", BOX),
        T.StructField("box_similarity", T.DoubleType()),
        T.StructField("mask_similarity", T.DoubleType()),
        T.StructField("mask_coverage", T.DoubleType()),
        T.StructField("failure_reason", T.StringType()),
    ]
)

# What a propagation row must have.
PROPAGATION_REQUIRED = ("vid", "video_path", "key_frame_idx", "bbox", "key_frame_path")

MASK_KEYS = ("vid", "tube_id", "frame_idx")

MASK_SPANS = T.StructType(
    [
        T.StructField("vid", T.StringType()),
        T.StructField("tube_id", T.LongType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("y", T.LongType()),
        T.StructField("x0", T.LongType()),
        T.StructField("x1", T.LongType()),
    ]
)

MASK_FRAMES = T.StructType(
    [
        T.StructField("vid", T.StringType()),
        T.StructField("tube_id", T.LongType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("width", T.LongType()),
    ]
)

CAPTION = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("target_id", T.StringType()),
    ]
)

ANNOTATION_STRINGS = T.StructType(
    [
        T.StructField("vid", T.StringType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("captions", T.ArrayType(T.StringType())),
    ]
)

ANNOTATION_STRUCTS = T.StructType(
    [
        T.StructField("vid", T.StringType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("temporal_gt", T.MapType(T.StringType(), T.LongType())),
        T.StructField("used_relation", T.StringType()),
        T.StructField("used_segment", T.StringType()),
        T.StructField("captions", T.ArrayType(CAPTION)),
        T.StructField("questions", T.ArrayType(CAPTION)),
    ]
)
