"""Annotation files as one row per sentence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipgrid.functions.names import file_stem
from clipgrid.functions.text import is_blank
from clipgrid.operators.sampling import SOURCE_FPS
from clipgrid.sources.json_ranges import json_elements


def read_annotations(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """List-form annotations with their position in the input.

    Files hold one JSON array each, of any size: byte ranges are parsed side by side. With ``lines`` they hold one object per
    line. Rows are ordered by file, block and position.
    """
    if not lines:
        elements = json_elements(spark, path).select(F.from_json("text", schema).alias("_row"), "file", "number")
        return elements.select("_row.*", F.col("file").alias("ann_file"), F.lit(0).cast("long").alias("ann_block"), F.col("number").alias("ann_pos"))
    return spark.read.schema(schema).json(path).select(
        "*",
        F.col("_metadata.file_path").alias("ann_file"),
        F.col("_metadata.file_block_start").alias("ann_block"),
        F.monotonically_increasing_id().alias("ann_pos"),
    )


def read_annotation_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Map-form annotations as raw JSON text in ``json``: one small map per entry of a file, or per line (``lines``)."""
    if lines:
        return spark.read.text(path).select(F.col("value").alias("json"))
    return json_elements(spark, path).select(F.concat(F.lit("{"), "text", F.lit("}")).alias("json"))


def _carried(annotations: DataFrame) -> list[str]:
    return [c for c in annotations.columns if c not in ("captions", "questions")]


def string_captions(annotations: DataFrame) -> DataFrame:
    """One row per caption of annotations whose captions are plain text; empty identifiers are dropped."""
    kept = [c for c in _carried(annotations) if c != "fps"]
    return annotations.filter(~is_blank(F.col("vid"))).select(
        *kept,
        F.coalesce(F.col("fps"), F.lit(SOURCE_FPS)).alias("video_fps"),
        F.lit(0).alias("kind"),
        F.posexplode("captions").alias("cap_pos", "text_query"),
        F.lit(False).alias("is_interrogative"),
    )


def _struct_rows(annotations: DataFrame, field: str, kind: int) -> DataFrame:
    kept = [c for c in _carried(annotations) if c not in ("temporal_gt", "used_relation", "used_segment")]
    sentence = F.col("_sentence")
    return annotations.select(
        *kept,
        *[F.col(c).alias(f"ann_{c}") for c in ("temporal_gt", "used_relation", "used_segment")],
        F.posexplode(field).alias("cap_pos", "_sentence"),
    ).select(
        *kept,
        *[f"ann_{c}" for c in ("temporal_gt", "used_relation", "used_segment")],
        F.lit(kind).alias("kind"),
        "cap_pos",
        sentence["description"].alias("text_query"),
        sentence["type"].alias("caption_type"),
        sentence["target_id"].alias("ann_target_id"),
        F.lit(kind == 1).alias("is_interrogative"),
    )


def struct_captions(
    annotations: DataFrame, sentence_type: str = "both", caption_type: str | None = None
) -> DataFrame:
    """Captions, then questions, of annotations whose sentences are structs.

    ``sentence_type`` is ``declarative``, ``interrogative`` or ``both``; a ``caption_type`` keeps only that type.
    """
    parts = []
    if sentence_type in ("declarative", "both"):
        parts.append(_struct_rows(annotations, "captions", 0))
    if sentence_type in ("interrogative", "both"):
        parts.append(_struct_rows(annotations, "questions", 1))
    if not parts:
        raise ValueError(f"unknown sentence type {sentence_type!r}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return with_caption_type(rows, caption_type)


def map_captions(maps: DataFrame, caption_field: str = "caption", json: str = "json") -> DataFrame:
    """One row per entry of map-form annotations: file name to object.

    The sentence is the configured field; entries without it are dropped. The identifier is the file name without
    its extension.
    """
    shape = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    entries = maps.select(F.explode(F.from_json(F.col(json), shape)).alias("video_file", "_entry"))
    rows = entries.select(
        file_stem(F.col("video_file")).alias("vid"),
        "video_file",
        F.try_element_at(F.col("_entry"), F.lit(caption_field)).alias("text_query"),
        F.lit(SOURCE_FPS).alias("video_fps"),
        F.lit(False).alias("is_interrogative"),
        F.lit(1).alias("sentence_index"),
    )
    return drop_empty(rows)


def with_caption_type(rows: DataFrame, caption_type: str | None) -> DataFrame:
    """Rows of one caption type; no type keeps all."""
    return rows if caption_type is None else rows.filter(F.col("caption_type") == caption_type)


def drop_empty(rows: DataFrame, column: str = "text_query") -> DataFrame:
    """Rows with a sentence."""
    return rows.filter(F.col(column) != "")


def require_query(rows: DataFrame, column: str = "text_query") -> DataFrame:
    """Fail the job on a blank sentence."""
    bad = is_blank(F.col(column))
    return rows.filter(F.when(bad, F.raise_error(F.lit("text query is empty")).cast("boolean")).otherwise(True))


def with_id(rows: DataFrame, video_id: str, prefix: bool = False) -> DataFrame:
    """Rows of one video, or of all whose identifier starts with the text."""
    vid = F.col("vid")
    return rows.filter(vid.startswith(video_id) if prefix else vid == video_id)


def caption_column(name: str, fields: Sequence[str]) -> Column:
    """The configured caption column; an unknown name is reported with the columns there are."""
    if name not in fields:
        raise ValueError(f"no caption column {name!r}; columns: {', '.join(fields)}")
    return F.col(name)
