"""Media listings: catalog, frame order, sizes, path look-ups. Pixels are never read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgrid.functions.names import base_name, file_extension, file_stem
from clipgrid.operators.skew import join_by_group, number_rows
from clipgrid.session import cut_lineage

# Accepted extensions and sizes.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp")
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".webm", ".flv", ".wmv", ".m4v")
CLIP_FILE_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv")
MIME_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".bmp": "image/bmp",
}
DEFAULT_MIME = "image/jpeg"
DEFAULT_WIDTH, DEFAULT_HEIGHT = 1920, 1080


def list_files(spark: SparkSession, roots: Sequence[str], content: bool = False) -> DataFrame:
    """Files below the roots with the rank of their root; content is only read when asked for."""
    parts = []
    for rank, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        columns = [F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.lit(rank).alias("root_rank")]
        parts.append(files.select(*columns, *(["content"] if content else [])))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)/[^/]*\z", "")


def catalog_by_name(files: DataFrame) -> DataFrame:
    """One path per base name: the first root wins, then the first path."""
    named = files.select(base_name(F.col("path")).alias("basename"), "path", "root_rank")
    return named.groupBy("basename").agg(F.min_by("path", F.struct("root_rank", "path")).alias("path"))


def is_image(path: Column) -> Column:
    return file_extension(path).isin(*IMAGE_EXTENSIONS)


def frame_number(name: Column, order: str) -> Column:
    """Sort number of a frame file: ``first_number`` takes the first digits of the name, ``all_digits`` only names
    made of digits; null sorts last."""
    stem = file_stem(name)
    if order == "first_number":
        return F.regexp_extract(stem, "([0-9]+)", 1).try_cast("decimal(38,0)")
    if order == "all_digits":
        return F.when(stem.rlike("^[0-9]+$"), stem.try_cast("decimal(38,0)"))
    raise ValueError(f"unknown frame order {order!r}")


def order_frames(files: DataFrame, order: str = "first_number") -> DataFrame:
    """Number the image files of every directory from 0.

    ``order`` is ``first_number``, ``all_digits`` or ``text``; equal numbers and names without one are ordered by
    name. Files are dealt out by ranges of directory and place, so a directory of any size and naming is numbered in
    as many segments as it has ranges; the ranges are written out, as a lost task could draw them anew.
    """
    images = files.filter(is_image(F.col("path"))).select(
        parent_dir(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name"), "path"
    )
    name = F.col("name")
    if order == "text":
        rank = [name]
    else:
        images = images.withColumn("_number", frame_number(name, order))
        rank = [F.col("_number").isNull(), F.col("_number"), name]
    ranged = images.repartitionByRange("dir", *rank).withColumn("_range", F.spark_partition_id())
    settled = cut_lineage(ranged)
    return number_rows(settled, ["dir"], rank, F.col("_range"), "frame_idx", start=0).drop("_number", "_range")


def clip_metadata(files: DataFrame, sizes: DataFrame, rule: str = "text") -> DataFrame:
    """Frame count of every image directory with the size of its first file.

    ``text`` takes all image files and the first name; ``number`` leaves out ``.bmp`` and takes the lowest number, or
    the first name where a name of the directory is not a number. ``sizes`` has ``path, width, height``.
    """
    if rule not in ("text", "number"):
        raise ValueError(f"unknown rule {rule!r}")
    name = base_name(F.col("path"))
    images = files.filter(is_image(F.col("path"))).withColumn("dir", parent_dir(F.col("path")))
    first = F.min_by("path", name)
    if rule == "number":
        images = images.filter(file_extension(F.col("path")) != ".bmp")
        number = frame_number(name, "all_digits")
        first = F.when(F.bool_and(number.isNotNull()), F.min_by("path", F.struct(number, name))).otherwise(first)
    counted = images.groupBy("dir").agg(F.count(F.lit(1)).alias("num_frames"), first.alias("_first"))
    first = sizes.select(F.col("path").alias("_first"), "width", "height")
    return counted.join(first, "_first", "left").select(
        F.col("dir").alias("video_path"),
        "num_frames",
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
    )


def is_readable(path: Column, probe_ok: Column) -> Column:
    """A known video extension, and a successful probe unless the container is lenient (``.mkv``)."""
    extension = file_extension(path)
    return extension.isin(*VIDEO_EXTENSIONS) & ((extension == ".mkv") | F.coalesce(probe_ok, F.lit(False)))


def filter_readable(clips: DataFrame, media: DataFrame) -> DataFrame:
    """Clips whose media file exists and is readable. ``media`` has ``video_path, readable``."""
    good = media.filter(is_readable(F.col("video_path"), F.col("readable"))).select("video_path")
    return clips.join(good, "video_path", "left_semi")


def clip_media(files: DataFrame) -> DataFrame:
    """Path of every video: ``vid/vid.ext`` by extension order, else the folder ``vid/img``."""
    path = F.col("path")
    parent = parent_dir(path)
    parent_name = base_name(parent)
    in_folder = parent_name == "img"
    vid = F.when(in_folder, base_name(parent_dir(parent))).otherwise(parent_name)
    rank = F.when(in_folder, F.lit(len(CLIP_FILE_EXTENSIONS)))
    for i, extension in enumerate(CLIP_FILE_EXTENSIONS):
        rank = rank.when(base_name(path) == F.concat(vid, F.lit(extension)), F.lit(i))
    rows = files.select(vid.alias("vid"), rank.alias("_rank"), F.when(in_folder, parent).otherwise(path).alias("path"))
    return (
        rows.filter("_rank IS NOT NULL")
        .groupBy("vid")
        .agg(F.min_by("path", F.struct("_rank", "path")).alias("video_path"))
    )


def repair_paths(
    clips: DataFrame,
    files: DataFrame,
    roots: Sequence[str],
    marker: str = "/data/",
    swap: tuple[str, str] = ("/mnt/data/", "/mnt/"),
) -> DataFrame:
    """Replace stale media paths by existing ones.

    In order: the path itself, the part after ``marker`` under each root, the base name anywhere, the swapped
    prefix; else it stays. All candidates of the distinct paths meet the listing in one join.
    """
    path = F.col("video_path")
    has_marker = path.contains(marker)
    rest = F.substr(path, F.locate(marker, path) + F.lit(len(marker)))

    def candidate(rank: int, kind: str, key: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("key"))

    candidates = [candidate(0, "path", path)]
    for i, root in enumerate(roots):
        candidates.append(candidate(1 + i, "path", F.when(has_marker, F.concat(F.lit(root.rstrip("/") + "/"), rest))))
    candidates.append(candidate(1 + len(roots), "name", F.nullif(base_name(path), F.lit(""))))
    old, new = swap
    swapped = F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1))))
    candidates.append(candidate(2 + len(roots), "path", swapped))
    wanted = (
        clips.select("video_path")
        .filter(path != "")
        .distinct()
        .select("video_path", F.explode(F.array(*candidates)).alias("_c"))
        .select("video_path", "_c.rank", "_c.kind", "_c.key")
        .filter("key IS NOT NULL")
    )
    by_path = files.select(F.lit("path").alias("kind"), F.col("path").alias("key"), "path").distinct()
    by_name = catalog_by_name(files).select(F.lit("name").alias("kind"), F.col("basename").alias("key"), "path")
    found = (
        wanted.join(by_path.unionByName(by_name), ["kind", "key"])
        .groupBy("video_path")
        .agg(F.min_by("path", "rank").alias("_repaired"))
    )
    spread = [c for c in clips.columns if c != "video_path"] or ["video_path"]
    joined = join_by_group(clips, found, ["video_path"], spread, "left")
    return joined.withColumn("video_path", F.coalesce("_repaired", "video_path")).drop("_repaired")


def with_image_size(rows: DataFrame, sizes: DataFrame, path: str = "key_frame_path") -> DataFrame:
    """Attach image width and height; an unknown image counts as 1920 by 1080."""
    known = sizes.select(F.col("path").alias(path), "width", "height")
    return rows.join(known, path, "left").withColumns(
        {
            "width": F.coalesce("width", F.lit(DEFAULT_WIDTH)),
            "height": F.coalesce("height", F.lit(DEFAULT_HEIGHT)),
        }
    )


def mime_type(path: Column, types: Mapping[str, str] = MIME_TYPES) -> Column:
    pairs = [F.lit(v) for item in types.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), file_extension(path)), F.lit(DEFAULT_MIME))


def inline_image(content: Column) -> Column:
    """Image bytes as base64 text without line breaks."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")
