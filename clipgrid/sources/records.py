"""Key-frame and grounding records of earlier steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql import types as T

from clipgrid.functions.names import compose_vid
from clipgrid.operators.resume import take_first
from clipgrid.operators.skew import join_by_key
from clipgrid.schemas import GROUNDING, KEY_FRAME

#: Name of the image beside a record.
KEY_FRAME_IMAGE = "key_frame.png"


def read_json_tree(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All ``metadata.json`` files below a folder with their plain ``path``; one small object per file."""
    rows = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "metadata.json")
        .json(root)
    )
    raw = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return rows.select("*", F.regexp_replace(F.url_decode(raw), "^file:/+", "/").alias("path"))


def folder_of(path: Column) -> Column:
    """The path without its last name; one without a slash stays."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - F.length(name) - 1)).otherwise(path)


def place_records(rows: DataFrame, step: str) -> DataFrame:
    """Split the path of a file into ``root``, ``base_vid``, ``idx`` and ``name``.

    Layouts are ``root/step/base/idx/name`` and ``root/step/base/name``; ``idx`` is null in the flat one. The names are cut off
    the end of the path in one generated row: a filter on them then stays behind it, where it would else be moved to the input with
    all that makes up the path, once for every use of it.
    """
    parts = F.col("_parts")
    last = lambda k: F.get(parts, F.size(parts) - k)
    lead, *rest = step.split("/")

    def below_step(depth: int) -> Column:
        """Whether the last ``depth`` names are names and what is before them ends with the step."""
        found = F.endswith(last(depth + 1 + len(rest)), F.lit(lead))
        for i, name in enumerate(reversed(rest)):
            found = found & (last(depth + 1 + i) == name)
        for k in range(1, depth + 1):
            found = found & (last(k) != "")
        return found

    numbered, flat = below_step(3), below_step(2)
    names = {"base_vid": F.when(numbered, last(3)).when(flat, last(2)), "idx": F.when(numbered, last(2)), "name": last(1)}
    cut = rows.withColumn("_parts", F.split("path", "/")).select("*", F.stack(F.lit(1), *names.values()).alias(*names))
    path, below = F.col("path"), F.concat_ws("/", "base_vid", "idx", "name")
    before = F.substring(path, F.lit(1), F.length(path) - F.length(below) - len(step) - 1)
    root = F.when(F.endswith(before, F.lit("/")), F.substring(before, F.lit(1), F.length(before) - 1)).otherwise(before)
    return cut.filter("base_vid IS NOT NULL").select(*rows.columns, root.alias("root"), *names)


def select_layout(placed: DataFrame, files: DataFrame) -> DataFrame:
    """Records of the layout that counts: with any numbered folder only those, else the flat record.

    ``files`` is the placed listing of all files, since a numbered folder counts even without a record.
    """
    numbered = F.coalesce(F.col("idx").rlike("^[0-9]+$"), F.lit(False))
    layout = files.groupBy("base_vid").agg(F.max(numbered).alias("_has_numbered"))
    # One row per video joins a few rows each, without copies; a video of very many sentences is left to the adaptive skew join.
    joined = join_by_key(placed, layout, ["base_vid"])
    kept = joined.filter(F.when(F.col("_has_numbered"), numbered).otherwise(F.col("idx").isNull()))
    return kept.drop("_has_numbered")


def complete_records(placed: DataFrame, files: DataFrame, image: str = KEY_FRAME_IMAGE) -> DataFrame:
    """Records that have a sentence and a key-frame image beside them, with its path; others are dropped."""
    # Placed rows have a path; told so, the planner does not work it out once more to look for nulls.
    folder = F.coalesce(folder_of(F.col("path")), F.lit(""))
    images = files.filter(F.col("name") == image).select(
        F.col("path").alias("key_frame_path"), folder.alias("_dir")
    )
    records = placed.filter(F.col("text_query").isNotNull()).withColumn("_dir", folder)
    return join_by_key(records, images, ["_dir"]).drop("_dir")


def scan_key_frames(
    records: DataFrame, files: DataFrame, step: str = "stage1", limit: int | None = None, ordered: bool = True
) -> DataFrame:
    """Key-frame records of a folder tree: layout choice, drop rules, identifiers, optional order and limit.

    ``records`` are the parsed metadata files and ``files`` the listing of all files, both with ``path``. Videos are
    taken in text order and their sentences in number order; without ``ordered`` the limit takes any.
    """
    placed = place_records(records.drop("vid"), step)
    rows = select_layout(placed, place_records(files.select("path"), step))
    # Only images are placed a second time; where they are is that of the record beside them.
    rows = complete_records(rows, place_records(files.select("path").filter(F.endswith("path", F.lit(f"/{KEY_FRAME_IMAGE}"))), step))
    rows = rows.withColumn("vid", compose_vid(F.col("base_vid"), F.col("idx"))).drop("root", "name", "path")
    if limit is None:
        return rows
    return take_first(rows, limit) if ordered else rows.limit(limit)


def read_key_frames(spark: SparkSession, root: str, step: str = "stage1", limit: int | None = None) -> DataFrame:
    from clipgrid.sources.listing import walk_files

    records = read_json_tree(spark, f"{root}/{step}", KEY_FRAME)
    return scan_key_frames(records, walk_files(spark, [f"{root}/{step}"]), step, limit)


def preferred_records(
    records: DataFrame, files: DataFrame, prefixes: Sequence[str], step: str = "stage1", root: str = ""
) -> DataFrame:
    """Records of the preferred layout ``root/step``, else of ``root/prefix/step`` by the order of prefixes.

    The choice falls on the metadata; a chosen record without its image is dropped, as there is no second choice.
    """
    base = root.rstrip("/")
    places = [base] + [f"{base}/{prefix}".strip("/") if not base else f"{base}/{prefix}" for prefix in prefixes]
    rank = F.when(F.lit(False), F.lit(0))
    for i, place in enumerate(places):
        rank = rank.when(F.rtrim(F.col("root"), F.lit("/")) == place, F.lit(i))
    placed = place_records(records.drop("vid"), step).withColumn("_rank", rank).filter("_rank IS NOT NULL")
    placed = placed.withColumn("vid", compose_vid(F.col("base_vid"), F.col("idx")))
    fields = [c for c in placed.columns if c not in ("vid", "_rank")]
    chosen = placed.groupBy("vid").agg(F.min_by(F.struct(*fields), F.col("_rank")).alias("_row"))
    rows = chosen.select("vid", "_row.*")
    return complete_records(rows, place_records(files.select("path"), step)).drop("root", "name", "path")


def typed_grounding(rows: DataFrame) -> DataFrame:
    """The twelve grounding columns with the defaults of a sparse record."""
    defaults = {
        "success": F.coalesce(F.col("success"), F.lit(False)),
        "method": F.coalesce(F.col("method"), F.lit("unknown")),
        "extras": F.coalesce(F.col("extras"), F.from_json(F.lit("{}"), GROUNDING["extras"].dataType)),
    }
    return rows.select(*[defaults.get(f.name, F.col(f.name)).alias(f.name) for f in GROUNDING.fields])


def latest_rows(rows: DataFrame, keys: Sequence[str], run: str = "run") -> DataFrame:
    """The row of the last run per key, without the run; a row without a run is older than any."""
    rest = [c for c in rows.columns if c not in (*keys, run)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(run), F.lit(-1))).alias("_row"))
    return last.select(*keys, "_row.*")


def of_last_run(rows: DataFrame, keys: Sequence[str], run: str = "run") -> DataFrame:
    """All rows that the last run of their key has written, without the run."""
    last = rows.groupBy(*keys).agg(F.max(run).alias(run))
    return rows.join(last, [*keys, run], "left_semi").drop(run)


def read_grounding(spark: SparkSession, path: str) -> DataFrame:
    """Grounding rows from JSON, one object per line or per file; of several runs of a clip the last one counts."""
    schema = StructType([*GROUNDING.fields, StructField("run", LongType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return typed_grounding(latest_rows(rows, ["vid"]))


def read_key_frame_table(spark: SparkSession, path: str) -> DataFrame:
    """Key frames that were written as a table, one per clip."""
    return latest_rows(spark.read.parquet(path).drop("bucket"), ["vid"])


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """One outcome per clip and step."""
    return latest_rows(spark.read.parquet(path).drop("bucket"), ["vid", "stage"])


def read_tube_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers and tubes of the last run of every set."""
    header, tubes = (spark.read.parquet(f"{path}/{name}") for name in ("tube_sets", "tubes"))
    return latest_rows(header, ["set_id"]), of_last_run(tubes, ["set_id"])
