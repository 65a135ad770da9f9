"""Writers and the rows they write."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.functions.names import base_vid, object_key
from clipgrid.operators.report import frames_per_tube, tubes_per_set
from clipgrid.schemas import GROUNDING_COLUMNS, KEY_FRAME

BUCKETS = 64
RECORDS_PER_FILE = 5_000_000


def video_bucket(vid: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(base_vid(vid)), F.lit(buckets)).cast("int")


def _write(
    rows: DataFrame,
    path: str,
    order: Sequence[str],
    mode: str,
    fmt: str = "parquet",
    buckets: int = BUCKETS,
    records: int = RECORDS_PER_FILE,
) -> None:
    """Folders by bucket. A bucket goes to as many tasks as its size asks for: the adaptive execution splits large
    partitions of a rebalance and joins small ones, so neither a hot video nor the number of buckets is a limit."""
    tagged = rows.withColumn("bucket", video_bucket(F.col("vid"), buckets))
    dealt = tagged.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *order)
    writer = dealt.write.mode(mode).option("maxRecordsPerFile", records)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.partitionBy("bucket").format(fmt).save(path)


def _of_run(rows: DataFrame, run: int | None) -> DataFrame:
    """Adds the number of the run: given, or the time of writing in microseconds. Readers take the last one."""
    return rows.withColumn("run", F.unix_micros(F.current_timestamp()) if run is None else F.lit(run).cast("long"))


def write_grounding(
    rows: DataFrame, path: str, mode: str = "append", fmt: str = "json", run: int | None = None, buckets: int = BUCKETS
) -> None:
    """The twelve columns in their fixed order, and the run; null fields are written out."""
    _write(_of_run(rows.select(*GROUNDING_COLUMNS), run), path, ["vid"], mode, fmt, buckets)


def legacy_grounding_rows(rows: DataFrame) -> DataFrame:
    """Grounding rows of the direct-box step: an empty answer counts as absent, a failure has no answer."""
    return rows.withColumn("answer", F.when(F.col("success"), F.nullif(F.col("answer"), F.lit("")))).withColumn(
        "raw_output", F.nullif(F.col("raw_output"), F.lit(""))
    )


def key_frame_rows(rows: DataFrame) -> DataFrame:
    """Key-frame records; annotation fields are null unless they say something.

    Empty maps and empty text count as nothing, a target identifier counts whenever it is there.
    """
    empty_map = F.col("ann_temporal_gt").isNull() | (F.size("ann_temporal_gt") <= 0)
    rules = {
        "ann_temporal_gt": F.when(~empty_map, F.col("ann_temporal_gt")),
        "ann_used_relation": F.nullif(F.col("ann_used_relation"), F.lit("")),
        "ann_used_segment": F.nullif(F.col("ann_used_segment"), F.lit("")),
    }
    return rows.select(
        *[rules.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in KEY_FRAME.fields]
    )


def store_by_key(rows: DataFrame, name: str, path: str, key: str = "vid", buckets: int = BUCKETS) -> DataFrame:
    """Append rows to a table whose files are bucketed by a key, and return the table.

    Tables of one key and number of buckets meet without a shuffle of either side: what is finished is dealt out once, when it
    is stored, and not by every run that asks what is left.
    """
    dealt = rows.repartition(buckets, key)
    dealt.write.mode("append").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)


def write_key_frames(
    rows: DataFrame, path: str, mode: str = "append", run: int | None = None, buckets: int = BUCKETS
) -> None:
    _write(_of_run(key_frame_rows(rows), run), path, ["vid"], mode, buckets=buckets)


def foreground(value: Column) -> Column:
    """Anything above zero is foreground when a mask is written."""
    return value > 0


def write_masks(frames: DataFrame, spans: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Mask frames and runs, sorted so that one mask is contiguous in its file."""
    tube = ["tube_id"] if "tube_id" in frames.columns else []
    _write(frames, f"{path}/mask_frames", ["vid", *tube, "frame_idx"], mode, buckets=buckets)
    _write(spans, f"{path}/mask_spans", ["vid", *tube, "frame_idx", "y", "x0"], mode, buckets=buckets)


def write_packed_masks(packed: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """One row per mask, sorted by clip, tube and frame."""
    tube = ["tube_id"] if "tube_id" in packed.columns else []
    _write(packed, path, ["vid", *tube, "frame_idx"], mode, buckets=buckets)


def tube_set_tables(sets: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header and tubes of every set.

    Headers carry the object name made from the prompt unless given, and tube and mask counts; the tubes are rows
    with their frame range. The frame list of a tube is the ``mask_frames`` table itself, as a list per set would
    grow with the video.
    """
    counts = tubes_per_set(frames, ["set_id"])
    header = sets.withColumn("object_name", F.coalesce("object_name", object_key(F.col("prompt")))).join(
        counts, "set_id", "left"
    )
    header = header.withColumns(
        {
            "num_tubes": F.coalesce("num_tubes", F.lit(0)),
            "num_masks": F.coalesce("num_masks", F.lit(0)),
            "start_frame_idx": F.lit(0).cast("long"),
        }
    )
    return header, frames_per_tube(frames, ["set_id"])


def write_tube_sets(sets: DataFrame, frames: DataFrame, path: str, mode: str = "append", run: int | None = None) -> None:
    header, tubes = tube_set_tables(sets, frames)
    _of_run(header, run).write.mode(mode).parquet(f"{path}/tube_sets")
    _of_run(tubes, run).write.mode(mode).parquet(f"{path}/tubes")


def write_outcomes(
    rows: DataFrame, path: str, stage: str, mode: str = "append", run: int | None = None, buckets: int = BUCKETS
) -> None:
    """Outcomes with the step they belong to, the time of writing and the run."""
    timed = rows.withColumn("stage", F.lit(stage)).withColumn("ts", F.current_timestamp())
    _write(_of_run(timed, run), path, ["vid"], mode, buckets=buckets)


def run_summaries(key_frames: DataFrame, masks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One JSON text per clip: sentence, key frame, numbers of frames and masks, success and error.

    Score series stay in their own table.
    """
    counts = masks.groupBy("vid").agg(F.count(F.lit(1)).alias("num_masks"))
    rows = (
        key_frames.join(counts, "vid", "left")
        .join(outcomes.select("vid", "success", "error_message"), "vid", "left")
        .withColumn("num_masks", F.coalesce("num_masks", F.lit(0)))
        .withColumn("success", F.coalesce("success", F.lit(False)))
    )
    body = F.struct(
        F.col("vid").alias("video_id"),
        "text_query",
        "key_frame_idx",
        F.col("num_sampled_frames").alias("num_frames"),
        "num_masks",
        "success",
        "error_message",
    )
    return rows.select("vid", F.to_json(body, {"ignoreNullFields": "false"}).alias("summary"))


def write_json_arrays(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON array per partition, in its order."""
    import pyarrow as pa

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                framed_texts = [lead + texts[0], *("," + t for t in texts[1:])]
                lead = ","
                yield pa.RecordBatch.from_arrays([pa.array(framed_texts, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], ["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(framed, "value string").write.mode(mode).text(path)
