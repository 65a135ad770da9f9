"""The whole flow, and tables that are written and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from clipgrid.catalog.base import MASK_FRAMES, PIXELS, Case, mask_frames, register, runs, table
from clipgrid.functions.boxes import box_of
from clipgrid.operators.report import outcome_counts
from clipgrid.operators.scoring import Plugin, Registry
from clipgrid.operators.skew import number_rows
from clipgrid.operators.spans import mask_stats
from clipgrid.plans.flow import run_flow
from clipgrid.schemas import GROUNDING
from clipgrid.session import shared_folder
from clipgrid.sinks.compaction import compact
from clipgrid.sinks.tables import write_grounding, write_masks, write_outcomes
from clipgrid.sources.records import read_grounding, read_outcomes

CASES: dict[str, Case] = {}

# The flow: an eighth of a label's vectors is a clip of one chunk, the others are one of several chunks.
SIZE, OVERLAP = 24, 8
STEP = SIZE - OVERLAP


def _locate(rows: pd.DataFrame) -> pd.DataFrame:
    """A stand-in scorer: the box follows from the frame; every seventh frame has none."""
    frame = rows["original_frame_idx"].to_numpy()
    boxes = [{"xmin": int(f) % 9, "ymin": 2, "xmax": int(f) % 9 + 6, "ymax": 5} for f in frame]
    return pd.DataFrame(
        {
            "vid": rows["vid"].to_numpy(),
            "success": frame % 7 > 0,
            "bbox": boxes,
            "box_similarity": 0.5,
            "mask_similarity": 0.5,
            "mask_coverage": 1.0,
        }
    )


def _shift(row: pd.DataFrame) -> pd.DataFrame:
    """A stand-in propagator: away from its prompt the mask moves right by one pixel per frame."""
    chunk = row.iloc[0]
    parts = []
    for frame in range(int(chunk["chunk_start"]), int(chunk["chunk_end"])):
        by = abs(frame - int(chunk["prompt_idx"]))
        prompt = chunk["prompt"] if chunk["prompt"] is not None else []
        parts += [(chunk["vid"], frame, r["y"], r["x0"] + by, r["x1"] + by) for r in prompt] or [(chunk["vid"], frame, 0, 0, 0)]
    return pd.DataFrame(parts, columns=["vid", "frame_idx", "y", "x0", "x1"])


# A chunk is prompted by the frame nearest to the key frame that it shares with its neighbour, so away from the overlaps
# a mask has moved by its distance from the key frame. In an overlap the chunk that is farther out moves on from its
# prompt toward the key frame as well, and counts where it reaches deeper than half of the overlap.
_WHOLE = f"""
grouped AS (SELECT *, 'c' || label || CASE WHEN vec_id % 8 = 0 THEN 's' ELSE '' END AS vid FROM embeddings),
numbered AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY vec_id) - 1 AS f, count(*) OVER (PARTITION BY vid) AS total FROM grouped),
counted AS (SELECT *, least(total, greatest(1, CAST(round_even(total::DOUBLE / 12.0::DOUBLE * 3, 0) AS BIGINT))) AS n FROM (SELECT DISTINCT vid, total FROM numbered)),
samples AS (SELECT vid, n, i AS sample_idx, CASE WHEN i = n - 1 THEN total - 1 ELSE CAST(round_even(i * ((total - 1)::DOUBLE / (n - 1)), 0) AS BIGINT) END AS f
  FROM (SELECT *, unnest(range(n)) AS i FROM counted)),
asked AS (SELECT vid, arg_max(embedding, (vec_id * 7919 % 101, vec_id)) AS q FROM grouped GROUP BY vid),
scored AS (SELECT s.*, total, 1 / (1 + exp(-2 * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])))) AS score
  FROM samples s JOIN numbered USING (vid, f) JOIN asked USING (vid)),
keys AS (SELECT vid, f AS key, total, f % 7 > 0 AS found FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY score DESC, sample_idx) AS r FROM scored) WHERE r = 1),
mains AS (SELECT *, greatest(0, (key - {SIZE} + {STEP}) // {STEP}) AS main FROM keys WHERE found AND vid <> 'c3'),
frames AS (SELECT *, unnest(range(total)) AS j FROM mains),
placed AS (SELECT *, j // {STEP} AS later, j % {STEP} AS deep, (greatest(0, total - {SIZE}) + {STEP} - 1) // {STEP} AS last FROM frames),
shifted AS (SELECT vid, j, key, CASE
    WHEN later > last THEN [abs(j - key)]
    WHEN later > 0 AND deep < {OVERLAP} AND later <= main THEN
      CASE WHEN 2 * deep > {OVERLAP} THEN [key - later * {STEP} + deep] WHEN 2 * deep < {OVERLAP} THEN [abs(j - key)] ELSE [abs(j - key), key - later * {STEP} + deep] END
    WHEN later > main AND deep < {OVERLAP} THEN
      CASE WHEN 2 * ({OVERLAP} - deep) > {OVERLAP} THEN [2 * (later * {STEP} + {OVERLAP} - 1) - key - j] WHEN 2 * ({OVERLAP} - deep) < {OVERLAP} THEN [abs(j - key)]
        ELSE [abs(j - key), 2 * (later * {STEP} + {OVERLAP} - 1) - key - j] END
    ELSE [abs(j - key)] END AS moves FROM placed)"""


def _whole_flow(spark, folder):
    name = F.concat(F.lit("c"), "label", F.when(F.col("vec_id") % 8 == 0, "s").otherwise(""))
    rows = table(spark, folder, "embeddings").withColumn("vid", name)
    numbered = number_rows(rows, ["vid"], [F.col("vec_id")], F.floor(F.col("vec_id") / 256), "frame_idx", start=0)
    frames = numbered.select("vid", "frame_idx", F.col("embedding").alias("vector"))
    queries = rows.groupBy("vid").agg(F.max_by("embedding", F.struct(F.col("vec_id") * 7919 % 101, "vec_id")).alias("query_vector"))
    clips = rows.groupBy("vid").agg(F.count(F.lit(1)).alias("num_frames")).select(
        "vid", "num_frames", F.lit(12.0).alias("video_fps"), F.lit("a thing walks").alias("text_query"), F.concat(F.lit("/v/"), "vid").alias("video_path")
    )
    media = clips.filter("vid <> 'c3'").select(
        "video_path", F.col("num_frames").cast("long"), F.lit(12).cast("long").alias("height"), F.lit(100000).cast("long").alias("width")
    )
    sets = spark.createDataFrame([], "set_id long, base_vid string, prompt string, video_path string, num_tubes int")
    no_frames = spark.createDataFrame([], "set_id long, tube_id long, frame_idx long, height long, width long")
    no_spans = spark.createDataFrame([], "set_id long, tube_id long, frame_idx long, y long, x0 long, x1 long")
    return run_flow(
        clips,
        frames,
        queries,
        Registry({"locate": Plugin(lambda model, batch: _locate(batch))}),
        "locate",
        media,
        sets,
        no_frames,
        no_spans,
        "relative",
        0.2,
        propagators=Registry({"shift": Plugin(lambda model, row: _shift(row))}),
        backend="shift",
        chunk_size=SIZE,
        chunk_overlap=OVERLAP,
    )


@register(
    CASES,
    f"""
    WITH {_WHOLE}
    SELECT vid, j AS frame_idx, greatest(0, key % 9 + 6 + list_min(moves) - (key % 9 + list_max(moves))) * 3 AS area,
      CASE WHEN list_max(moves) - list_min(moves) < 6 THEN key % 9 + list_max(moves) END AS xmin FROM shifted
    """,
)
def whole_flow(spark, folder):
    """Sentences and vectors to masks, with a registered scorer and propagator and clips of one and of many chunks."""
    found = _whole_flow(spark, folder).propagation
    stats = mask_stats(found.spans, found.frames, ["vid", "frame_idx"])
    return stats.select("vid", "frame_idx", "area", "xmin")


@register(
    CASES,
    f"""
    WITH {_WHOLE}
    SELECT vid, CASE WHEN vid <> 'c3' AND found THEN 'box_propagation' ELSE 'no_output' END AS method,
      CASE WHEN vid = 'c3' THEN 'video_not_found' WHEN NOT found THEN 'no_masks_generated' WHEN total = 1 THEN 'insufficient_masks_propagation_failed' END AS failure_reason,
      CASE WHEN vid <> 'c3' AND found AND total > 1 THEN total ELSE 0 END AS num_masks FROM keys
    """,
)
def whole_flow_outcomes(spark, folder):
    outcomes = _whole_flow(spark, folder).propagation.outcomes
    return outcomes.select("vid", "method", "failure_reason", "num_masks")


def _two_runs(spark, folder):
    """All orders fail in a first run; those of status F are tried again and succeed."""
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    base = {
        "vid": F.concat(F.lit("o"), k),
        "text_query": F.col("o_orderpriority"),
        "target_object": F.lit("thing"),
        "method": F.lit("direct"),
        "bbox": F.lit(None).cast("struct<xmin:int,ymin:int,xmax:int,ymax:int>"),
        "confidence": F.lit(None).cast("double"),
        "answer": F.lit(None).cast("string"),
        "mask_path": F.lit(None).cast("string"),
        "raw_output": F.lit(None).cast("string"),
        "extras": F.lit(None).cast("map<string,double>"),
    }
    first = orders.select(*[c.alias(n) for n, c in base.items()], F.lit(False).alias("success"), F.lit("first").alias("failure_reason"), k)
    again = first.join(orders.filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey").withColumns(
        {"success": F.lit(True), "failure_reason": F.lit(None).cast("string"), "bbox": box_of(k % 9, F.lit(1), k % 9 + 5, F.lit(4))}
    )
    return first, again


@register(
    CASES,
    """
    SELECT 'o' || o_orderkey AS vid, o_orderstatus = 'F' AS success, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 9 END AS xmin,
      CASE WHEN o_orderstatus <> 'F' THEN 'first' END AS failure_reason FROM orders
    """,
)
def grounding_rerun(spark, folder):
    """Two runs are written; the reader takes the last row of every clip."""
    path = shared_folder(spark, "grounding")
    for run, rows in enumerate(_two_runs(spark, folder)):
        write_grounding(rows, path, run=run)
    return read_grounding(spark, path).select("vid", "success", "bbox.xmin", "failure_reason")


@register(
    CASES,
    """
    SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed
    FROM orders GROUP BY o_orderpriority
    """,
)
def outcome_rerun(spark, folder):
    path = shared_folder(spark, "outcomes")
    for run, rows in enumerate(_two_runs(spark, folder)):
        write_outcomes(rows.select("vid", "success", F.col("text_query").alias("o_orderpriority")), path, "grounding", run=run)
    counts = outcome_counts(read_outcomes(spark, path), F.col("success"), ["o_orderpriority"])
    return counts.select("o_orderpriority", "total", "succeeded", "failed")


@register(
    CASES,
    """
    SELECT 'o' || o_orderkey AS vid, o_orderstatus = 'F' AS success, 1 AS stored, CASE WHEN o_orderstatus <> 'F' THEN 'first' END AS failure_reason
    FROM orders
    """,
)
def compacted_runs(spark, folder):
    """Four runs are written and compacted: one stored row per clip is left, and it is the one that readers took before."""
    path = shared_folder(spark, "grounding")
    first, again = _two_runs(spark, folder)
    for run, rows in enumerate((first, first.filter("o_orderkey % 2 = 0"), again, again.filter("o_orderkey % 3 = 0"))):
        write_grounding(rows, path, run=run, buckets=8)
    compact(spark, path, ["vid"], "json", GROUNDING)
    stored = spark.read.schema(GROUNDING).json(path).groupBy("vid").agg(F.count(F.lit(1)).alias("stored"))
    return read_grounding(spark, path).join(stored, "vid").select("vid", "success", "stored", "failure_reason")


@register(
    CASES,
    f"""
    WITH {PIXELS}, {MASK_FRAMES},
    sums AS (SELECT vid, tube_id, frame_idx, count(*) AS area, min(x) AS xmin, max(y) AS ymax FROM pixels GROUP BY ALL)
    SELECT f.vid, f.tube_id, f.frame_idx, coalesce(area, 0) AS area, xmin, ymax FROM mask_frames f
    LEFT JOIN sums s ON f.vid = s.vid AND f.tube_id = s.tube_id AND f.frame_idx = s.frame_idx
    """,
)
def mask_write(spark, folder):
    """Masks written to their tables and read back, empty ones too."""
    path = shared_folder(spark, "masks")
    write_masks(mask_frames(spark, folder), runs(spark, folder), path)
    stats = mask_stats(spark.read.parquet(f"{path}/mask_spans"), spark.read.parquet(f"{path}/mask_frames"))
    return stats.select("vid", "tube_id", "frame_idx", "area", "xmin", "ymax")
