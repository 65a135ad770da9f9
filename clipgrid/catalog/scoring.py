"""Scorers, propagators and whole flows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clipgrid.catalog.base import EVENT_CLIPS, Case, event_clips, order_box, register, table
from clipgrid.functions.boxes import box_of
from clipgrid.operators.sampling import pick_key_frames
from clipgrid.operators.scoring import Plugin, Registry, grounding_rows, run_propagators, run_scorers
from clipgrid.operators.skew import number_rows
from clipgrid.operators.spans import mask_stats, union_runs
from clipgrid.plans.grounding import ground
from clipgrid.plans.keyframes import find_key_frames, score_frames
from clipgrid.plans.propagation import propagate
from clipgrid.session import cut_lineage, shared_folder
from clipgrid.streaming.incremental import current_rows, run_incremental, run_stateful

CASES: dict[str, Case] = {}


def _vectors(spark, folder):
    """A label is a clip, its vectors are the sampled frames, its first vector is the query."""
    rows = table(spark, folder, "embeddings")
    vid = F.concat(F.lit("c"), "label").alias("vid")
    frames = rows.select(
        vid, F.col("vec_id").alias("sample_idx"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("vector")
    )
    queries = rows.groupBy(vid).agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    return frames, queries


_SIMILARITY = """
queries AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
scored AS (SELECT 'c' || e.label AS vid, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS dot
  FROM embeddings e JOIN queries USING (label)),
probabilities AS (SELECT *, 1 / (1 + exp(-2 * dot)) AS score FROM scored)"""


@register(
    CASES,
    f"""
    WITH {_SIMILARITY},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY score DESC, vec_id) AS r, count(*) OVER (PARTITION BY vid) AS n,
      min(score) OVER (PARTITION BY vid) AS low, avg(score) OVER (PARTITION BY vid) AS mean FROM probabilities)
    SELECT vid, vec_id AS key_frame_idx, n AS num_sampled_frames, round(score, 6) AS max_similarity, round(low, 6) AS min_similarity,
      round(mean, 6) AS mean_similarity FROM ranked WHERE r = 1
    """,
)
def keyframe_embeddings(spark, folder):
    picks = pick_key_frames(score_frames(*_vectors(spark, folder)))
    rounded = [F.round(c, 6).alias(c) for c in ("max_similarity", "min_similarity", "mean_similarity")]
    return picks.select("vid", "key_frame_idx", "num_sampled_frames", *rounded)


@register(
    CASES,
    f"WITH {_SIMILARITY} SELECT vid, vec_id AS sample_idx, round(dot, 6) AS similarity, round(score, 6) AS score FROM probabilities",
)
def frame_similarity(spark, folder):
    scores = score_frames(*_vectors(spark, folder))
    return scores.select(
        "vid", "sample_idx", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score")
    )


@register(
    CASES,
    """
    WITH frames AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f, count(*) OVER (PARTITION BY label) AS total FROM embeddings),
    counts AS (SELECT *, least(total, greatest(1, CAST(round_even(total::DOUBLE / 12.0::DOUBLE * 3, 0) AS BIGINT))) AS n FROM (SELECT DISTINCT label, total FROM frames)),
    samples AS (SELECT label, n, i AS sample_idx, CASE WHEN i = n - 1 THEN total - 1 ELSE CAST(round_even(i * ((total - 1)::DOUBLE / (n - 1)), 0) AS BIGINT) END AS f
      FROM (SELECT *, unnest(range(n)) AS i FROM counts)),
    queries AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
    scored AS (SELECT s.*, 1 / (1 + exp(-2 * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])))) AS score
      FROM samples s JOIN frames USING (label, f) JOIN queries USING (label)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, sample_idx) AS r FROM scored)
    SELECT 'c' || label AS vid, CASE WHEN label % 2 = 0 THEN 'what is it?' ELSE 'person' END AS target_object, sample_idx AS key_frame_idx, f AS original_frame_idx,
      n AS num_sampled_frames, round(score, 6) AS max_similarity, 3.0::DOUBLE AS sampling_fps
    FROM ranked WHERE r = 1 AND label % 5 > 0
    """,
)
def key_frame_flow(spark, folder):
    """Sampling, scoring, pick and target in one plan; finished clips are left out first."""
    rows = table(spark, folder, "embeddings").withColumn("vid", F.concat(F.lit("c"), "label"))
    numbered = number_rows(rows, ["vid"], [F.col("vec_id")], F.floor(F.col("vec_id") / 256), "frame_idx", start=0)
    frames = numbered.select("vid", "frame_idx", F.col("embedding").alias("vector"))
    queries = rows.groupBy("vid").agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    clips = rows.groupBy("vid", "label").agg(F.count(F.lit(1)).alias("num_frames")).select(
        "vid",
        "num_frames",
        F.lit(12.0).alias("video_fps"),
        F.when(F.col("label") % 2 == 0, "what is it?").otherwise("an adult walks").alias("text_query"),
        F.lit('{"target_prompt": "adult"}').alias("reply"),
    )
    names = F.array(*[F.lit(n) for n in ("metadata.json", "key_frame.png", "similarity_scores.npy")])
    finished = rows.filter("label % 5 = 0").select("vid", F.explode(names).alias("name")).distinct()
    picks = find_key_frames(clips, frames, queries, finished)
    return picks.select(
        "vid",
        "target_object",
        "key_frame_idx",
        "original_frame_idx",
        "num_sampled_frames",
        F.round("max_similarity", 6).alias("max_similarity"),
        "sampling_fps",
    )


def _records(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("o"), k).alias("vid"),
        k,
        "o_custkey",
        F.col("o_orderpriority").alias("text_query"),
        F.lit("thing").alias("target_object"),
        F.when(k % 3 == 0, F.concat(F.lit("/m/"), k)).alias("mask_path"),
    )


_EXPECTED = """
SELECT 'o' || o_orderkey AS vid, o_orderpriority AS text_query, 'thing' AS target_object, ok AS success, CASE WHEN ok THEN o_custkey END AS xmin,
  CASE WHEN ok THEN round(coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_custkey / 1000.0 END, 0.5), 6)::DOUBLE END AS confidence,
  CASE WHEN ok AND o_orderkey % 3 = 0 THEN '/m/' || o_orderkey END AS mask_path,
  CASE WHEN ok THEN NULL WHEN {error} ELSE 'scorer_failed' END AS failure_reason,
  CASE WHEN ok THEN 0.5::DOUBLE END AS mask_similarity
FROM (SELECT *, o_orderkey % 7 > 1 AS ok FROM orders)"""


def _shown(rows):
    return rows.select(
        "vid",
        "text_query",
        "target_object",
        "success",
        "bbox.xmin",
        F.round("confidence", 6).alias("confidence"),
        "mask_path",
        "failure_reason",
        F.try_element_at("extras", F.lit("clip_mask_similarity")).alias("mask_similarity"),
    )


@register(CASES, _EXPECTED.format(error="o_orderkey % 7 = 0 THEN 'subject_not_found'"))
def grounding_row(spark, folder):
    """Raw results: most succeed, some state why they failed, some are missing."""
    records = _records(spark, folder)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = records.filter("o_orderkey % 7 <> 1").select(
        "vid",
        (k % 7 > 1).alias("success"),
        box_of(c, F.lit(1), c + 5, F.lit(9)).alias("bbox"),
        F.when(k % 4 > 0, c / 1000.0).alias("box_similarity"),
        F.lit(0.5).alias("mask_similarity"),
        F.lit(12.3).alias("mask_coverage"),
        F.when(k % 7 == 0, "subject_not_found").alias("failure_reason"),
    )
    return _shown(grounding_rows(records, raw, "direct"))


def _score(model: float, rows: pd.DataFrame) -> pd.DataFrame:
    """A stand-in model that cannot handle some rows: a batch holding one fails and is scored in parts."""
    key = rows["o_orderkey"].to_numpy()
    if len(rows) == 1 and key[0] % 350 == 7:
        raise ValueError(f"cannot score {key[0]}")
    if (key % 350 == 7).any():
        raise ValueError("bad batch")
    custkey = rows["o_custkey"].to_numpy()
    boxes = [{"xmin": int(c), "ymin": 1, "xmax": int(c) + 5, "ymax": 9} for c in custkey]
    return pd.DataFrame(
        {
            "vid": rows["vid"].to_numpy(),
            "success": key % 7 > 1,
            "bbox": boxes,
            "box_similarity": np.where(key % 4 > 0, custkey / 1000.0, np.nan),
            "mask_similarity": model,
        }
    )


def _registry() -> Registry:
    registry = Registry()
    registry.register("half", Plugin(_score, load=lambda: 0.5))
    registry.register("other", Plugin(_score, load=lambda: 0.25))
    return registry


@register(CASES, _EXPECTED.format(error="o_orderkey % 350 = 7 THEN 'cannot score ' || o_orderkey"))
def score_plugin(spark, folder):
    return _shown(ground(_records(spark, folder), _registry(), "half"))


@register(
    CASES,
    """
    SELECT method, count(*) AS scored, count(*) FILTER (o_orderkey % 7 > 1) AS succeeded, CASE method WHEN 'half' THEN 0.5 ELSE 0.25 END::DOUBLE AS similarity
    FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'half' ELSE 'other' END AS method FROM orders) GROUP BY method
    """,
)
def score_routing(spark, folder):
    status = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("vid"),
        F.when(F.col("o_orderstatus") == "F", "half").otherwise("other").alias("method"),
    )
    records = _records(spark, folder).join(status, "vid")
    raw = run_scorers(records, _registry()).join(status, "vid")
    return raw.groupBy("method").agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if("success").alias("succeeded"),
        F.max(F.when(F.col("success"), F.col("mask_similarity"))).alias("similarity"),
    )


def _drift(model: None, rows: pd.DataFrame):
    """A stand-in propagator: the box moves right by one pixel per frame."""
    row = rows.iloc[0]
    frames = np.arange(row["num_frames"])
    for part in np.array_split(frames, max(1, len(frames) // 1000)):
        yield pd.DataFrame(
            {"vid": row["vid"], "frame_idx": part, "y": 2, "x0": part + row["user_id"], "x1": part + row["user_id"] + 3}
        )


@register(
    CASES,
    f"""
    WITH {EVENT_CLIPS}
    SELECT vid, f AS frame_idx, 2 AS y, f + user_id AS x0, f + user_id + 3 AS x1 FROM (SELECT *, unnest(range(num_frames)) AS f FROM clips)
    """,
)
def propagate_plugin(spark, folder):
    clips = event_clips(spark, folder).withColumn("backend", F.lit("drift"))
    return run_propagators(clips, Registry({"drift": Plugin(_drift)}))


# A flow over orders: the line items of an order are tubes of its tube set, on frames 0 to 3.
_FLOW = """
items AS (SELECT DISTINCT l_orderkey AS k, l_linenumber % 3 AS tube, l_suppkey % 4 AS frame FROM lineitem),
pixels AS (SELECT DISTINCT k, tube, frame, y, unnest(range(x0, x1)) AS x FROM (
  SELECT l_orderkey AS k, l_linenumber % 3 AS tube, l_suppkey % 4 AS frame, l_partkey % 5 AS y, l_partkey % 20 AS x0,
    least(64, l_partkey % 20 + CAST(l_quantity AS BIGINT)) AS x1 FROM lineitem)),
clips AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS box_ok, o_orderkey % 4 AS frame, 4 AS n, o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AS listed, o_orderkey % 13 > 0 AND o_orderkey % 3 > 0 AND o_orderkey IN (SELECT k FROM items) AS tubes_ok,
  o_orderstatus = 'F' AND o_orderkey % 7 > 0 AS has_box, greatest(0, o_custkey % 60 - 5) AS x1, greatest(0, o_custkey % 9 - 1) AS y1,
  least(64, o_custkey % 60 - 5 + o_orderkey % 50) AS x2, least(12, o_custkey % 9 + o_orderkey % 12) AS y2 FROM orders),
scored AS (SELECT c.k, i.tube, count(p.x) AS area, count(p.x) FILTER (p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2) AS inter
  FROM clips c JOIN items i ON c.k = i.k AND c.frame = i.frame LEFT JOIN pixels p ON p.k = i.k AND p.tube = i.tube AND p.frame = i.frame
  WHERE listed AND has_box AND tubes_ok GROUP BY ALL),
picked AS (SELECT k, arg_max(tube, (CASE WHEN area > 0 THEN inter / area::DOUBLE ELSE 0 END, -tube)) AS tube,
  max(CASE WHEN area > 0 THEN inter / area::DOUBLE ELSE 0 END) AS ratio FROM scored GROUP BY k),
decided AS (SELECT c.*, p.tube, CASE WHEN NOT listed THEN 'no_output' WHEN box_ok AND tubes_ok THEN CASE WHEN p.tube IS NULL AND has_box THEN 'box_propagation' ELSE 'tube_selection' END
  WHEN box_ok THEN 'box_propagation' ELSE 'no_output' END AS method FROM clips c LEFT JOIN (FROM picked WHERE ratio >= 0.2) p ON c.k = p.k),
masks AS (SELECT d.k, count(*) AS m FROM decided d JOIN items i ON d.k = i.k AND d.tube = i.tube WHERE method = 'tube_selection' GROUP BY d.k
  UNION ALL SELECT k, n FROM decided WHERE method = 'box_propagation' AND has_box)"""


def _flow(spark, folder):
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    key_frames = orders.select(
        F.concat(F.lit("o"), k).alias("vid"),
        k,
        F.when(k % 13 > 0, F.concat(F.lit("/v/"), k)).alias("video_path"),
        F.lit("a thing").alias("text_query"),
        F.lit("thing").alias("target_object"),
        (k % 4).alias("original_frame_idx"),
        F.lit(0).alias("key_frame_idx"),
    )
    grounding = orders.filter("o_orderstatus <> 'P'").select(
        F.concat(F.lit("o"), k).alias("vid"),
        (F.col("o_orderstatus") == "F").alias("success"),
        F.lit("").alias("answer"),
        F.when(k % 7 > 0, order_box()).alias("bbox"),
    )
    # Some clips have no path, some paths are not listed.
    media = key_frames.filter("o_orderkey % 11 > 0 AND video_path IS NOT NULL").select(
        "video_path", *[F.lit(v).cast("long").alias(n) for n, v in (("num_frames", 4), ("height", 12), ("width", 64))]
    )
    sets = orders.filter("o_orderkey % 3 > 0").select(
        k.alias("set_id"),
        F.concat(F.lit("o"), k).alias("base_vid"),
        F.lit("thing").alias("prompt"),
        F.concat(F.lit("/v/"), k).alias("video_path"),
        F.lit(3).alias("num_tubes"),
    )
    items = table(spark, folder, "lineitem")
    tube = [
        F.col("l_orderkey").alias("set_id"),
        (F.col("l_linenumber") % 3).cast("long").alias("tube_id"),
        (F.col("l_suppkey") % 4).alias("frame_idx"),
    ]
    size = {"height": F.lit(12).cast("long"), "width": F.lit(64).cast("long")}
    frames = cut_lineage(items.select(*tube).distinct()).withColumns(size)
    left = F.col("l_partkey") % 20
    spans = items.select(
        *tube,
        (F.col("l_partkey") % 5).alias("y"),
        left.alias("x0"),
        F.least(F.lit(64), left + F.col("l_quantity").cast("long")).alias("x1"),
    )
    spans = union_runs(spans, ["set_id", "tube_id", "frame_idx"])
    return propagate(key_frames, grounding, media, sets, frames, spans, "relative", 0.2)


@register(
    CASES,
    f"""
    WITH {_FLOW},
    joined AS (SELECT d.*, coalesce(m, 0) AS m FROM decided d LEFT JOIN masks USING (k)),
    f AS (SELECT *, CASE WHEN NOT listed THEN 'video_not_found' WHEN m = 1 THEN 'insufficient_masks_propagation_failed' WHEN m = 0 THEN
      CASE WHEN method = 'box_propagation' OR (box_ok AND NOT tubes_ok) THEN 'oom_or_propagation_failed' ELSE 'no_masks_generated' END END AS failure_reason FROM joined)
    SELECT 'o' || k AS vid, method, tube AS selected_tube_id, failure_reason, CASE WHEN failure_reason IS NULL THEN m ELSE 0 END AS num_masks,
      CASE WHEN failure_reason IS NULL THEN 'success' ELSE 'failed' END AS status FROM f
    """,
)
def propagation_flow(spark, folder):
    return _flow(spark, folder).outcomes.select(
        "vid", "method", "selected_tube_id", "failure_reason", "num_masks", "status"
    )


@register(
    CASES,
    f"""
    WITH {_FLOW},
    out_frames AS (SELECT d.k, i.frame FROM decided d JOIN items i ON d.k = i.k AND d.tube = i.tube WHERE method = 'tube_selection'
      UNION ALL SELECT k, unnest(range(n)) FROM decided WHERE method = 'box_propagation' AND has_box),
    out_pixels AS (SELECT d.k, p.frame, x, y FROM decided d JOIN pixels p ON d.k = p.k AND d.tube = p.tube WHERE method = 'tube_selection'
      UNION ALL SELECT k, frame, x, unnest(range(y1, y2)) FROM (SELECT k, f AS frame, y1, y2, unnest(range(x1, x2)) AS x
        FROM (SELECT *, unnest(range(n)) AS f FROM decided WHERE method = 'box_propagation' AND has_box)))
    SELECT 'o' || f.k AS vid, f.frame AS frame_idx, count(x) AS area, min(x) AS xmin, max(y) AS ymax FROM out_frames f
    LEFT JOIN out_pixels p ON f.k = p.k AND f.frame = p.frame GROUP BY ALL
    """,
)
def propagation_masks(spark, folder):
    result = _flow(spark, folder)
    stats = mask_stats(result.spans, result.frames, ["vid", "frame_idx"])
    return stats.select("vid", "frame_idx", "area", "xmin", "ymax")


@register(
    CASES,
    """
    SELECT user_id, count(*) AS num_frames, arg_max(event_id, (value, -event_id)) AS key_frame_idx, round(max(value), 6) AS max_similarity
    FROM events GROUP BY user_id
    """,
)
def incremental(spark, folder):
    """Key frames of all files that arrived, processed as a stream of batches and read back as one table."""
    run = shared_folder(spark, "incremental")
    events = table(spark, folder, "events")

    def process(batch):
        scores = batch.select("user_id", F.col("event_id").alias("sample_idx"), F.col("value").alias("score"))
        return pick_key_frames(scores, ["user_id"], carry=())

    run_incremental(
        spark, folder, events.schema, process, f"{run}/out", f"{run}/state", fmt="parquet", pathGlobFilter="events.parquet"
    )
    parts = spark.read.parquet(f"{run}/out")
    rank = F.struct(F.col("max_similarity"), -F.col("key_frame_idx"))
    return parts.groupBy("user_id").agg(
        F.sum("num_sampled_frames").alias("num_frames"),
        F.max_by("key_frame_idx", rank).alias("key_frame_idx"),
        F.round(F.max("max_similarity"), 6).alias("max_similarity"),
    )


#: Days of a month that arrive together, and files of a batch.
_ARRIVALS, _BATCH_FILES = ((1, 10), (11, 20), (21, 31)), 4


@register(
    CASES,
    """
    SELECT arrival, user_id, count(*) AS num_frames, arg_max(event_id, (value, -event_id)) AS key_frame_idx,
      round(max(value), 6) AS max_similarity, round(sum(value), 2) AS sum_similarity
    FROM events JOIN (SELECT unnest([0, 1, 2]) AS arrival, unnest([10, 20, 31]) AS last) ON day(ts) <= last
    GROUP BY arrival, user_id
    """,
)
def incremental_state(spark, folder):
    """Events arrive as one file per day, in three turns of several batches; after each turn: all clips over all files so far."""
    run = shared_folder(spark, "incremental")
    days = table(spark, folder, "events").select("user_id", "event_id", "value", F.dayofmonth("ts").alias("day"))
    schema = days.drop("day").schema

    def summarise(events):
        scores = events.select("user_id", F.col("event_id").alias("sample_idx"), F.col("value").alias("score"))
        return pick_key_frames(scores, ["user_id"], carry=())

    turns = []
    for turn, (first, last) in enumerate(_ARRIVALS):
        new = days.filter(F.col("day").between(first, last)).repartition("day")
        new.write.mode("append").partitionBy("day").parquet(f"{run}/in")
        batches = run_stateful(
            spark, f"{run}/in/*", schema, summarise, f"{run}/out", f"{run}/state", fmt="parquet", max_files=_BATCH_FILES
        )
        turns.append((turn, batches[-1]))
    totals = None
    for turn, upto in turns:
        part = current_rows(spark, f"{run}/out", ["user_id"], upto).select(
            F.lit(turn).alias("arrival"),
            "user_id",
            F.col("num_sampled_frames").alias("num_frames"),
            "key_frame_idx",
            F.round("max_similarity", 6).alias("max_similarity"),
            F.round(F.col("mean_similarity") * F.col("num_sampled_frames"), 2).alias("sum_similarity"),
        )
        totals = part if totals is None else totals.unionByName(part)
    return totals
