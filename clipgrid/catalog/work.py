"""Joins between steps, finished work, limits, outcomes and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clipgrid.catalog.base import MASK_FRAMES, Case, key_boxes, mask_frames, register, table
from clipgrid.functions.names import base_vid, clip_idx, output_key
from clipgrid.operators import joins as J
from clipgrid.operators import outcomes as U
from clipgrid.operators import report as R
from clipgrid.operators import resume as W
from clipgrid.operators.validate import propagation_error, split_valid
from clipgrid.session import shared_folder
from clipgrid.sinks.tables import key_frame_rows, run_summaries, store_by_key

CASES: dict[str, Case] = {}


def _key_frames(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("o"), k).alias("vid"),
        F.when(k % 9 > 0, F.concat(F.lit("/v/"), "o_custkey", F.lit(".mp4"))).alias("video_path"),
        F.concat(F.lit("/k/"), k, F.lit(".png")).alias("key_frame_path"),
        F.when(k % 4 > 0, k * 3).alias("original_frame_idx"),
        F.when(k % 10 > 0, k).alias("key_frame_idx"),
        F.col("o_orderpriority").alias("text_query"),
        F.lit("thing").alias("target_object"),
        "o_custkey",
    )


_KEY_FRAMES = """
key_frames AS (
  SELECT 'o' || o_orderkey AS vid, o_orderkey AS k, CASE WHEN o_orderkey % 9 > 0 THEN '/v/' || o_custkey || '.mp4' END AS video_path,
    '/k/' || o_orderkey || '.png' AS key_frame_path,
    coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 3 END, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey END) AS frame,
    o_orderpriority AS text_query FROM orders)"""


def _grounding(spark, folder):
    """Grounding of all orders but those of one status; a fifth has no box and some boxes are of failures."""
    boxes = key_boxes(spark, folder).select("vid", "bbox")
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(
        F.concat(F.lit("o"), k).alias("vid"),
        k,
        F.col("o_orderpriority").alias("text_query"),
        F.when(k % 3 == 0, "").otherwise("thing").alias("target_object"),
        F.when(k % 2 == 0, F.concat(F.lit("a"), k)).otherwise("").alias("answer"),
        (F.col("o_orderstatus") == "F").alias("success"),
        F.lit("direct").alias("method"),
    )
    joined = rows.join(boxes, "vid")
    return joined.withColumn("bbox", F.when(k % 5 > 0, F.col("bbox"))).drop("o_orderkey")


_GROUNDING = """
grounding AS (
  SELECT 'o' || o_orderkey AS vid, o_orderkey AS k, o_orderpriority AS text_query, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'thing' END AS target_object,
    CASE WHEN o_orderkey % 2 = 0 THEN 'a' || o_orderkey ELSE '' END AS answer, o_orderstatus = 'F' AS success,
    CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 60 - 5 END AS xmin FROM orders WHERE o_orderstatus <> 'P')"""


@register(
    CASES,
    f"""
    WITH {_KEY_FRAMES}, {_GROUNDING},
    joined AS (SELECT f.vid, f.video_path, f.frame AS key_frame_idx, g.success AS grounding_success, xmin,
        coalesce(nullif(answer, ''), nullif(target_object, ''), g.text_query) AS prompt,
        nullif(concat_ws(', ', CASE WHEN video_path IS NULL THEN 'video_path' END, CASE WHEN frame IS NULL THEN 'key_frame_idx' END,
          CASE WHEN xmin IS NULL THEN 'bbox' END), '') AS error
      FROM key_frames f JOIN grounding g ON f.vid = g.vid)
    SELECT *, error IS NULL AS valid FROM joined
    """,
)
def stage_join_inner(spark, folder):
    rows = J.propagation_inputs(_key_frames(spark, folder), _grounding(spark, folder))
    good, bad = split_valid(rows, propagation_error(rows))
    columns = ["vid", "video_path", "key_frame_idx", "grounding_success", "bbox.xmin", "prompt"]
    return good.select(*columns, F.lit(None).cast("string").alias("error"), F.lit(True).alias("valid")).unionByName(
        bad.select(*columns, "error", F.lit(False).alias("valid"))
    )


@register(
    CASES,
    f"""
    WITH {_KEY_FRAMES}, {_GROUNDING}
    SELECT f.vid, coalesce(g.success, FALSE) AS success, g.xmin, g.answer, CASE WHEN g.success AND g.xmin IS NOT NULL THEN g.xmin END AS alternate_xmin
    FROM key_frames f LEFT JOIN grounding g ON f.vid = g.vid
    """,
)
def stage_join_left(spark, folder):
    grounding = _grounding(spark, folder)
    rows = J.with_grounding(_key_frames(spark, folder), grounding)
    both = J.alternate_boxes(rows, grounding)
    return both.select("vid", "success", "bbox.xmin", "answer", F.col("alternate_bbox.xmin").alias("alternate_xmin"))


@register(
    CASES,
    f"""
    WITH {_KEY_FRAMES}
    SELECT l_orderkey, l_linenumber, l_partkey, key_frame_path FROM lineitem LEFT JOIN (FROM key_frames WHERE k % 3 > 0) ON k = l_orderkey
    """,
)
def result_key_frames(spark, folder):
    records = _key_frames(spark, folder).filter("substr(vid, 2) % 3 > 0")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    results = table(spark, folder, "lineitem").select(*keys, F.concat(F.lit("o"), "l_orderkey").alias("vid"))
    return J.with_key_frame_path(results, records).select(*keys, "key_frame_path")


@register(
    CASES,
    """
    SELECT o_orderkey, o_custkey AS a, o_custkey * 2 AS b, o_custkey * 3 AS c FROM orders
    WHERE o_orderkey % 5 > 0 AND o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
    """,
)
def step_survivors(spark, folder):
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey").alias("vid")
    first = orders.filter("o_orderkey % 5 > 0").select(key, F.col("o_custkey").alias("a"))
    second = orders.filter("o_orderstatus <> 'P'").select(key, (F.col("o_custkey") * 2).alias("b"))
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("vid")).distinct()
    third = orders.select(key, (F.col("o_custkey") * 3).alias("c")).join(items, "vid", "left_semi")
    rows = J.survivors(orders.select(key), [first, second, third])
    return rows.select(F.col("vid").alias("o_orderkey"), "a", "b", "c")


@register(
    CASES,
    """
    SELECT doc_id, CASE WHEN quality = 1 THEN 'out/masks/doc/' || doc_id || '/mask.npy' END AS mask_path, quality IS NOT NULL AS has_image
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def attach_existing(spark, folder):
    labels = table(spark, folder, "labels")
    vid = F.concat(F.lit("doc_"), "doc_id")
    mask = F.concat(output_key("out", "masks", vid), F.lit("/mask.npy"))
    files = labels.filter("quality = 1").select(mask.alias("path"))
    images = labels.select(F.concat(F.lit("i"), "doc_id").alias("path"))
    rows = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("i"), "doc_id").alias("image_path"))
    attached = J.attach_existing(rows, files, mask, "mask_path")
    seen = J.filter_existing(attached, images, "image_path").select("doc_id", F.lit(True).alias("has_image"))
    return attached.join(seen, "doc_id", "left").select(
        "doc_id", "mask_path", F.coalesce("has_image", F.lit(False)).alias("has_image")
    )


_LEFT = """
    WITH files AS (SELECT DISTINCT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'metadata.json' WHEN 1 THEN 'key_frame.png' WHEN 2 THEN 'similarity_scores.npy'
      ELSE 'other.txt' END AS name FROM lineitem),
    finished AS (SELECT l_orderkey FROM files WHERE name <> 'other.txt' GROUP BY ALL HAVING count(*) = 3)
    SELECT 'key frames' AS policy, o_orderkey FROM orders WHERE o_orderkey NOT IN (FROM finished)
    UNION ALL SELECT 'grounding', o_orderkey FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'forced', o_orderkey FROM orders
    UNION ALL SELECT 'success and mask', o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 3 > 0
    UNION ALL SELECT 'status', o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_orderstatus = 'P' OR o_orderkey % 4 = 0)
    UNION ALL SELECT 'status retry', o_orderkey FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 4 = 0
    """


def _resume_inputs(spark, folder):
    orders = table(spark, folder, "orders")
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    clips = orders.select(k.alias("vid"))
    names = F.element_at(
        F.array(*[F.lit(n) for n in ("metadata.json", "key_frame.png", "similarity_scores.npy", "other.txt")]),
        (F.col("l_linenumber") % 4 + 1).cast("int"),
    )
    files = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("vid"), names.alias("name"))
    grounding = orders.filter("o_orderstatus <> 'P'").select(k.alias("vid"))
    flags = orders.select(k.alias("vid"), F.when(status != "P", status == "F").alias("success"))
    masks = orders.filter("o_orderkey % 3 = 0").select(k.alias("vid"))
    outcomes = orders.select(
        k.alias("vid"),
        F.when(status == "F", "failed").when(status == "O", "success").alias("status"),
        F.when(status == "O", F.when(k % 4 > 0, 5).otherwise(0)).alias("num_masks"),
    )
    return {"clips": clips, "files": files, "grounding": grounding, "flags": flags, "masks": masks, "outcomes": outcomes}


def _left_by_policy(t):
    left = {
        "key frames": W.drop_finished_key_frames(t["clips"], t["files"], ["vid"]),
        "grounding": W.drop_grounded(t["clips"], t["grounding"]),
        "forced": W.drop_grounded(t["clips"], t["grounding"], force=True),
        "success and mask": W.drop_succeeded(t["clips"], t["flags"], t["masks"]),
        "status": W.drop_by_status(t["clips"], t["outcomes"]),
        "status retry": W.drop_by_status(t["clips"], t["outcomes"], retry_failed=True),
    }
    result = None
    for policy, rows in left.items():
        part = rows.select(F.lit(policy).alias("policy"), F.col("vid").alias("o_orderkey"))
        result = part if result is None else result.unionByName(part)
    return result


@register(CASES, _LEFT)
def resume_policies(spark, folder):
    return _left_by_policy(_resume_inputs(spark, folder))


@register(CASES, _LEFT)
def resume_stored(spark, folder):
    """The same over tables that were stored by clip, so that neither side of an anti-join is shuffled."""
    path, name = shared_folder(spark, "stored"), f"stored_{uuid.uuid4().hex}"
    inputs = _resume_inputs(spark, folder)
    return _left_by_policy({k: store_by_key(rows, f"{name}_{k}", f"{path}/{k}", buckets=8) for k, rows in inputs.items()})



_LIMIT = """
clips AS (SELECT 'v' || o_custkey || '_' || o_orderkey AS vid, 'v' || o_custkey AS base, o_orderkey AS idx, o_orderstatus FROM orders)"""


@register(
    CASES,
    f"""
    WITH {_LIMIT}
    SELECT 'before' AS rule, vid FROM (FROM clips ORDER BY base, idx LIMIT 40) WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'after', vid FROM (SELECT vid FROM clips WHERE o_orderstatus <> 'F' ORDER BY vid LIMIT 40)
    """,
)
def limit_before_after(spark, folder):
    """A limit is the feature here: before or after finished clips are removed."""
    vid = F.concat(F.lit("v"), "o_custkey", F.lit("_"), "o_orderkey").alias("vid")
    clips = table(spark, folder, "orders").select(vid)
    done = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(vid)
    outcomes = done.withColumns({"status": F.lit("success"), "num_masks": F.lit(3)})
    before = W.limit_then_drop(clips, 40, done).select(F.lit("before").alias("rule"), "vid")
    return before.unionByName(W.drop_then_limit(clips, 40, outcomes).select(F.lit("after").alias("rule"), "vid"))


@register(
    CASES,
    """
    WITH counts AS (SELECT o_custkey % 8 AS bucket, count(*) AS total FROM orders GROUP BY ALL),
    batches AS (SELECT bucket, total, unnest(range((total + 31) // 32)) AS batch_id FROM counts)
    SELECT bucket, batch_id, least(32, total - 32 * batch_id) AS size, least(32, total - 32 * batch_id) AS clips FROM batches
    """,
)
def request_batches(spark, folder):
    """Batches are full except the last of a bucket, and their numbers have no gaps."""
    rows = table(spark, folder, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("vid"), "o_custkey")
    batched = W.request_batches(rows, 32, bucket=F.col("o_custkey") % 8)
    return batched.groupBy("bucket", "batch_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("vid").alias("clips"))


@register(
    CASES,
    f"""
    WITH {MASK_FRAMES},
    counts AS (SELECT vid, count(*) AS n FROM mask_frames GROUP BY vid),
    r AS (SELECT 'o' || o_orderkey AS vid, o_orderstatus = 'F' AS box_ok, o_orderkey % 3 = 0 AS tubes_ok, o_orderkey % 2 = 0 AS has_box,
      CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS tube FROM orders),
    m AS (SELECT r.*, coalesce(n, 0) AS masks, CASE WHEN box_ok AND tubes_ok THEN CASE WHEN tube IS NULL AND has_box THEN 'box_propagation' ELSE 'tube_selection' END
        WHEN box_ok THEN 'box_propagation' ELSE 'no_output' END AS method FROM r LEFT JOIN counts c ON r.vid = c.vid),
    f AS (SELECT *, CASE WHEN masks = 1 THEN 'insufficient_masks_propagation_failed' WHEN masks = 0 THEN
        CASE WHEN method = 'box_propagation' OR (box_ok AND NOT tubes_ok) THEN 'oom_or_propagation_failed' ELSE 'no_masks_generated' END END AS failure_reason FROM m)
    SELECT vid, method, failure_reason, CASE WHEN failure_reason IS NULL THEN 'success' ELSE 'failed' END AS status,
      CASE WHEN failure_reason IS NULL THEN masks ELSE 0 END AS num_masks FROM f
    """,
)
def clip_outcomes(spark, folder):
    return _outcomes(spark, folder).select("vid", "method", "failure_reason", "status", "num_masks")


def _outcomes(spark, folder):
    k = F.col("o_orderkey")
    clips = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), k).alias("vid"),
        (F.col("o_orderstatus") == "F").alias("box_ok"),
        (k % 3 == 0).alias("tubes_ok"),
        (k % 2 == 0).alias("has_box"),
        F.when(k % 4 == 0, 1).alias("tube"),
        "o_orderpriority",
    )
    method = U.propagation_method(F.col("box_ok"), F.col("has_box"), F.col("tubes_ok"), F.col("tube"))
    return U.outcome_rows(clips.withColumn("method", method), mask_frames(spark, folder))


@register(
    CASES,
    """
    SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed,
      round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 6)::DOUBLE AS success_rate FROM orders GROUP BY ALL
    """,
)
def worker_counts(spark, folder):
    flagged = table(spark, folder, "orders").withColumn("success", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))
    counts = R.outcome_counts(flagged, F.col("success"), ["o_orderpriority"])
    return counts.withColumn("success_rate", F.round("success_rate", 6))


@register(
    CASES,
    """
    SELECT o_orderpriority, o_orderkey % 3 AS part, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS succeeded,
      count(*) FILTER (o_orderstatus <> 'F') AS failed, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 6)::DOUBLE AS success_rate,
      grouping(o_orderpriority, o_orderkey % 3) AS level
    FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderkey % 3)
    """,
)
def outcome_rollup(spark, folder):
    rows = table(spark, folder, "orders").withColumn("part", F.col("o_orderkey") % 3)
    rolled = R.outcome_rollup(rows, F.col("o_orderstatus") == "F", ["o_orderpriority", "part"])
    return rolled.withColumn("success_rate", F.round("success_rate", 6))


@register(
    CASES,
    """
    SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS skipped, count(*) FILTER (o_orderstatus <> 'F') AS processed,
      count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS succeeded,
      count(*) FILTER (o_orderstatus <> 'F') - count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS failed,
      round(count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) * 100.0 / count(*) FILTER (o_orderstatus <> 'F'), 6)::DOUBLE AS success_rate
    FROM orders
    """,
)
def run_summary(spark, folder):
    orders = table(spark, folder, "orders")
    results = orders.filter("o_orderstatus = 'O'").withColumn("success", F.col("o_orderkey") % 2 == 0)
    summary = R.run_summary(orders, orders.filter("o_orderstatus <> 'F'"), results, F.col("success"))
    return summary.withColumn("success_rate", F.round("success_rate", 6))


@register(
    CASES,
    """
    SELECT user_id, count(*) AS num_frames, round(min(value), 6) AS min_score, round(max(value), 6) AS max_score, round(avg(value), 6) AS mean_score
    FROM events GROUP BY user_id
    """,
)
def score_stats(spark, folder):
    stats = R.score_stats(table(spark, folder, "events"), ["user_id"], "value")
    return stats.select(
        "user_id", "num_frames", *[F.round(c, 6).alias(c) for c in ("min_score", "max_score", "mean_score")]
    )


@register(
    CASES,
    """
    SELECT 'o' || o_orderkey AS vid, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 END AS begin_frame, CASE WHEN o_orderkey % 2 = 0 THEN '' || o_custkey END AS ann_target_id,
      CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS ann_used_relation, NULL::VARCHAR AS ann_used_segment
    FROM orders
    """,
)
def key_frame_records(spark, folder):
    """Annotation fields of a record are null unless they say something."""
    k = F.col("o_orderkey")
    empty = F.from_json(F.lit("{}"), "map<string,bigint>")
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), k).alias("vid"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("video_path", "string"), ("text_query", "string"), ("target_object", "string"))],
        k.alias("key_frame_idx"),
        k.alias("original_frame_idx"),
        F.lit(1).alias("num_sampled_frames"),
        F.lit(0.5).alias("max_similarity"),
        F.lit(3.0).alias("sampling_fps"),
        F.lit(1).alias("sentence_index"),
        F.when(k % 3 > 0, F.create_map(F.lit("begin"), k % 7)).otherwise(empty).alias("ann_temporal_gt"),
        F.when(k % 2 == 0, F.col("o_custkey").cast("string")).alias("ann_target_id"),
        F.when(k % 5 > 0, F.col("o_orderpriority")).otherwise("").alias("ann_used_relation"),
        F.lit("").alias("ann_used_segment"),
    )
    begin = F.try_element_at("ann_temporal_gt", F.lit("begin")).alias("begin_frame")
    return key_frame_rows(rows).select("vid", begin, "ann_target_id", "ann_used_relation", "ann_used_segment")


@register(
    CASES,
    f"""
    WITH {MASK_FRAMES}, counts AS (SELECT vid, count(*) AS n FROM mask_frames GROUP BY vid)
    SELECT 'o' || o_orderkey AS vid, '{{"video_id":"o' || o_orderkey || '","text_query":"' || o_orderpriority || '","key_frame_idx":' || o_custkey || ',"num_frames":4,"num_masks":'
      || coalesce(n, 0) || ',"success":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || ',"error_message":'
      || CASE WHEN o_orderstatus = 'O' THEN '"lost"' ELSE 'null' END || '}}' AS summary
    FROM orders LEFT JOIN counts ON vid = 'o' || o_orderkey
    """,
)
def run_summaries_json(spark, folder):
    orders = table(spark, folder, "orders").withColumn("vid", F.concat(F.lit("o"), "o_orderkey"))
    key_frames = orders.select(
        "vid",
        F.col("o_orderpriority").alias("text_query"),
        F.col("o_custkey").alias("key_frame_idx"),
        F.lit(4).alias("num_sampled_frames"),
    )
    outcomes = orders.filter("o_orderstatus <> 'P'").select(
        "vid",
        (F.col("o_orderstatus") == "F").alias("success"),
        F.when(F.col("o_orderstatus") == "O", "lost").alias("error_message"),
    )
    return run_summaries(key_frames, mask_frames(spark, folder), outcomes)


@register(
    CASES,
    """
    SELECT 'v' || o_custkey || '_' || o_orderkey AS vid, 'v' || o_custkey AS base_vid, CAST(o_orderkey AS VARCHAR) AS idx, source FROM orders,
      (SELECT unnest(['first', 'second']) AS source)
    """,
)
def tasks_kept_whole(spark, folder):
    """Two task lists are put together without removing duplicates."""
    vid = F.concat(F.lit("v"), "o_custkey", F.lit("_"), "o_orderkey")
    rows = table(spark, folder, "orders").select(vid.alias("vid"))
    both = rows.withColumn("source", F.lit("first")).unionByName(rows.withColumn("source", F.lit("second")))
    return both.select("vid", base_vid(F.col("vid")).alias("base_vid"), clip_idx(F.col("vid")).alias("idx"), "source")
