"""Identifiers, boxes, scalars and row checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrid.catalog.base import (
    EVENT_CLIPS,
    KEY_BOXES,
    Case,
    event_clips,
    key_boxes,
    register,
    table,
)
from clipgrid.functions import boxes as B
from clipgrid.functions import choices as C
from clipgrid.functions import names as N
from clipgrid.functions import scores as S
from clipgrid.operators import validate as V
from clipgrid.operators.skew import with_group_stats

CASES: dict[str, Case] = {}


@register(
    CASES,
    r"""
    SELECT page_id, vid, CASE WHEN cut > 0 THEN left(vid, cut - 1) ELSE vid END AS base_vid,
      CASE WHEN cut > 0 THEN substr(vid, cut + 1) END AS idx,
      CASE WHEN cut > 0 THEN left(vid, cut - 1) || '/' || substr(vid, cut + 1) ELSE vid END || '/end' AS recomposed,
      'out/stage/' || CASE WHEN cut > 0 THEN left(vid, cut - 1) || '/' || substr(vid, cut + 1) ELSE vid END AS folder
    FROM (SELECT *, CASE WHEN contains(vid, '_') THEN length(vid) - instr(reverse(vid), '_') + 1 ELSE 0 END AS cut
          FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '_' || page_id ELSE url END AS vid FROM pages))
    """,
)
def vid_split(spark, folder):
    url = F.col("url")
    vid = F.when(F.col("page_id") % 3 == 0, N.compose_vid(url, F.col("page_id"))).otherwise(url)
    rows = table(spark, folder, "pages").select("page_id", vid.alias("vid"))
    v = F.col("vid")
    return rows.select(
        "page_id",
        "vid",
        N.base_vid(v).alias("base_vid"),
        N.clip_idx(v).alias("idx"),
        F.concat_ws("/", N.base_vid(v), N.clip_idx(v), F.lit("end")).alias("recomposed"),
        N.output_key("out", "stage", v).alias("folder"),
    )


@register(
    CASES,
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, xmin, ymin, xmax, ymax, xmax - xmin AS width,
      ymax - ymin AS height, (xmax - xmin) * (ymax - ymin) AS area,
      round((xmin + xmax) / 2.0 / 1366, 6) AS cx, round((ymin + ymax) / 2.0 / 700, 6) AS cy,
      round((xmax - xmin) / 1366, 6) AS w, round((ymax - ymin) / 700, 6) AS h
    FROM (SELECT *, l_partkey % 800 AS xmin, l_suppkey % 500 AS ymin,
            CAST(trunc(l_partkey % 800 + l_quantity * 1.7) AS BIGINT) AS xmax,
            CAST(trunc(l_suppkey % 500 + l_linenumber * 10.9) AS BIGINT) AS ymax FROM lineitem)
    """,
)
def box_geometry(spark, folder):
    x, y = F.col("l_partkey") % 800, F.col("l_suppkey") % 500
    box = B.box_of(x, y, x + F.col("l_quantity") * 1.7, y + F.col("l_linenumber") * 10.9)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, folder, "lineitem").select(*keys, box.alias("b"))
    b = F.col("b")
    rows = rows.withColumn("n", B.box_normalised(b, F.lit(1366), F.lit(700)))
    return rows.select(
        *keys,
        "b.xmin",
        "b.ymin",
        "b.xmax",
        "b.ymax",
        B.box_width(b).alias("width"),
        B.box_height(b).alias("height"),
        B.box_area(b).alias("area"),
        *[F.round(f"n.{c}", 6).alias(c) for c in ("cx", "cy", "w", "h")],
    )


@register(
    CASES,
    """
    SELECT l_orderkey, l_linenumber, l_partkey, missing,
      CASE WHEN missing = '' AND (xmax < xmin OR ymax < ymin) THEN 'inverted box' END AS error,
      missing = '' AND xmax >= xmin AND ymax >= ymin AS valid
    FROM (SELECT *, concat_ws(', ', CASE WHEN xmin IS NULL THEN 'xmin' END, CASE WHEN ymin IS NULL THEN 'ymin' END,
            CASE WHEN xmax IS NULL THEN 'xmax' END, CASE WHEN ymax IS NULL THEN 'ymax' END) AS missing
          FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 11 > 0 THEN l_partkey % 40 END AS xmin,
                  CASE WHEN l_partkey % 13 > 0 THEN l_suppkey % 30 END AS ymin,
                  CASE WHEN l_partkey % 17 > 0 THEN CAST(l_quantity AS BIGINT) END AS xmax,
                  l_linenumber * 5 AS ymax FROM lineitem))
    """,
)
def box_validate(spark, folder):
    p = F.col("l_partkey")
    sides = [
        F.when(p % 11 > 0, p % 40),
        F.when(p % 13 > 0, F.col("l_suppkey") % 30),
        F.when(p % 17 > 0, F.col("l_quantity")),
        F.col("l_linenumber") * 5,
    ]
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        B.missing_sides(*sides).alias("missing"),
        B.box_of(*sides).alias("b"),
    )
    error = B.box_error(F.col("b"))
    return rows.withColumn("error", error).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "missing",
        "error",
        (F.col("b").isNotNull() & F.col("error").isNull()).alias("valid"),
    )


@register(
    CASES,
    """
    WITH raw AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 800 - 30 AS xmin, l_suppkey % 500 - 20 AS ymin,
        l_partkey % 800 - 30 + CAST(l_quantity AS BIGINT) AS xmax, l_suppkey % 500 - 20 + l_linenumber AS ymax,
        l_quantity / 2 AS half, 640 AS w, 360 AS h FROM lineitem),
    r AS (SELECT *, greatest(0, least(w - 1, round_even(xmin + half, 0))) AS px0,
            greatest(0, least(h - 1, round_even(ymin + half, 0))) AS py0,
            round_even(xmax + half - 40, 0) AS rx1, round_even(ymax + half - 3, 0) AS ry1 FROM raw)
    SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, xmin) AS c_xmin, greatest(0, ymin) AS c_ymin,
      least(w, xmax) AS c_xmax, least(h, ymax) AS c_ymax, CAST(px0 AS BIGINT) AS p_xmin, CAST(py0 AS BIGINT) AS p_ymin,
      CAST(greatest(px0 + 1, least(w, rx1)) AS BIGINT) AS p_xmax,
      CAST(greatest(py0 + 1, least(h, ry1)) AS BIGINT) AS p_ymax FROM r
    """,
)
def box_clamp(spark, folder):
    x, y = F.col("l_partkey") % 800 - 30, F.col("l_suppkey") % 500 - 20
    x1, y1 = x + F.col("l_quantity").cast("long"), y + F.col("l_linenumber")
    half = F.col("l_quantity") / 2
    w, h = F.lit(640), F.lit(360)
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = table(spark, folder, "lineitem").select(
        *keys,
        B.clamp_box(B.box_of(x, y, x1, y1), w, h).alias("c"),
        B.clamp_box_to_pixel(x + half, y + half, x1 + half - 40, y1 + half - 3, w, h).alias("p"),
    )
    return rows.select(*keys, *[F.col(f"{k}.{s}").alias(f"{k}_{s}") for k in "cp" for s in B.SIDES])


@register(
    CASES,
    """
    SELECT l_orderkey, l_linenumber, l_partkey, mode,
      CASE WHEN scaled THEN CAST(trunc(x1 / 1000.0::DOUBLE * 1333) AS BIGINT) ELSE x1 END AS xmin,
      CASE WHEN scaled THEN CAST(trunc(y1 / 1000.0::DOUBLE * 777) AS BIGINT) ELSE y1 END AS ymin,
      CASE WHEN scaled THEN CAST(trunc(x2 / 1000.0::DOUBLE * 1333) AS BIGINT) ELSE x2 END AS xmax,
      CASE WHEN scaled THEN CAST(trunc(y2 / 1000.0::DOUBLE * 777) AS BIGINT) ELSE y2 END AS ymax
    FROM (SELECT *, mode = 'normalized' OR (mode = 'auto' AND greatest(x1, y1, x2, y2) <= 1000) AS scaled
      FROM (SELECT l_orderkey, l_linenumber, l_partkey,
        CASE l_linenumber % 3 WHEN 0 THEN 'pixel' WHEN 1 THEN 'normalized' ELSE 'auto' END AS mode,
        l_partkey % 1010 AS x1, l_suppkey % 700 AS y1, l_partkey % 1010 + CAST(l_quantity AS BIGINT) AS x2,
        l_suppkey % 700 + l_linenumber AS y2 FROM lineitem))
    """,
)
def coordinate_decode(spark, folder):
    x, y = F.col("l_partkey") % 1010, F.col("l_suppkey") % 700
    kind = F.col("l_linenumber") % 3
    mode = F.when(kind == 0, "pixel").when(kind == 1, "normalized").otherwise("auto")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "mode"]
    rows = table(spark, folder, "lineitem").select(
        *keys[:3],
        mode.alias("mode"),
        B.box_of(x, y, x + F.col("l_quantity"), y + F.col("l_linenumber")).alias("stated"),
    )
    decoded = B.decode_coordinates(F.col("stated"), F.lit(1333), F.lit(777), F.col("mode"))
    return rows.withColumn("b", decoded).select(*keys, *[F.col(f"b.{s}").alias(s) for s in B.SIDES])


@register(
    CASES,
    """
    WITH r AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS original, o_orderkey % 100 AS sampled,
        CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'dog' WHEN 2 THEN NULL ELSE ' ' END AS answer,
        CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE o_orderpriority END AS target,
        o_orderstatus AS query, CASE o_orderstatus WHEN 'P' THEN 'interrogative' ELSE 'declarative' END AS kind,
        CASE WHEN o_orderkey % 7 = 0 THEN ' forced ' WHEN o_orderkey % 7 = 1 THEN '  ' END AS override,
        CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice / 1000000 END AS box_sim, o_custkey / 10000.0 AS mask_sim
      FROM orders)
    SELECT o_orderkey, coalesce(original, sampled) AS read_frame,
      coalesce(nullif(answer, ''), nullif(target, ''), query) AS prompt,
      coalesce(nullif(trim(override), ''),
        CASE WHEN kind = 'declarative' THEN coalesce(target, query) ELSE coalesce(answer, query) END) AS prompt_by_type,
      round(coalesce(box_sim, mask_sim), 6) AS confidence
    FROM r
    """,
)
def frame_and_prompt(spark, folder):
    k = F.col("o_orderkey")
    answer = F.when(k % 4 == 0, "").when(k % 4 == 1, "dog").when(k % 4 == 3, " ")
    target = F.when(k % 5 == 0, "").when(k % 5 > 1, F.col("o_orderpriority"))
    kind = F.when(F.col("o_orderstatus") == "P", "interrogative").otherwise("declarative")
    override = F.when(k % 7 == 0, " forced ").when(k % 7 == 1, "  ")
    query = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        C.read_frame(F.when(k % 3 > 0, F.col("o_custkey")), k % 100).alias("read_frame"),
        C.prompt(answer, target, query).alias("prompt"),
        C.prompt_by_type(kind, target, answer, query, override=override).alias("prompt_by_type"),
        F.round(
            S.confidence(F.when(k % 6 > 0, F.col("o_totalprice") / 1000000), F.col("o_custkey") / 10000.0), 6
        ).alias("confidence"),
    )


@register(
    CASES,
    r"""
    SELECT doc_id,
      regexp_replace(regexp_replace(regexp_replace(trim(lower(text), chr(10) || ' '), '[^\p{L}\p{N}_\-]', '_', 'g'),
        '_+', '_', 'g'), '^_+|_+$', '', 'g') AS object_key,
      CASE WHEN kept = '' THEN 'unknown' ELSE replace(kept, ' ', '_') END AS prompt_key
    FROM (SELECT doc_id, text, trim(regexp_replace(text, '[^\p{L}\p{N}_\s\-]', '', 'g'), chr(10) || ' ') AS kept
          FROM documents)
    """,
)
def key_names(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", N.object_key(text).alias("object_key"), N.prompt_key(text).alias("prompt_key")
    )


@register(
    CASES,
    """
    SELECT event_id, round(1 / (1 + exp(l0 - l1)), 6) AS probability, round(coalesce(1 / (1 + exp(l0 - half)), image, 0.5), 6) AS score,
      round(CASE WHEN isnan(raw) THEN 0 WHEN isinf(raw) AND raw > 0 THEN 1 WHEN isinf(raw) THEN 0 ELSE raw END, 6) AS cleaned
    FROM (SELECT event_id, value / 100 AS l0, user_id / 50.0 AS l1, CASE WHEN event_id % 3 = 0 THEN user_id / 50.0 END AS half,
            CASE WHEN event_id % 2 = 0 THEN value / 1000 END AS image,
            CASE event_type WHEN 'error' THEN 'nan'::DOUBLE WHEN 'click' THEN 'inf'::DOUBLE WHEN 'view' THEN '-inf'::DOUBLE
              ELSE value END AS raw FROM events)
    """,
)
def match_scores(spark, folder):
    l0, l1 = F.col("value") / 100, F.col("user_id") / 50.0
    e, kind = F.col("event_id"), F.col("event_type")
    inf = float("inf")
    raw = (
        F.when(kind == "error", F.lit(float("nan")))
        .when(kind == "click", F.lit(inf))
        .when(kind == "view", F.lit(-inf))
        .otherwise(F.col("value"))
    )
    return table(spark, folder, "events").select(
        "event_id",
        F.round(S.match_probability(l0, l1), 6).alias("probability"),
        F.round(S.match_score(l0, F.when(e % 3 == 0, l1), F.when(e % 2 == 0, F.col("value") / 1000)), 6).alias("score"),
        F.round(S.clean_score(raw), 6).alias("cleaned"),
    )


@register(
    CASES,
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, value, value / 100.0 > 0.5 AS float_set,
      CASE WHEN max(value) OVER (PARTITION BY l_orderkey) > 1 THEN value > 127 ELSE value > 0 END AS int_set
    FROM (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_quantity AS BIGINT) * 5 ELSE l_linenumber % 2 END AS value
          FROM lineitem)
    """,
)
def binarise(spark, folder):
    value = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_quantity").cast("long") * 5).otherwise(
        (F.col("l_linenumber") % 2).cast("long")
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, folder, "lineitem").select(*keys, value.alias("value"))
    spread = ["l_linenumber", "l_partkey", "l_suppkey"]
    largest = with_group_stats(rows, ["l_orderkey"], [F.max("value").alias("largest")], spread)
    return largest.select(
        *keys,
        "value",
        C.binarise_float(F.col("value") / 100.0).alias("float_set"),
        C.binarise_int(F.col("value"), F.col("largest")).alias("int_set"),
    )


@register(
    CASES,
    """
    WITH r AS (
      SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN 'o' || o_orderkey END AS vid,
        CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'v.mp4' END AS video_path,
        CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS key_frame_idx,
        CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 3 - 1 END AS dx,
        CASE WHEN o_orderkey % 4 > 0 THEN 'k.png' ELSE '' END AS key_frame_path FROM orders),
    m AS (SELECT *, concat_ws(', ', CASE WHEN vid IS NULL THEN 'vid' END,
        CASE WHEN video_path IS NULL OR trim(video_path) = '' THEN 'video_path' END,
        CASE WHEN key_frame_idx IS NULL THEN 'key_frame_idx' END, CASE WHEN dx IS NULL THEN 'bbox' END,
        CASE WHEN key_frame_path = '' THEN 'key_frame_path' END) AS missing,
        concat_ws(', ', CASE WHEN video_path IS NULL THEN 'video_path' END,
          CASE WHEN key_frame_idx IS NULL THEN 'key_frame_idx' END) AS absent FROM r)
    SELECT k, coalesce(nullif(missing, ''), CASE WHEN dx < 0 THEN 'inverted box' END) AS strict_error,
      nullif(absent, '') AS loose_error FROM m
    """,
)
def required_fields(spark, folder):
    k = F.col("o_orderkey")
    dx = F.when(k % 13 > 0, k % 3 - 1)
    rows = table(spark, folder, "orders").select(
        k.alias("k"),
        F.when(k % 5 > 0, F.concat(F.lit("o"), k)).alias("vid"),
        F.when(k % 7 == 1, "  ").when(k % 7 > 1, "v.mp4").alias("video_path"),
        F.when(k % 11 > 0, F.col("o_custkey")).alias("key_frame_idx"),
        B.box_of(F.lit(5), F.lit(5), F.lit(5) + dx, F.lit(9)).alias("bbox"),
        F.when(k % 4 > 0, "k.png").otherwise("").alias("key_frame_path"),
    )
    return rows.select(
        "k",
        V.propagation_error(rows).alias("strict_error"),
        V.propagation_error(rows, require_bbox=False).alias("loose_error"),
    )


@register(
    CASES,
    f"""
    WITH {EVENT_CLIPS}
    SELECT vid, num_frames, user_id - 20 AS frame, user_id - 20 >= 0 AND user_id - 20 < num_frames AS in_range,
      num_frames > 60 AS too_long, num_frames > 65 OR num_frames * (user_id * 100.0) * 1080 * 4 / 1048576 > 2048 AS chunked
    FROM clips
    """,
)
def clip_limits(spark, folder):
    n, frame = F.col("num_frames"), F.col("user_id") - 20
    return event_clips(spark, folder).select(
        "vid",
        "num_frames",
        frame.alias("frame"),
        V.in_range(frame, n).alias("in_range"),
        V.too_long(n, 60).alias("too_long"),
        V.needs_chunks(n, F.col("user_id") * 100, F.lit(1080), 65, 2048).alias("chunked"),
    )


@register(
    CASES,
    f"""
    WITH {KEY_BOXES}
    SELECT b.vid FROM boxes b JOIN orders o ON b.vid = 'o' || o.o_orderkey
    WHERE o.o_orderstatus = 'F' AND o.o_orderkey % 9 > 0
    """,
)
def usable_grounding(spark, folder):
    status = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("vid"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("success"),
        "o_orderkey",
    )
    rows = status.join(key_boxes(spark, folder).select("vid", F.col("bbox").alias("found")), "vid")
    rows = rows.withColumn("bbox", F.when(F.col("o_orderkey") % 9 > 0, F.col("found")))
    return rows.filter(V.usable_grounding()).select("vid")


@register(
    CASES,
    """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'spanish' END AS dataset,
      CASE WHEN contains(path, 'a') THEN 'first' WHEN contains(path, '/e') THEN 'second' END AS kind
    FROM (SELECT doc_id, lang, source || '/' || lang AS path FROM documents)
    """,
)
def dataset_keys(spark, folder):
    aliases = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}
    path = F.concat_ws("/", "source", "lang")
    return table(spark, folder, "documents").select(
        "doc_id",
        N.canonical_key(F.concat(F.lit(" "), "lang", F.lit("\n")), aliases).alias("dataset"),
        N.key_from_path(path, {"a": "first", "/e": "second"}).alias("kind"),
    )


@register(
    CASES,
    """
    SELECT event_id, 'mask_' || CASE WHEN length(CAST(f AS VARCHAR)) < 5 THEN lpad(CAST(f AS VARCHAR), 5, '0')
        ELSE CAST(f AS VARCHAR) END || '.png' AS name,
      f AS frame_idx FROM (SELECT event_id, event_id * 37 AS f FROM events)
    """,
)
def mask_names(spark, folder):
    rows = table(spark, folder, "events").select("event_id", N.mask_name(F.col("event_id") * 37).alias("name"))
    return rows.withColumn("frame_idx", N.mask_index(F.col("name")))

