"""Scores over time, frame sampling, key frames, sentence numbers and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrid.catalog.base import (
    EVENT_CLIPS,
    EVENT_SCORES,
    Case,
    event_clips,
    event_scores,
    register,
    table,
)
from clipgrid.functions.names import compose_vid
from clipgrid.functions.scores import clean_score, sample_time
from clipgrid.operators import chunks as K
from clipgrid.operators import sampling as P
from clipgrid.operators.skew import number_rows, unfold
from clipgrid.operators.tubes import backward_length, forward_length, reverse_index

CASES: dict[str, Case] = {}


@register(
    CASES,
    f"""
    WITH {EVENT_SCORES},
    clean AS (SELECT *, CASE WHEN isnan(raw) THEN 0 WHEN isinf(raw) THEN CASE WHEN raw > 0 THEN 1 ELSE 0 END ELSE raw END AS s
      FROM (SELECT *, CASE event_type WHEN 'error' THEN 'nan'::DOUBLE WHEN 'click' THEN 'inf'::DOUBLE ELSE floor(score) / 500 END AS raw
            FROM scores)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY s DESC, sample_idx) AS r,
        count(*) OVER (PARTITION BY vid) AS n, avg(s) OVER (PARTITION BY vid) AS mean,
        min(s) OVER (PARTITION BY vid) AS low FROM clean)
    SELECT vid, sample_idx AS key_frame_idx, frame_idx, n AS num_sampled_frames, round(s, 6) AS max_similarity,
      round(low, 6) AS min_similarity, round(mean, 6) AS mean_similarity FROM ranked WHERE r = 1
    """,
)
def keyframe_events(spark, folder):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", F.lit(float("nan")))
        .when(kind == "click", F.lit(float("inf")))
        .otherwise(F.floor("score") / 500)
    )
    scores = event_scores(spark, folder).withColumn("score", clean_score(raw))
    picks = P.pick_key_frames(scores)
    rounded = [F.round(c, 6).alias(c) for c in ("max_similarity", "min_similarity", "mean_similarity")]
    return picks.select("vid", "key_frame_idx", "frame_idx", "num_sampled_frames", *rounded)


_SAMPLES = f"""
{EVENT_CLIPS},
rates AS (
  SELECT *, CASE WHEN TRY_CAST(video_fps AS DOUBLE) > 0 THEN TRY_CAST(video_fps AS DOUBLE) ELSE 30 END AS source,
    CASE WHEN user_id % 7 = 0 THEN 3.0 ELSE user_id % 7 * 5.0 END::DOUBLE AS target FROM clips),
counts AS (
  SELECT *, least(num_frames, greatest(1, CAST(round_even(num_frames::DOUBLE / source * target, 0) AS BIGINT))) AS n FROM rates),
samples AS (
  SELECT vid, num_frames, n, source, target, i AS sample_idx, CASE WHEN i = n - 1 THEN num_frames - 1
      ELSE CAST(round_even(i * ((num_frames - 1)::DOUBLE / (n - 1)), 0) AS BIGINT) END AS frame_idx
  FROM (SELECT *, unnest(range(n)) AS i FROM counts))"""


def _sampled(spark, folder):
    # A rate of -1 is unusable and counts as 3.
    rate = F.when(F.col("user_id") % 7 == 0, -1).otherwise(F.col("user_id") % 7 * 5).cast("double")
    return P.sample_frames(event_clips(spark, folder).withColumn("target", rate), fps_target=F.col("target"))


@register(
    CASES,
    f"""
    WITH {_SAMPLES}
    SELECT vid, num_frames, n AS num_sampled_frames, sample_idx, frame_idx, round(sample_idx / target, 6) AS seconds,
      frame_idx AS again FROM samples
    """,
)
def frame_sampling(spark, folder):
    rows = _sampled(spark, folder)
    again = P.source_index(F.col("sample_idx"), F.col("num_sampled_frames"), F.col("num_frames"))
    return rows.select(
        "vid",
        "num_frames",
        "num_sampled_frames",
        "sample_idx",
        "frame_idx",
        F.round(sample_time(F.col("sample_idx"), P.target_fps(F.col("target"))), 6).alias("seconds"),
        again.alias("again"),
    )


@register(
    CASES,
    f"""
    WITH {_SAMPLES},
    asked AS (SELECT s.*, o AS wanted, greatest(0, least(o, n - 1)) AS place FROM (SELECT DISTINCT vid, num_frames, n FROM samples) s,
      (SELECT unnest([-4, 0, 2, 100000]) AS o))
    SELECT asked.vid, wanted, frame_idx AS source_frame FROM asked JOIN samples ON asked.vid = samples.vid AND place = sample_idx
    """,
)
def sample_to_source(spark, folder):
    clips = event_clips(spark, folder)
    target = F.when(F.col("user_id") % 7 == 0, 3.0).otherwise((F.col("user_id") % 7 * 5).cast("double"))
    n = P.sample_count(F.col("num_frames"), P.source_fps(F.col("video_fps")), target)
    asked = clips.withColumn("n", n).withColumn("wanted", F.explode(F.array(*[F.lit(i) for i in (-4, 0, 2, 100000)])))
    return asked.select(
        "vid", "wanted", P.source_index(F.col("wanted"), F.col("n"), F.col("num_frames")).alias("source_frame")
    )


@register(
    CASES,
    """
    SELECT 'u' || user_id AS vid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sentence_index,
      'u' || user_id || '_' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS clip
    FROM events
    """,
)
def sentence_numbers(spark, folder):
    rows = table(spark, folder, "events").select(F.concat(F.lit("u"), "user_id").alias("vid"), "event_id", "ts")
    numbered = P.number_sentences(rows, ["vid"], ["ts", "event_id"], F.date_trunc("day", "ts"))
    return numbered.select(
        "vid", "event_id", "sentence_index", compose_vid(F.col("vid"), F.col("sentence_index")).alias("clip")
    )


@register(
    CASES,
    """
    SELECT conv_id, turn, kind, row_number() OVER (PARTITION BY role ORDER BY conv_id, kind, turn) AS position
    FROM (SELECT *, CASE role WHEN 'user' THEN 1 ELSE 0 END AS kind FROM conversations)
    """,
)
def caption_positions(spark, folder):
    """Numbering keys that hold a large share of all rows each."""
    kind = F.when(F.col("role") == "user", 1).otherwise(0)
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", kind.alias("kind"))
    order = [F.col(c) for c in ("conv_id", "kind", "turn")]
    numbered = number_rows(rows, ["role"], order, F.floor(F.col("conv_id") / 16), "position")
    return numbered.select("conv_id", "turn", "kind", "position")


@register(
    CASES,
    f"""
    WITH {EVENT_SCORES}
    SELECT vid, sample_idx, round(CASE WHEN high - low < 1e-8 THEN 0.5 ELSE (score - low) / (high - low) END, 6) AS normalised,
      round(sample_idx / 3.0, 6) AS seconds
    FROM (SELECT *, min(score) OVER (PARTITION BY vid) AS low, max(score) OVER (PARTITION BY vid) AS high FROM scores)
    """,
)
def time_normalise(spark, folder):
    scores = event_scores(spark, folder)
    rows = P.normalise_by_group(scores, ["vid"], "score", "normalised", 0.5, ["sample_idx"])
    return rows.select(
        "vid",
        "sample_idx",
        F.round("normalised", 6).alias("normalised"),
        F.round(sample_time(F.col("sample_idx"), F.lit(3.0)), 6).alias("seconds"),
    )


@register(
    CASES,
    f"""
    WITH {EVENT_SCORES}
    SELECT event_type, vid, sample_idx, 0.5::DOUBLE AS score_scale, 0.0::DOUBLE AS map_scale FROM scores
    """,
)
def constant_series(spark, folder):
    """A constant series is 0.5 as scores and 0 as a map."""
    flat = event_scores(spark, folder).withColumn("score", F.lit(4.0))
    scores = P.normalise_by_group(flat, ["event_type"], "score", "score_scale", 0.5, ["sample_idx"])
    both = P.normalise_by_group(scores, ["event_type"], "score", "map_scale", 0.0, ["sample_idx"])
    return both.select("event_type", "vid", "sample_idx", "score_scale", "map_scale")


_SIZE, _OVERLAP = 20, 6

_CHUNKS = f"""
{EVENT_CLIPS},
counted AS (
  SELECT *, 1 + CAST(ceil(greatest(0, num_frames - {_SIZE}) / {_SIZE - _OVERLAP}::DOUBLE) AS BIGINT) AS chunks FROM clips),
chunked AS (
  SELECT vid, num_frames, key_frame_idx, i AS chunk_id, i * {_SIZE - _OVERLAP} AS chunk_start,
    least(i * {_SIZE - _OVERLAP} + {_SIZE}, num_frames) AS chunk_end
  FROM (SELECT *, unnest(range(chunks)) AS i FROM counted))"""


@register(
    CASES,
    f"""
    WITH RECURSIVE {EVENT_CLIPS},
    walk AS (
      SELECT vid, num_frames, key_frame_idx, 0::BIGINT AS chunk_id, 0::BIGINT AS chunk_start, least({_SIZE}, num_frames) AS chunk_end FROM clips
      UNION ALL
      SELECT vid, num_frames, key_frame_idx, chunk_id + 1, chunk_end - {_OVERLAP}, least(chunk_end - {_OVERLAP} + {_SIZE}, num_frames)
      FROM walk WHERE chunk_end < num_frames)
    SELECT vid, chunk_id, chunk_start, chunk_end,
      min(CASE WHEN chunk_start <= key_frame_idx AND key_frame_idx < chunk_end THEN chunk_id END) OVER (PARTITION BY vid) AS main_chunk
    FROM walk
    """,
)
def frame_chunks(spark, folder):
    rows = K.cut_chunks(event_clips(spark, folder), _SIZE, _OVERLAP)
    main = K.main_chunk(F.col("key_frame_idx"), F.col("num_frames"), _SIZE, _OVERLAP)
    return rows.select("vid", "chunk_id", "chunk_start", "chunk_end", main.alias("main_chunk"))


@register(
    CASES,
    f"""
    WITH {_CHUNKS},
    frames AS (SELECT vid, unnest(range(num_frames)) AS frame_idx FROM clips)
    SELECT f.vid, f.frame_idx, chunk_id, f.frame_idx - chunk_start AS local_idx
    FROM frames f JOIN chunked c ON f.vid = c.vid AND f.frame_idx >= chunk_start AND f.frame_idx < chunk_end
    """,
)
def chunk_frames(spark, folder):
    clips = event_clips(spark, folder)
    frames = unfold(clips, F.col("num_frames"), "frame_idx", ["vid"])
    return K.assign_chunks(frames, _SIZE, _OVERLAP).select("vid", "frame_idx", "chunk_id", "local_idx")


@register(
    CASES,
    f"""
    WITH {EVENT_CLIPS}
    SELECT vid, frame_idx, num_frames - 1 - frame_idx AS reversed, num_frames - key_frame_idx AS forward_frames,
      key_frame_idx + 1 AS backward_frames
    FROM (SELECT *, unnest(range(num_frames)) AS frame_idx FROM clips)
    """,
)
def play_backward(spark, folder):
    n, k = F.col("num_frames"), F.col("key_frame_idx")
    frames = unfold(event_clips(spark, folder), n, "frame_idx", ["vid"])
    return frames.select(
        "vid",
        "frame_idx",
        reverse_index(n, F.col("frame_idx")).alias("reversed"),
        forward_length(n, k).alias("forward_frames"),
        backward_length(k).alias("backward_frames"),
    )
