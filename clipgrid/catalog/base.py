"""Inputs shared by the registered queries, in Spark and in SQL.

Clips, sentences, replies, boxes and masks are derived from the given tables row by row; nothing is made up. These
inputs hold every row; a query leaves rows out only where a missing side or a drop rule is what it tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgrid.operators.skew import join_by_key, spread

Case = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(cases: dict[str, Case], sql: str | None = None) -> Callable:
    """Decorator: add a query under its function name."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        cases[function.__name__] = (function, sql)
        return function

    return add


# Scores: a user is a clip, an event a sampled frame.
def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.concat(F.lit("u"), "user_id").alias("vid"),
        F.col("event_id").alias("sample_idx"),
        (F.col("event_id") * 10).alias("frame_idx"),
        F.col("value").alias("score"),
        "event_type",
    )


EVENT_SCORES = """
scores AS (
  SELECT 'u' || user_id AS vid, event_id AS sample_idx, event_id * 10 AS frame_idx, value AS score, event_type
  FROM events)"""


# Clips: a user with as many frames as it has events and a frame rate that may be unusable.
def event_clips(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("num_frames"))
    kind = F.col("user_id") % 6
    fps = F.when(kind == 0, "24").when(kind == 1, "25").when(kind == 2, "29.97").when(kind == 3, "30").when(
        kind == 4, "-1"
    ).otherwise("unknown")
    return counts.select(
        F.concat(F.lit("u"), "user_id").alias("vid"),
        "user_id",
        "num_frames",
        fps.alias("video_fps"),
        (F.col("user_id") * 7 % F.col("num_frames")).alias("key_frame_idx"),
    )


EVENT_CLIPS = """
clips AS (
  SELECT 'u' || user_id AS vid, user_id, count(*) AS num_frames,
    CASE user_id % 6 WHEN 0 THEN '24' WHEN 1 THEN '25' WHEN 2 THEN '29.97' WHEN 3 THEN '30' WHEN 4 THEN '-1'
      ELSE 'unknown' END AS video_fps,
    user_id * 7 % count(*) AS key_frame_idx
  FROM events GROUP BY user_id)"""


# Sentences over part names.
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    kind, name, size = F.col("p_partkey") % 9, F.col("p_name"), F.col("p_size").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("There is a "), name, F.lit(" behind the table.")))
        .when(kind == 1, F.concat(F.lit("The "), name, F.lit(" is above the chair")))
        .when(kind == 2, F.concat(F.lit("an adult chases "), name))
        .when(kind == 3, F.concat(F.lit("what is the "), name, F.lit(" doing?")))
        .when(kind == 4, F.concat(F.lit("Where "), name, F.lit(" stands ")))
        .when(kind == 5, F.concat(F.lit("  "), name, F.lit(".. ")))
        .when(kind == 6, F.concat(F.lit("there are the "), name, F.lit(" in a box of "), size))
        .when(kind == 7, F.concat(size, F.lit(" pieces"), F.lit("?")))
        .otherwise(F.concat(F.lit("adult"), F.lit("")))
    )
    return table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_size", text.alias("sentence"))


SENTENCES = """
sentences AS (
  SELECT p_partkey, p_name, p_type, p_size, CASE p_partkey % 9
    WHEN 0 THEN 'There is a ' || p_name || ' behind the table.'
    WHEN 1 THEN 'The ' || p_name || ' is above the chair'
    WHEN 2 THEN 'an adult chases ' || p_name
    WHEN 3 THEN 'what is the ' || p_name || ' doing?'
    WHEN 4 THEN 'Where ' || p_name || ' stands '
    WHEN 5 THEN '  ' || p_name || '.. '
    WHEN 6 THEN 'there are the ' || p_name || ' in a box of ' || p_size
    WHEN 7 THEN p_size || ' pieces?'
    ELSE 'adult' END AS sentence
  FROM part)"""


# Replies with boxes in all notations over line items.
def replies(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("l_partkey") % 1200, F.col("l_suppkey") % 900
    c, d = a + F.col("l_quantity").cast("long"), b + F.col("l_linenumber") * 10
    kind = (F.col("l_partkey") + F.col("l_linenumber")) % 9
    text = (
        F.when(kind == 0, F.format_string("Answer: the red dogs\nReasoning: near\nTarget: <|box_start|>(%d,%d),(%d,%d)<|box_end|>", a, b, c, d))
        .when(kind == 1, F.format_string("Answer: Two boys, one\nthen (%d, %d) , (%d,%d)", a, b, c, d))
        .when(kind == 2, F.format_string("answer a man Target : %d, %d,%d , %d", a, b, c, d))
        .when(kind == 3, F.format_string("[%d, %d, %d, %d] and [1,2,%d,%d]", a, b, c, d, c, d))
        .when(kind == 4, F.format_string("Target: None (%d,%d),(%d,%d)", a, b, c, d))
        .when(kind == 5, F.lit("There is NO SUBJECT here"))
        .when(kind == 6, F.format_string("Answer: the one\nbox %d %d %d %d", a, b, c, d))
        .when(kind == 7, F.lit(""))
        .otherwise(F.format_string("TARGET: NONE <|box_start|> (1,2),(3,4) <|box_end|> (9,9),(8,8) <|box_start|>(%d,%d),(%d,%d)<|box_end|>", a, b, c, d))
    )
    return spread(table(spark, folder, "lineitem")).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        text.alias("reply"),
        (F.col("l_linenumber") % 2 == 1).alias("is_question"),
        (F.lit(640) + F.col("l_linenumber") * 100).alias("width"),
        (F.lit(480) + F.col("l_linenumber") * 50).alias("height"),
    )


REPLIES = r"""
numbers AS (
  SELECT *, l_partkey % 1200 AS a, l_suppkey % 900 AS b, l_partkey % 1200 + CAST(l_quantity AS BIGINT) AS c,
    l_suppkey % 900 + l_linenumber * 10 AS d FROM lineitem),
replies AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 2 = 1 AS is_question,
    640 + l_linenumber * 100 AS width, 480 + l_linenumber * 50 AS height,
    CASE (l_partkey + l_linenumber) % 9
    WHEN 0 THEN format('Answer: the red dogs{4}Reasoning: near{4}Target: <|box_start|>({0},{1}),({2},{3})<|box_end|>', a, b, c, d, chr(10))
    WHEN 1 THEN format('Answer: Two boys, one{4}then ({0}, {1}) , ({2},{3})', a, b, c, d, chr(10))
    WHEN 2 THEN format('answer a man Target : {0}, {1},{2} , {3}', a, b, c, d)
    WHEN 3 THEN format('[{0}, {1}, {2}, {3}] and [1,2,{2},{3}]', a, b, c, d)
    WHEN 4 THEN format('Target: None ({0},{1}),({2},{3})', a, b, c, d)
    WHEN 5 THEN 'There is NO SUBJECT here'
    WHEN 6 THEN format('Answer: the one{4}box {0} {1} {2} {3}', a, b, c, d, chr(10))
    WHEN 7 THEN ''
    ELSE format('TARGET: NONE <|box_start|> (1,2),(3,4) <|box_end|> (9,9),(8,8) <|box_start|>({0},{1}),({2},{3})<|box_end|>', a, b, c, d)
    END AS reply FROM numbers)"""


# Masks: an order is a clip of two frames, its line items are rectangles of up to two tubes on a 12 by 96 image.
HEIGHT, WIDTH = 12, 96


def raw_runs(spark: SparkSession, folder: str) -> DataFrame:
    first = F.col("l_partkey") % 6
    return spread(table(spark, folder, "lineitem")).select(
        F.concat(F.lit("o"), "l_orderkey").alias("vid"),
        (F.col("l_linenumber") % 2).cast("long").alias("tube_id"),
        F.floor(F.col("l_linenumber") / 4).alias("frame_idx"),
        F.explode(F.sequence(first, first + F.col("l_partkey") % 3)).alias("y"),
        (F.col("l_suppkey") % 30).alias("x0"),
        (F.col("l_suppkey") % 30 + F.col("l_quantity").cast("long")).alias("x1"),
    )


RAW_RUNS = """
raw_runs AS (
  SELECT 'o' || l_orderkey AS vid, CAST(l_linenumber % 2 AS BIGINT) AS tube_id, l_linenumber // 4 AS frame_idx,
    unnest(range(l_partkey % 6, l_partkey % 6 + l_partkey % 3 + 1)) AS y,
    l_suppkey % 30 AS x0, l_suppkey % 30 + CAST(l_quantity AS BIGINT) AS x1
  FROM lineitem)"""

PIXELS = (
    RAW_RUNS
    + """,
pixels AS (
  SELECT DISTINCT vid, tube_id, frame_idx, y, unnest(range(x0, x1)) AS x FROM raw_runs)"""
)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    from clipgrid.operators.spans import union_runs

    return union_runs(raw_runs(spark, folder))


def runs_at_boxes(spark: SparkSession, folder: str, boxes: DataFrame) -> DataFrame:
    """Masks on the frames that have a box: those runs are picked before overlapping ones are united."""
    from clipgrid.operators.spans import union_runs

    return union_runs(join_by_key(raw_runs(spark, folder), boxes.select("vid", "frame_idx"), ["vid", "frame_idx"], "left_semi"))


def mask_frames(spark: SparkSession, folder: str) -> DataFrame:
    """One row per mask; every order also has an empty mask of tube 9 on its first frame."""
    have = (
        table(spark, folder, "lineitem")
        .select(
            F.concat(F.lit("o"), "l_orderkey").alias("vid"),
            (F.col("l_linenumber") % 2).cast("long").alias("tube_id"),
            F.floor(F.col("l_linenumber") / 4).alias("frame_idx"),
        )
        .distinct()
    )
    empty = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("vid"),
        F.lit(9).cast("long").alias("tube_id"),
        F.lit(0).cast("long").alias("frame_idx"),
    )
    size = {"height": F.lit(HEIGHT).cast("long"), "width": F.lit(WIDTH).cast("long")}
    return have.unionByName(empty).withColumns(size)


MASK_FRAMES = """
mask_frames AS (
  SELECT DISTINCT 'o' || l_orderkey AS vid, CAST(l_linenumber % 2 AS BIGINT) AS tube_id, l_linenumber // 4 AS frame_idx
  FROM lineitem
  UNION ALL SELECT 'o' || o_orderkey, 9, 0 FROM orders)"""


def order_box() -> Column:
    """The box of an order; some reach outside the image, some are empty."""
    x, y = F.col("o_custkey") % 60 - 5, F.col("o_custkey") % 9 - 1
    return F.struct(
        x.cast("int").alias("xmin"),
        y.cast("int").alias("ymin"),
        (x + F.col("o_orderkey") % 50).cast("int").alias("xmax"),
        (y + 1 + F.col("o_orderkey") % 12).cast("int").alias("ymax"),
    )


def key_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """One box per order on one of its two frames."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("vid"), (F.col("o_orderkey") % 2).alias("frame_idx"), order_box().alias("bbox")
    )


KEY_BOXES = """
boxes AS (
  SELECT 'o' || o_orderkey AS vid, o_orderkey % 2 AS frame_idx, o_custkey % 60 - 5 AS xmin, o_custkey % 9 - 1 AS ymin,
    o_custkey % 60 - 5 + o_orderkey % 50 AS xmax, o_custkey % 9 + o_orderkey % 12 AS ymax
  FROM orders)"""


def dense_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as an 8 by 8 map."""
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "value")
    ).select(
        F.concat(F.lit("e"), "vec_id").alias("vid"),
        "vec_id",
        "label",
        F.col("pos").cast("long").alias("pos"),
        F.floor(F.col("pos") / 8).alias("y"),
        (F.col("pos") % 8).cast("long").alias("x"),
        F.col("value").cast("double").alias("w"),
    )


DENSE_MAPS = """
cells AS (SELECT vec_id, label, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings),
maps AS (
  SELECT 'e' || vec_id AS vid, vec_id, label, pos, pos // 8 AS y, pos % 8 AS x, CAST(value AS DOUBLE) AS w FROM cells)"""
