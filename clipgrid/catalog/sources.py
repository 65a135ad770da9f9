"""Annotations, listings, records and tube sets, with their inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from clipgrid.catalog.base import Case, register, table
from clipgrid.operators.joins import lookup_fps
from clipgrid.operators.report import caption_types as distinct_types
from clipgrid.operators.sampling import number_sentences
from clipgrid.session import shared_folder
from clipgrid.sinks.tables import write_json_arrays
from clipgrid.sources import annotations as N
from clipgrid.sources import media as M
from clipgrid.sources import records as R
from clipgrid.sources import tubes as T
from clipgrid.sources.headers import header_facts
from clipgrid.sources.listing import walk_files

CASES: dict[str, Case] = {}
#: Bytes of a range in the query that reads arrays in ranges; small, so that even the smallest tables have many.
_RANGE = 1 << 16


def _conversation_annotations(spark, folder):
    """Every turn is an annotation with one caption (assistant, system) or one question (user)."""
    sentence = F.array(
        F.struct(
            F.col("text").alias("description"),
            F.nullif(F.col("role"), F.lit("system")).alias("type"),
            F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).alias("target_id"),
        )
    )
    question = F.col("role") == "user"
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("vid"),
        F.col("turn").alias("ann_pos"),
        F.create_map(F.lit("begin"), F.col("turn") * 10).alias("temporal_gt"),
        F.lit("near").alias("used_relation"),
        F.lit(None).cast("string").alias("used_segment"),
        F.when(~question, sentence).alias("captions"),
        F.when(question, sentence).alias("questions"),
    )


_CAPTIONS = """
captions AS (
  SELECT 'c' || conv_id AS vid, turn AS ann_pos, CASE role WHEN 'user' THEN 1 ELSE 0 END AS kind, 0 AS cap_pos, text AS text_query,
    nullif(role, 'system') AS caption_type, CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) END AS ann_target_id, role = 'user' AS is_interrogative
  FROM conversations)"""


@register(
    CASES,
    f"""
    WITH {_CAPTIONS}
    SELECT vid, ann_pos, kind, cap_pos, text_query, caption_type, ann_target_id, is_interrogative, ann_pos * 10 AS begin FROM captions
    """,
)
def captions_union(spark, folder):
    rows = N.struct_captions(_conversation_annotations(spark, folder))
    begin = F.try_element_at("ann_temporal_gt", F.lit("begin")).alias("begin")
    return rows.select(
        "vid", "ann_pos", "kind", "cap_pos", "text_query", "caption_type", "ann_target_id", "is_interrogative", begin
    )


@register(
    CASES,
    f"""
    WITH {_CAPTIONS}
    SELECT 'declarative' AS part, vid, ann_pos FROM captions WHERE kind = 0
    UNION ALL SELECT 'interrogative', vid, ann_pos FROM captions WHERE kind = 1
    UNION ALL SELECT 'assistant', vid, ann_pos FROM captions WHERE caption_type = 'assistant'
    UNION ALL SELECT 'one video', vid, ann_pos FROM captions WHERE vid = 'c7'
    UNION ALL SELECT 'some videos', vid, ann_pos FROM captions WHERE starts_with(vid, 'c1')
    """,
)
def caption_filters(spark, folder):
    annotations = _conversation_annotations(spark, folder)
    everything = N.struct_captions(annotations)
    parts = {
        "declarative": N.struct_captions(annotations, "declarative"),
        "interrogative": N.struct_captions(annotations, "interrogative"),
        "assistant": N.struct_captions(annotations, "both", "assistant"),
        "one video": N.with_id(everything, "c7"),
        "some videos": N.with_id(everything, "c1", prefix=True),
    }
    named = [rows.select(F.lit(name).alias("part"), "vid", "ann_pos") for name, rows in parts.items()]
    result = named[0]
    for part in named[1:]:
        result = result.unionByName(part)
    return result


@register(
    CASES,
    """
    SELECT 'c' || conv_id AS vid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sentence_index, turn AS place,
      text AS text_query, nullif(role, 'system') AS caption_type, role = 'user' AS is_interrogative FROM conversations
    """,
)
def annotation_ranges(spark, folder):
    """Annotations written as JSON arrays and read back in byte ranges far smaller than a file, numbered in input order."""
    path = shared_folder(spark, "annotations")
    rows = _conversation_annotations(spark, folder).withColumn("conv", F.substring("vid", 2, 20).cast("long"))
    rows = rows.repartitionByRange(3, "conv", "ann_pos").sortWithinPartitions("conv", "ann_pos")
    write_json_arrays(rows.drop("conv").withColumnRenamed("ann_pos", "place"), path)
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(_RANGE))
    sentence = T_.ArrayType(T_.StructType.fromDDL("description string, type string, target_id string"))
    schema = T_.StructType.fromDDL("vid string, place long, temporal_gt map<string,string>, used_relation string, used_segment string")
    found = N.struct_captions(N.read_annotations(session, path, schema.add("captions", sentence).add("questions", sentence)))
    numbered = number_sentences(found)
    return numbered.select("vid", F.col("sentence_index").cast("long").alias("sentence_index"), "place", "text_query", "caption_type", "is_interrogative")


@register(
    CASES,
    f"WITH {_CAPTIONS} SELECT coalesce(caption_type, 'None') AS caption_type, count(*) AS num_captions FROM captions GROUP BY ALL",
)
def caption_types(spark, folder):
    return distinct_types(N.struct_captions(_conversation_annotations(spark, folder)))


@register(
    CASES,
    """
    SELECT 'd' || doc_id AS vid, doc_id AS ann_pos, unnest(range(len(parts))) AS cap_pos, unnest(parts) AS text_query,
      CASE WHEN doc_id % 3 = 0 THEN 30.0 ELSE (20 + doc_id % 10)::DOUBLE END AS video_fps
    FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id % 20 > 0)
    """,
)
def string_captions(spark, folder):
    """The lines of a document are its captions; annotations without an identifier are dropped."""
    docs = table(spark, folder, "documents")
    annotations = docs.select(
        F.when(F.col("doc_id") % 20 > 0, F.concat(F.lit("d"), "doc_id")).otherwise(" ").alias("vid"),
        F.col("doc_id").alias("ann_pos"),
        F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10 + 20).cast("double")).alias("fps"),
        F.split("text", "\n").alias("captions"),
    )
    return N.string_captions(annotations).select("vid", "ann_pos", "cap_pos", "text_query", "video_fps")


@register(
    CASES,
    """
    SELECT p_partkey || '_' || replace(p_name, ' ', '_') AS vid, p_partkey || '_' || replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '.mp4' ELSE '.x.mkv' END AS video_file,
      p_type AS text_query FROM part WHERE p_size % 2 = 0 AND p_size % 5 > 0
    UNION ALL
    SELECT p_partkey || '_' || replace(p_name, ' ', '_') || '.x', p_partkey || '_' || replace(p_name, ' ', '_') || '.x.mkv', p_type
    FROM part WHERE p_size % 2 = 1 AND p_size % 5 > 0
    """,
)
def map_captions(spark, folder):
    """One JSON map per part; the caption field is configured and some entries lack it."""
    name = F.concat(
        F.concat_ws("_", "p_partkey", F.replace("p_name", F.lit(" "), F.lit("_"))),
        F.when(F.col("p_size") % 2 == 0, ".mp4").otherwise(".x.mkv"),
    )
    caption = F.when(F.col("p_size") % 5 > 0, F.col("p_type")).otherwise("")
    entry = F.create_map(F.lit("English"), caption, F.lit("caption"), F.lit("other"))
    maps = table(spark, folder, "part").select(F.to_json(F.create_map(name, entry)).alias("json"))
    return N.map_captions(maps, "English").select("vid", "video_file", "text_query")


@register(
    CASES,
    """
    WITH rates AS (SELECT user_id, arg_max(fps, event_id) AS last, arg_min(fps, event_id) AS first FROM (
      SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 30.0 ELSE (event_id % 60)::DOUBLE END AS fps FROM events WHERE user_id % 5 > 0) GROUP BY ALL)
    SELECT c_custkey, coalesce(last, 30.0) AS last_fps, coalesce(first, 30.0) AS first_fps
    FROM customer LEFT JOIN rates ON c_custkey = user_id
    """,
)
def fps_lookup(spark, folder):
    stated = table(spark, folder, "events").filter("user_id % 5 > 0").select(
        F.col("user_id").alias("vid"),
        "event_id",
        F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 60).cast("double")).alias("fps"),
    )
    clips = table(spark, folder, "customer").select(F.col("c_custkey").alias("vid"))
    last = lookup_fps(clips, stated, "event_id").withColumnRenamed("video_fps", "last_fps")
    first = lookup_fps(last, stated, "event_id", last_wins=False)
    return first.select(F.col("vid").alias("c_custkey"), "last_fps", F.col("video_fps").alias("first_fps"))


_FILES = """
files AS (
  SELECT event_id, '/r' || event_id % 2 || '/data/u' || user_id || CASE WHEN event_id % 11 = 0 THEN '/notes.txt' ELSE
    '/' || CASE event_type WHEN 'error' THEN 'frame_' || event_id WHEN 'click' THEN lpad(CAST(event_id AS VARCHAR), 8, '0')
      WHEN 'view' THEN 'x' || user_id % 3 || '_' || event_id ELSE 'cover' || repeat('a', CAST(event_id % 4 AS INT)) || chr(CAST(97 + event_id % 26 AS INT)) || chr(CAST(97 + event_id // 26 % 26 AS INT)) || chr(CAST(97 + event_id // 676 % 26 AS INT)) || chr(CAST(97 + event_id // 17576 % 26 AS INT)) END
      || CASE event_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' ELSE '.bmp' END END AS path FROM events),
images AS (
  SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name,
    regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem
  FROM files WHERE path NOT LIKE '%.txt')"""


def _letters(n):
    return F.concat(*[F.chr((F.lit(97) + F.floor(n / 26**i) % 26).cast("long")) for i in range(4)])


def _files(spark, folder):
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    name = (
        F.when(kind == "error", F.concat(F.lit("frame_"), e))
        .when(kind == "click", F.lpad(e.cast("string"), 8, "0"))
        .when(kind == "view", F.concat(F.lit("x"), u % 3, F.lit("_"), e))
        .otherwise(F.concat(F.lit("cover"), F.repeat(F.lit("a"), (e % 4).cast("int")), _letters(e)))
    )
    extension = F.when(e % 3 == 0, ".jpg").when(e % 3 == 1, ".PNG").otherwise(".bmp")
    leaf = F.when(e % 11 == 0, "notes.txt").otherwise(F.concat(name, extension))
    path = F.concat(F.lit("/r"), e % 2, F.lit("/data/u"), u, F.lit("/"), leaf)
    return table(spark, folder, "events").select(path.alias("path"), (e % 2).cast("int").alias("root_rank"))


@register(
    CASES,
    rf"""
    WITH {_FILES.replace(chr(92) * 2, chr(92))}
    SELECT path, row_number() OVER (PARTITION BY dir ORDER BY TRY_CAST(nullif(regexp_extract(stem, '[0-9]+'), '') AS HUGEINT) NULLS LAST, name) - 1 AS by_first_number,
      row_number() OVER (PARTITION BY dir ORDER BY CASE WHEN regexp_full_match(stem, '[0-9]+') THEN TRY_CAST(stem AS HUGEINT) END NULLS LAST, name) - 1 AS by_all_digits,
      row_number() OVER (PARTITION BY dir ORDER BY name) - 1 AS by_text
    FROM images
    """,
)
def frame_order(spark, folder):
    files = _files(spark, folder).select("path").distinct()
    orders = [
        M.order_frames(files, order).select("path", F.col("frame_idx").alias(f"by_{order}"))
        for order in ("first_number", "all_digits", "text")
    ]
    return orders[0].join(orders[1], "path").join(orders[2], "path")


@register(
    CASES,
    rf"""
    WITH {_FILES.replace(chr(92) * 2, chr(92))}
    SELECT name AS basename, arg_min(path, path) AS path FROM (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM files) GROUP BY name
    """,
)
def media_catalog(spark, folder):
    return M.catalog_by_name(_files(spark, folder))


@register(
    CASES,
    rf"""
    WITH {_FILES.replace(chr(92) * 2, chr(92))}
    SELECT 'text' AS rule, dir AS video_path, count(*) AS num_frames, CASE WHEN length(min(name)) % 2 = 0 THEN length(arg_min(path, name)) ELSE 0 END AS width,
      CASE WHEN length(min(name)) % 2 = 0 THEN 2 * length(arg_min(path, name)) ELSE 0 END AS height
    FROM images GROUP BY dir
    UNION ALL SELECT 'number', dir, n, CASE WHEN length(name) % 2 = 0 THEN length(path) ELSE 0 END, CASE WHEN length(name) % 2 = 0 THEN 2 * length(path) ELSE 0 END
    FROM (SELECT *, count(*) OVER (PARTITION BY dir) AS n, row_number() OVER (PARTITION BY dir ORDER BY CASE WHEN digits THEN TRY_CAST(stem AS HUGEINT) END, name) AS r
      FROM (SELECT *, bool_and(regexp_full_match(stem, '[0-9]+')) OVER (PARTITION BY dir) AS digits FROM images WHERE lower(name) NOT LIKE '%.bmp')) WHERE r = 1
    """,
)
def clip_metadata(spark, folder):
    files = _files(spark, folder).select("path").distinct()
    length = F.length("path")
    sizes = files.filter(F.length(F.substring_index("path", "/", -1)) % 2 == 0).select(
        "path", length.alias("width"), (length * 2).alias("height")
    )
    found = [M.clip_metadata(files, sizes, rule).select(F.lit(rule).alias("rule"), "*") for rule in ("text", "number")]
    return found[0].unionByName(found[1])


_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "txt", "jpg")


@register(
    CASES,
    """
    WITH listed AS (
      SELECT l_orderkey, l_partkey % 6 AS k, l_linenumber AS j FROM lineitem),
    files AS (
      SELECT 'o' || l_orderkey AS vid, CASE WHEN k < 4 THEN k END AS rank, '/v/o' || l_orderkey || '/o' || l_orderkey || '.' || ['mp4', 'avi', 'mov', 'mkv', 'txt'][k + 1] AS path
      FROM listed WHERE k < 5
      UNION ALL SELECT 'o' || l_orderkey, 4, '/v/o' || l_orderkey || '/img' FROM listed WHERE k = 5)
    SELECT vid, arg_min(path, rank) AS video_path FROM files WHERE rank IS NOT NULL GROUP BY vid
    """,
)
def clip_media(spark, folder):
    k, vid = F.col("l_partkey") % 6, F.concat(F.lit("o"), "l_orderkey")
    extension = F.element_at(F.array(*[F.lit(e) for e in _EXTENSIONS]), (k + 1).cast("int"))
    direct = F.concat(F.lit("/v/"), vid, F.lit("/"), vid, F.lit("."), extension)
    image = F.concat(F.lit("/v/"), vid, F.lit("/img/"), F.col("l_linenumber"), F.lit(".jpg"))
    files = table(spark, folder, "lineitem").select(F.when(k < 5, direct).otherwise(image).alias("path"))
    return M.clip_media(files)


@register(
    CASES,
    """
    SELECT page_id FROM (SELECT page_id, ['.mp4', '.MKV', '.txt', '', '.webm', '.jpg', '.mkv'][page_id % 7 + 1] AS ext FROM pages WHERE page_id % 9 > 0)
    WHERE lower(ext) = '.mkv' OR (ext IN ('.mp4', '.webm') AND page_id % 2 = 0)
    """,
)
def media_readable(spark, folder):
    extensions = F.array(*[F.lit(e) for e in (".mp4", ".MKV", ".txt", "", ".webm", ".jpg", ".mkv")])
    extension = F.element_at(extensions, (F.col("page_id") % 7 + 1).cast("int"))
    clips = table(spark, folder, "pages").select("page_id", F.concat(F.lit("/v/"), "page_id", extension).alias("video_path"))
    probe = F.when(F.col("page_id") % 3 > 0, F.col("page_id") % 2 == 0).otherwise(F.when(F.col("page_id") % 2 == 0, True))
    media = clips.filter("page_id % 9 > 0").select("video_path", probe.alias("readable"))
    return M.filter_readable(clips, media).select("page_id")


_REPAIR = """
files AS (
  SELECT CASE c_custkey % 4 WHEN 0 THEN '/a/set/' WHEN 1 THEN '/b/set/' WHEN 2 THEN '/deep/' ELSE '/mnt/' END || 'c' || c_custkey || '.mp4' AS path
  FROM customer WHERE c_custkey % 7 > 0),
clips AS (
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '/deep/c' || o_custkey || '.mp4' WHEN 1 THEN '/old/data/set/c' || o_custkey || '.mp4'
    WHEN 2 THEN '/x/c' || o_custkey || '.mp4' WHEN 3 THEN '/mnt/data/c' || o_custkey || '.mp4' ELSE '' END AS video_path, o_custkey
  FROM orders)"""


@register(
    CASES,
    f"""
    WITH {_REPAIR},
    tried AS (
      SELECT o_orderkey, o_custkey, video_path, f0.path AS exact, f1.path AS a, f2.path AS b, n.path AS named, s.path AS swapped
      FROM clips c LEFT JOIN files f0 ON c.video_path = f0.path
      LEFT JOIN files f1 ON contains(c.video_path, '/data/') AND f1.path = '/a/' || substr(c.video_path, instr(c.video_path, '/data/') + 6)
      LEFT JOIN files f2 ON contains(c.video_path, '/data/') AND f2.path = '/b/' || substr(c.video_path, instr(c.video_path, '/data/') + 6)
      LEFT JOIN files n ON regexp_extract(c.video_path, '[^/]*$') <> '' AND regexp_extract(n.path, '[^/]*$') = regexp_extract(c.video_path, '[^/]*$')
      LEFT JOIN files s ON starts_with(c.video_path, '/mnt/data/') AND s.path = '/mnt/' || substr(c.video_path, 11))
    SELECT o_orderkey, coalesce(exact, a, b, named, swapped, video_path) AS video_path FROM tried
    """,
)
def path_repair(spark, folder):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    start = F.when(c % 4 == 0, "/a/set/").when(c % 4 == 1, "/b/set/").when(c % 4 == 2, "/deep/").otherwise("/mnt/")
    files = table(spark, folder, "customer").filter("c_custkey % 7 > 0").select(
        F.concat(start, F.lit("c"), c, F.lit(".mp4")).alias("path"), F.lit(0).alias("root_rank")
    )
    leaf = F.concat(F.lit("c"), "o_custkey", F.lit(".mp4"))
    prefix = F.when(k % 5 == 0, "/deep/").when(k % 5 == 1, "/old/data/set/").when(k % 5 == 2, "/x/").when(k % 5 == 3, "/mnt/data/")
    clips = table(spark, folder, "orders").select("o_orderkey", F.coalesce(F.concat(prefix, leaf), F.lit("")).alias("video_path"))
    return M.repair_paths(clips, files, ["/a", "/b"])


@register(
    CASES,
    """
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 1920 ELSE 100 + c_nationkey END AS width,
      CASE WHEN c_custkey IS NULL THEN 1080 ELSE 200 + c_nationkey END AS height
    FROM orders LEFT JOIN (FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey
    """,
)
def image_sizes(spark, folder):
    sizes = table(spark, folder, "customer").filter("c_custkey % 3 > 0").select(
        F.concat(F.lit("k"), "c_custkey").alias("path"),
        (F.col("c_nationkey") + 100).alias("width"),
        (F.col("c_nationkey") + 200).alias("height"),
    )
    rows = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("k"), "o_custkey").alias("key_frame_path"))
    return M.with_image_size(rows, sizes).select("o_orderkey", "width", "height")


# Record trees: a customer is a video. Most have numbered folders, some are flat, some lack image, sentence or record.
_TREE = """
numbered AS (
  SELECT o_custkey AS c, o_orderkey AS i, 'c_' || o_custkey AS base, CAST(o_orderkey AS VARCHAR) AS idx FROM orders WHERE o_custkey % 4 > 0),
flat AS (SELECT c_custkey AS c, c_custkey AS i, 'c_' || c_custkey AS base, NULL::VARCHAR AS idx FROM customer),
kept AS (
  SELECT * FROM numbered WHERE i % 6 > 0
  UNION ALL SELECT * FROM flat WHERE i % 6 > 0 AND c NOT IN (SELECT c FROM numbered))"""


def _tree(spark, folder):
    c, o = F.col("c_custkey"), F.col("o_custkey")
    numbered = table(spark, folder, "orders").filter("o_custkey % 4 > 0").select(
        F.col("o_orderkey").alias("i"), F.concat(F.lit("/out/stage1/c_"), o, F.lit("/"), "o_orderkey").alias("dir")
    )
    flat = table(spark, folder, "customer").select(c.alias("i"), F.concat(F.lit("/out/stage1/c_"), c).alias("dir"))
    places = numbered.unionByName(flat)
    metadata = F.concat("dir", F.lit("/metadata.json"))
    records = places.filter("i % 6 <> 1").select(
        metadata.alias("path"),
        F.lit("?").alias("vid"),
        F.when(F.col("i") % 6 != 2, F.concat(F.lit("q"), "i")).alias("text_query"),
    )
    images = places.filter("i % 6 <> 3").select(F.concat("dir", F.lit("/key_frame.png")).alias("path"))
    other = places.select(F.concat("dir", F.lit("/similarity_scores.npy")).alias("path"))
    files = records.select("path").unionByName(images).unionByName(other)
    return records, files


_KEPT = "kept.i % 6 NOT IN (1, 2, 3)"


@register(
    CASES,
    f"""
    WITH {_TREE.replace("i % 6 > 0 AND ", "").replace(" WHERE i % 6 > 0", "")}
    SELECT base || coalesce('_' || idx, '') AS vid, base AS base_vid, idx, 'q' || i AS text_query,
      '/out/stage1/' || base || coalesce('/' || idx, '') || '/key_frame.png' AS key_frame_path
    FROM kept WHERE {_KEPT}
    """,
)
def record_scan(spark, folder):
    return R.scan_key_frames(*_tree(spark, folder))


@register(
    CASES,
    f"""
    WITH {_TREE.replace("i % 6 > 0 AND ", "").replace(" WHERE i % 6 > 0", "")}
    SELECT base || coalesce('_' || idx, '') AS vid FROM kept WHERE {_KEPT}
    ORDER BY base, TRY_CAST(idx AS BIGINT) NULLS FIRST LIMIT 25
    """,
)
def record_scan_limit(spark, folder):
    return R.scan_key_frames(*_tree(spark, folder), limit=25).select("vid")


@register(
    CASES,
    """
    WITH places AS (
      SELECT o_orderkey AS k, p, 'o' || o_orderkey || '_1' AS vid FROM orders, (SELECT unnest([0, 1, 2]) AS p) WHERE (o_orderkey + p) % 4 <> 1),
    chosen AS (SELECT k, vid, min(p) AS p FROM places GROUP BY ALL)
    SELECT vid, p::VARCHAR AS text_query, ['/base', '/base/first', '/base/second'][p + 1] || '/stage1/o' || k || '/1/key_frame.png' AS key_frame_path
    FROM chosen WHERE (k + p) % 3 > 0
    """,
)
def preferred_layout(spark, folder):
    place = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), place.alias("p"))
    roots = F.array(F.lit("/base"), F.lit("/base/first"), F.lit("/base/second"))
    folder_of = F.concat(F.element_at(roots, F.col("p") + 1), F.lit("/stage1/o"), "k", F.lit("/1/"))
    there = rows.filter("(k + p) % 4 <> 1")
    records = there.select(
        F.concat(folder_of, F.lit("metadata.json")).alias("path"),
        F.lit("?").alias("vid"),
        F.col("p").cast("string").alias("text_query"),
    )
    images = rows.filter("(k + p) % 3 > 0").select(F.concat(folder_of, F.lit("key_frame.png")).alias("path"))
    files = records.select("path").unionByName(images)
    return R.preferred_records(records, files, ["first", "second"], root="/base").select(
        "vid", "text_query", "key_frame_path"
    )


_SETS = """
sets AS (
  SELECT o_orderkey AS set_id, 'o' || o_orderkey AS base_vid, o_orderpriority AS prompt, CASE o_orderkey % 3 WHEN 0 THEN 'x.mp4' ELSE 'y.mp4' END AS video_path,
    CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 3 END AS num_tubes FROM orders WHERE o_orderkey % 5 > 0)"""


@register(
    CASES,
    f"""
    WITH {_SETS}
    SELECT o_orderkey, CASE WHEN s.set_id IS NULL THEN 'not_found' WHEN coalesce(num_tubes, 0) = 0 THEN 'zero'
      WHEN EXISTS (FROM lineitem WHERE l_orderkey = s.set_id) THEN 'tubes' ELSE 'not_found' END AS tube_state
    FROM orders o LEFT JOIN sets s ON s.base_vid = 'o' || o_orderkey AND s.video_path = 'y.mp4'
      AND s.prompt = CASE WHEN o_orderkey % 7 = 0 THEN 'else' ELSE o_orderpriority END
    """,
)
def tube_state(spark, folder):
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    sets = orders.filter("o_orderkey % 5 > 0").select(
        k.alias("set_id"),
        F.concat(F.lit("o"), k).alias("base_vid"),
        F.col("o_orderpriority").alias("prompt"),
        F.when(k % 3 == 0, "x.mp4").otherwise("y.mp4").alias("video_path"),
        F.when(k % 4 == 0, 0).when(k % 4 > 1, 3).alias("num_tubes"),
    )
    clips = orders.select(
        "o_orderkey",
        F.concat(F.lit("o"), k).alias("base_vid"),
        F.when(k % 7 == 0, "else").otherwise(F.col("o_orderpriority")).alias("prompt"),
        F.lit("y.mp4").alias("video_path"),
    )
    frames = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("set_id"))
    return T.attach_tube_sets(clips, sets, frames).select("o_orderkey", "tube_state")


@register(
    CASES,
    f"""
    WITH {_SETS}
    SELECT o_orderkey, CASE WHEN s.set_id IS NULL THEN 'not_found' WHEN o_orderkey % 2 = 0 THEN 'tubes' WHEN coalesce(num_tubes, 0) = 0 THEN 'zero'
      ELSE 'tubes' END AS tube_state, CASE WHEN o_orderkey % 2 = 0 THEN -s.set_id ELSE s.set_id END AS set_id
    FROM orders o LEFT JOIN sets s ON s.base_vid = 'o' || o_orderkey AND s.video_path = 'y.mp4' AND s.prompt = o_orderpriority
    """,
)
def tube_state_rerun(spark, folder):
    """Sets of even orders were computed anew under another set_id; the last run counts, and no clip comes twice."""
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    clips = orders.select("o_orderkey", F.concat(F.lit("o"), k).alias("base_vid"), F.col("o_orderpriority").alias("prompt"), F.lit("y.mp4").alias("video_path"))
    first = orders.filter("o_orderkey % 5 > 0").select(
        k.alias("set_id"),
        F.concat(F.lit("o"), k).alias("base_vid"),
        F.col("o_orderpriority").alias("prompt"),
        F.when(k % 3 == 0, "x.mp4").otherwise("y.mp4").alias("video_path"),
        F.when(k % 4 == 0, 0).when(k % 4 > 1, 3).alias("num_tubes"),
        F.lit(1).alias("run"),
    )
    again = first.filter("set_id % 2 = 0").withColumns({"set_id": -F.col("set_id"), "num_tubes": F.lit(5), "run": F.lit(2)})
    return T.attach_tube_sets(clips, first.unionByName(again)).select("o_orderkey", "tube_state", "set_id")


@register(
    CASES,
    """
    WITH sets AS (SELECT o_custkey AS base_vid, o_orderkey AS set_id, o_orderpriority || o_orderkey AS object_name FROM orders
      UNION ALL SELECT c_custkey, -c_custkey, NULL FROM customer)
    SELECT base_vid, arg_min(set_id, (object_name IS NULL, coalesce(object_name, ''))) AS set_id FROM sets GROUP BY base_vid
    """,
)
def tube_set_choice(spark, folder):
    k = F.col("o_orderkey")
    named = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("base_vid"), k.alias("set_id"), F.concat("o_orderpriority", k).alias("object_name")
    )
    old = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("base_vid"), (-F.col("c_custkey")).alias("set_id"), F.lit(None).cast("string").alias("object_name")
    )
    return T.find_tube_set(named.unionByName(old)).select("base_vid", "set_id")


def _hex(value, digits):
    return F.lpad(F.hex(value), digits, "0")


def _little(value, size):
    return F.concat(*(_hex(F.shiftright(value, 8 * i).bitwiseAND(255), 2) for i in range(size)))


def _headers(spark, folder):
    """A part is a file: a picture, a video or a picture whose header is cut off; size, frames and rate come from its row."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    w, h, frames = size * 16, k % 1000 + 1, k % 5000 + 1
    text = lambda t: F.lit(t.encode().hex())
    box = lambda name, length, *content: F.concat(_hex(F.lit(length), 8), text(name), *content)
    zeros = lambda n: F.lit("00" * n)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D"), text("IHDR"), _hex(w, 8), _hex(h, 8), F.lit("0802000000"))
    gif = F.concat(text("GIF89a"), _little(w, 2), _little(h, 2))
    bmp = F.concat(text("BM"), zeros(12), _little(F.lit(40), 4), _little(w, 4), _little(h, 4))
    entry = box("avc1", 36, zeros(24), _hex(w, 4), _hex(h, 4))
    stbl = box("stbl", 84, box("stsd", 52, zeros(7), F.lit("01"), entry), box("stts", 24, zeros(7), F.lit("01"), _hex(frames, 8), _hex(F.lit(100), 8)))
    times = box("mdhd", 32, zeros(12), _hex((size + 20) * 100, 8), _hex(frames * 100, 8), zeros(4))
    mdia = box("mdia", 156, times, box("hdlr", 24, zeros(8), text("vide"), zeros(4)), box("minf", 92, stbl))
    mp4 = F.concat(box("ftyp", 16, zeros(8)), box("moov", 172, box("trak", 164, mdia)))
    kind = k % 5
    data = F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, bmp).when(kind == 3, mp4).otherwise(F.substring(png, 1, 44))
    return table(spark, folder, "part").select("p_partkey", F.unhex(data).alias("content"))


@register(
    CASES,
    """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'gif' WHEN 2 THEN 'bmp' WHEN 3 THEN 'mp4' ELSE 'png' END AS kind,
      CASE WHEN p_partkey % 5 < 4 THEN p_size * 16 END AS width, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 1000 + 1 END AS height,
      CASE p_partkey % 5 WHEN 3 THEN p_partkey % 5000 + 1 WHEN 4 THEN NULL ELSE 1 END AS num_frames,
      CASE WHEN p_partkey % 5 = 3 THEN (20 + p_size)::DOUBLE END AS fps, p_partkey % 5 < 4 AS readable FROM part
    """,
)
def media_headers(spark, folder):
    return header_facts(_headers(spark, folder))


@register(
    CASES,
    """
    SELECT event_type || '/' || day(ts) AS place, 1 AS num_files FROM events GROUP BY event_type, day(ts)
    UNION ALL SELECT 'types', count(DISTINCT event_type) FROM events
    """,
)
def folder_walk(spark, folder):
    """Events written by type and day into folders, and the folders listed by tasks."""
    path = shared_folder(spark, "walk")
    events = table(spark, folder, "events").select("event_type", F.dayofmonth("ts").alias("day"), "event_id")
    events.repartition("event_type", "day").write.partitionBy("event_type", "day").parquet(path)
    files = walk_files(spark, [path], ["*.parquet"])
    place = F.regexp_extract("path", "event_type=([^/]+)/day=([^/]+)/[^/]+$", 1)
    day = F.regexp_extract("path", "event_type=([^/]+)/day=([^/]+)/[^/]+$", 2)
    counted = files.groupBy(F.concat(place, F.lit("/"), day).alias("place")).agg(F.count(F.lit(1)).alias("num_files"))
    return counted.unionByName(files.agg(F.lit("types").alias("place"), F.countDistinct(place).alias("num_files")))
