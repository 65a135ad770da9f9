"""Sentences and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgrid.catalog.base import REPLIES, SENTENCES, Case, register, replies, sentences, table
from clipgrid.functions import text as X
from clipgrid.functions.names import strip
from clipgrid.plans.grounding import ground_from_replies
from clipgrid.sources.media import inline_image, mime_type

CASES: dict[str, Case] = {}

_PREPOSITIONS = "|".join(X.PREPOSITIONS)
_STOP = str(list(X.ANSWER_STOP_WORDS))


def _noun_sql(text: str) -> str:
    """Head noun rules for a lower-case trimmed SQL text expression."""
    rules = (
        rf"there\s+(?:is|are)\s+(?:a|an|the)?\s*([a-z\s]+?)\s+(?:{_PREPOSITIONS})",
        r"^(?:a|an|the)?\s*([a-z\s]+?)\s+is\s+",
        r"^(?:a|an|the)?\s*([a-z]+(?:\s+[a-z]+)?)",
    )
    picks = [
        f"nullif(string_split_regex(trim(regexp_extract({text}, '{rule}', 1)), '\\s+')[-1], '')" for rule in rules
    ]
    noun = f"coalesce({', '.join(picks)}, 'object')"
    return f"CASE WHEN {noun} IN ('adult', 'adults') THEN 'person' ELSE {noun} END"


@register(
    CASES,
    f"""
    WITH {SENTENCES}
    SELECT p_partkey, CASE WHEN {_noun_sql("trim(lower(sentence))")} IS NULL THEN 'object'
      ELSE {_noun_sql("trim(lower(sentence))")} END AS noun FROM sentences
    """,
)
def subject_noun(spark, folder):
    return sentences(spark, folder).select("p_partkey", X.subject_noun(F.col("sentence")).alias("noun"))


@register(
    CASES,
    rf"""
    WITH {SENTENCES},
    r AS (SELECT *, regexp_replace(trim(sentence), '\.$', '') AS cleaned,
        lower(p_type) || '_' || CASE WHEN p_size % 5 = 0 THEN 'Adults' ELSE split_part(p_name, ' ', 2) END AS compound
      FROM sentences),
    w AS (SELECT *, string_split_regex(trim(replace(compound, '_', ' ')), '\s+')[-1] AS last FROM r)
    SELECT p_partkey, cleaned, CASE WHEN lower(last) IN ('adult', 'adults') THEN 'person' ELSE last END AS word,
      CASE WHEN lower(compound) IN ('adult', 'adults') THEN 'person' ELSE compound END AS refined FROM w
    """,
)
def word_normalise(spark, folder):
    adult = F.when(F.col("p_size") % 5 == 0, "Adults").otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    rows = sentences(spark, folder).withColumn("compound", F.concat_ws("_", F.lower("p_type"), adult))
    return rows.select(
        "p_partkey",
        X.clean_query(F.col("sentence")).alias("cleaned"),
        X.normalise_word(F.col("compound")).alias("word"),
        X.generalise(F.col("compound")).alias("refined"),
    )


_REPLY = """
nouns AS (
  SELECT *, CASE p_partkey % 7
    WHEN 0 THEN 'Output: {"target_prompt": "' || p_name || '"}'
    WHEN 1 THEN '{"target_prompt": " Adult "} '
    WHEN 2 THEN '{"target_prompt": 5, "size": ' || p_size || '}'
    WHEN 3 THEN '{"target_prompt": "' || p_name || '"} and {'
    WHEN 4 THEN 'Output: ' || replace(p_name, ' ', '_')
    WHEN 5 THEN '{"target_prompt": "' || p_name || '"} or {"target_prompt": "x"}'
    ELSE ' {}' END AS reply
  FROM sentences)"""


def _noun_replies(spark, folder):
    kind, name = F.col("p_partkey") % 7, F.col("p_name")
    named = F.concat(F.lit('{"target_prompt": "'), name, F.lit('"}'))
    reply = (
        F.when(kind == 0, F.concat(F.lit("Output: "), named))
        .when(kind == 1, F.lit('{"target_prompt": " Adult "} '))
        .when(kind == 2, F.concat(F.lit('{"target_prompt": 5, "size": '), F.col("p_size"), F.lit("}")))
        .when(kind == 3, F.concat(named, F.lit(" and {")))
        .when(kind == 4, F.concat(F.lit("Output: "), F.replace(name, F.lit(" "), F.lit("_"))))
        .when(kind == 5, F.concat(named, F.lit(' or {"target_prompt": "x"}')))
        .otherwise(F.lit(" {}"))
    )
    return sentences(spark, folder).withColumn("reply", reply)


_QUESTION = f"""(trim(sentence) LIKE '%?' OR regexp_matches(lower(trim(sentence)), '^({"|".join(X.QUESTION_WORDS)})[ ?]'))"""


@register(
    CASES,
    rf"""
    WITH {SENTENCES}, {_REPLY},
    j AS (SELECT *, regexp_extract(reply, '(?s)\{{.*\}}') AS braced,
        trim(replace(replace(replace(replace(reply, 'Output:', ''), '"', ''), '}}', ''), '{{', '')) AS bare FROM nouns),
    s AS (SELECT *, CASE WHEN json_valid(braced) THEN CASE WHEN json_type(braced, '$.target_prompt') = 'VARCHAR'
        THEN nullif(trim(json_extract_string(braced, '$.target_prompt')), '') END END AS named FROM j),
    t AS (SELECT *, string_split_regex(trim(replace(coalesce(named, nullif(bare, '')), '_', ' ')), '\s+')[-1] AS stated,
        regexp_replace(trim(sentence), '\.$', '') AS cleaned FROM s),
    u AS (SELECT *, CASE WHEN stated IS NULL THEN {_noun_sql("trim(lower(cleaned))")}
        WHEN lower(stated) IN ('adult', 'adults') THEN 'person' ELSE stated END AS noun FROM t)
    SELECT p_partkey, noun, CASE WHEN {_QUESTION} THEN sentence ELSE noun END AS target FROM u
    """,
)
def noun_from_reply(spark, folder):
    text, reply = F.col("sentence"), F.col("reply")
    return _noun_replies(spark, folder).select(
        "p_partkey",
        X.noun_from_reply(reply, text).alias("noun"),
        X.target_object(reply, text, X.is_question(text)).alias("target"),
    )


@register(
    CASES,
    f"""
    WITH {SENTENCES}
    SELECT p_partkey, {_QUESTION} AS is_question,
      CASE WHEN {_QUESTION} THEN 'Q ' || sentence || ' ?' ELSE 'S ' || sentence || ' .' END AS request,
      trim(sentence) = '' AS blank
    FROM sentences
    """,
)
def questions(spark, folder):
    text = F.col("sentence")
    return sentences(spark, folder).select(
        "p_partkey",
        X.is_question(text).alias("is_question"),
        X.request_text(text, "Q {query} ?", "S {query} .").alias("request"),
        X.is_blank(text).alias("blank"),
    )


@register(
    CASES,
    """
    SELECT role, count(*) AS turns, CAST(sum(CASE WHEN trim(text, chr(10) || ' ') LIKE '%?'
        OR regexp_matches(lower(trim(text, chr(10) || ' ')), '^(what|where|who|which|when|how|why|whose|whom)[ ?]')
        THEN 1 ELSE 0 END) AS BIGINT) AS questions,
      CAST(sum(length(trim(text, chr(10) || ' '))) AS BIGINT) AS characters
    FROM conversations GROUP BY role
    """,
)
def conversation_questions(spark, folder):
    text = F.col("text")
    return (
        table(spark, folder, "conversations")
        .groupBy("role")
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.count_if(X.is_question(text)).alias("questions"),
            F.sum(F.length(strip(text)).cast("long")).alias("characters"),
        )
    )


# The four box notations in this dialect.
_TOKENS = r"(?:<\|box_start\|>|<tool_call>)\s*\(\d+\s*,\s*\d+\)\s*,\s*\(\d+\s*,\s*\d+\)\s*<\|box_end\|>"
_PLAIN = r"\(\d+\s*,\s*\d+\)\s*,\s*\(\d+\s*,\s*\d+\)"
_TARGET = r"[Tt]arget\s*:\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+"
_BRACKET = r"\[\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\]"

_PARSED = rf"""
matched AS (
  SELECT *, CASE WHEN regexp_matches(lower(reply), 'target: ?none') AND regexp_matches(reply, '[Tt]arget\s*:\s*[Nn]one') THEN NULL
    ELSE regexp_extract_all(coalesce(regexp_extract_all(reply, '{_TOKENS}')[-1], regexp_extract_all(reply, '{_PLAIN}')[-1],
      regexp_extract_all(reply, '{_TARGET}')[-1], regexp_extract_all(reply, '{_BRACKET}')[-1]), '\d+') END AS n
  FROM replies),
coords AS (
  SELECT *, CAST(n[1] AS BIGINT) AS x1, CAST(n[2] AS BIGINT) AS y1, CAST(n[3] AS BIGINT) AS x2, CAST(n[4] AS BIGINT) AS y2 FROM matched),
scaled AS (
  SELECT *, greatest(x1, y1, x2, y2) <= 1000 AS by_scale FROM coords),
answered AS (
  SELECT *, list_filter(string_split_regex(trim(regexp_replace(trim(lower(
      regexp_extract(reply, '(?is)answer[:\s]+(.*?)(?:\n|reasoning|target|$)', 1))), '[^\w\s]', '', 'g')), '\s+'), lambda w: w <> '') AS words,
    nullif(regexp_extract(reply, '[Aa]nswer[:\s]+([A-Za-z]+)', 1), '') AS first_word
  FROM scaled),
parsed AS (
  SELECT *, CASE WHEN by_scale THEN CAST(trunc(x1 / 1000.0::DOUBLE * width) AS BIGINT) ELSE x1 END AS xmin,
    CASE WHEN by_scale THEN CAST(trunc(y1 / 1000.0::DOUBLE * height) AS BIGINT) ELSE y1 END AS ymin,
    CASE WHEN by_scale THEN CAST(trunc(x2 / 1000.0::DOUBLE * width) AS BIGINT) ELSE x2 END AS xmax,
    CASE WHEN by_scale THEN CAST(trunc(y2 / 1000.0::DOUBLE * height) AS BIGINT) ELSE y2 END AS ymax,
    CASE WHEN NOT is_question THEN first_word
      WHEN len(list_filter(words, lambda w: NOT list_contains({_STOP}, w))) = 0 THEN NULL
      WHEN list_contains({_STOP}, words[-1]) THEN words[-2] ELSE words[-1] END AS answer,
    CASE WHEN x1 IS NOT NULL THEN NULL WHEN reply = '' THEN 'bbox_parsing_failed'
      WHEN regexp_matches(lower(reply), 'target: none|target:none|subject does not exist|no subject|cannot find|not found')
        THEN 'subject_not_found' ELSE 'bbox_not_detected' END AS failure_reason
  FROM answered)"""


@register(
    CASES,
    rf"""
    WITH {REPLIES}, {_PARSED}
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, xmin, ymin, xmax, ymax, answer, x1 IS NOT NULL AS success,
      failure_reason FROM parsed
    """,
)
def reply_parse(spark, folder):
    return X.parse_replies(replies(spark, folder)).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "bbox.*",
        "answer",
        "success",
        "failure_reason",
    )


@register(
    CASES,
    rf"""
    WITH {REPLIES}, {_PARSED}
    SELECT failure_reason, answer, count(*) AS replies, CAST(sum(xmax - xmin) AS BIGINT) AS widths FROM parsed
    GROUP BY ALL
    """,
)
def reply_failures(spark, folder):
    parsed = X.parse_replies(replies(spark, folder))
    return parsed.groupBy("failure_reason", "answer").agg(
        F.count(F.lit(1)).alias("replies"), F.sum(F.col("bbox.xmax") - F.col("bbox.xmin")).alias("widths")
    )


@register(
    CASES,
    rf"""
    WITH {REPLIES}, {_PARSED}
    SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS vid, 'direct' AS method, x1 IS NOT NULL AS success, xmin, ymax,
      CASE WHEN x1 IS NOT NULL THEN nullif(answer, '') END AS answer, nullif(reply, '') AS raw_output, failure_reason
    FROM parsed
    """,
)
def grounding_from_replies(spark, folder):
    rows = replies(spark, folder).withColumns(
        {
            "vid": F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
            "text_query": F.when(F.col("is_question"), "what is it?").otherwise("a thing"),
            "target_object": F.lit("thing"),
        }
    )
    return ground_from_replies(rows, "direct").select(
        "vid", "method", "success", "bbox.xmin", "bbox.ymax", "answer", "raw_output", "failure_reason"
    )


@register(
    CASES,
    """
    SELECT event_id, CASE WHEN oom THEN 'cuda_oom' WHEN event_id % 2 = 0 THEN 'runtime_error' ELSE 'general_exception' END AS reason,
      oom OR contains(lower(message), 'killed') AS stops
    FROM (SELECT *, contains(lower(message), 'out of memory') OR contains(lower(message), 'cuda') AS oom
      FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'CUDA failure ' WHEN 'click' THEN 'Out Of Memory at '
        WHEN 'view' THEN 'process Killed ' ELSE 'bad value ' END || props AS message FROM events))
    """,
)
def error_reasons(spark, folder):
    kind = F.col("event_type")
    message = F.concat(
        F.when(kind == "error", "CUDA failure ")
        .when(kind == "click", "Out Of Memory at ")
        .when(kind == "view", "process Killed ")
        .otherwise("bad value "),
        "props",
    )
    return table(spark, folder, "events").select(
        "event_id",
        X.error_reason(message, F.col("event_id") % 2 == 0).alias("reason"),
        X.is_memory_error(message, killed=True).alias("stops"),
    )


@register(
    CASES,
    r"""
    SELECT page_id, to_base64(encode(html)) AS image, CASE lower(ext) WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif'
      WHEN '.webp' THEN 'image/webp' WHEN '.bmp' THEN 'image/bmp' ELSE 'image/jpeg' END AS mime
    FROM (SELECT *, ['.png', '.JPG', '.Gif', '.webp', '.bmp', '', '.tiff', '.jpeg'][page_id % 8 + 1] AS ext FROM pages)
    """,
)
def inline_images(spark, folder):
    extensions = F.array(*[F.lit(e) for e in (".png", ".JPG", ".Gif", ".webp", ".bmp", "", ".tiff", ".jpeg")])
    path = F.concat(F.lit("frames/"), "page_id", F.element_at(extensions, (F.col("page_id") % 8 + 1).cast("int")))
    return table(spark, folder, "pages").select(
        "page_id", inline_image(F.encode("html", "UTF-8")).alias("image"), mime_type(path).alias("mime")
    )


@register(
    CASES,
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, vid, ok AS success, CASE WHEN x THEN 'direct' ELSE 'unknown' END AS method,
      CASE WHEN ok THEN l_partkey % 800 END AS xmin, CASE WHEN ok THEN round(l_tax, 6) END AS confidence,
      CASE WHEN ok THEN round(l_discount, 6) END AS coverage
    FROM (SELECT *, 'o' || l_orderkey AS vid, l_linenumber % 3 > 0 AS ok, l_linenumber % 2 = 0 AS x FROM lineitem)
    """,
)
def grounding_json(spark, folder):
    """Records written as JSON and read back with the defaults of a sparse record."""
    from clipgrid.schemas import GROUNDING
    from clipgrid.sources.records import typed_grounding

    ok = F.col("l_linenumber") % 3 > 0
    x = F.col("l_partkey") % 800
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    record = F.struct(
        F.concat(F.lit("o"), "l_orderkey").alias("vid"),
        F.when(ok, F.lit(True)).alias("success"),
        F.when(F.col("l_linenumber") % 2 == 0, "direct").alias("method"),
        F.when(ok, F.struct(x.alias("xmin"), F.lit(1).alias("ymin"), (x + 9).alias("xmax"), F.lit(2).alias("ymax"))).alias("bbox"),
        F.when(ok, F.col("l_tax")).alias("confidence"),
        F.when(ok, F.create_map(F.lit("mask_coverage"), F.col("l_discount"))).alias("extras"),
    )
    text = table(spark, folder, "lineitem").select(*keys, F.to_json(record).alias("json"))
    parsed = text.select(*keys, F.from_json("json", GROUNDING).alias("r")).select(*keys, "r.*")
    typed = typed_grounding(parsed.withColumn("answer", F.concat_ws(" ", *keys)))
    at = F.split("answer", " ")
    return typed.select(
        *[at[i].cast("long").alias(k) for i, k in enumerate(keys)],
        "vid",
        "success",
        "method",
        "bbox.xmin",
        F.round("confidence", 6).alias("confidence"),
        F.round(F.try_element_at("extras", F.lit("mask_coverage")), 6).alias("coverage"),
    )
