"""Identifiers, sentences and replies."""

from __future__ import annotations

import os.path
import re

import pytest
from pyspark.sql import functions as F

from clipgrid.functions import names as N
from clipgrid.functions import text as X


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", function(F.col("t")).alias("o")).orderBy("i").collect()]


def test_vid_splits_at_the_last_underscore(spark):
    values = ["2400171624_1", "a_b", "plain", "x_y_3", "_", "line\nbreak_7", "end_"]
    assert apply(spark, N.base_vid, values) == ["2400171624", "a", "plain", "x_y", "", "line\nbreak", "end"]
    assert apply(spark, N.clip_idx, values) == ["1", "b", None, "3", "", "7", ""]


def test_file_names_follow_the_usual_rules(spark):
    values = ["a.mp4", "a.b.mkv", ".mkv", "dir.x/name", "dir/.hidden", "a..b", "x.", "UP.MP4", "no"]
    assert apply(spark, N.file_stem, values) == [os.path.splitext(v)[0] for v in values]
    assert apply(spark, N.file_extension, values) == [os.path.splitext(v)[1].lower() for v in values]


def test_keys_keep_unicode_words(spark):
    values = ["Café au lait!", "  a -- b  ", "__x__", "日本 語", "a b", "!!!", "ét́", "x²"]

    def object_key(v):
        return re.sub("_+", "_", re.sub(r"[^\w\-]", "_", v.lower().strip())).strip("_")

    def prompt_key(v):
        return re.sub(r"[^\w\s-]", "", v).strip().replace(" ", "_") or "unknown"

    assert apply(spark, N.object_key, values) == [object_key(v) for v in values]
    assert apply(spark, N.prompt_key, values) == [prompt_key(v) for v in values]


def test_strip_and_words_are_unicode_aware(spark):
    values = ["　a b ", "\x1ca\x1d", "", " \n ", "x"]
    assert apply(spark, N.strip, values) == [v.strip() for v in values]
    assert apply(spark, N.words, values) == [v.split() for v in values]


def test_mask_names(spark):
    df = spark.createDataFrame([(42,), (123456,)], "i long")
    assert [r[0] for r in df.select(N.mask_name(F.col("i"))).collect()] == ["mask_00042.png", "mask_123456.png"]
    assert apply(spark, N.mask_index, ["mask_00042.png", "mask_x.png", "frame_1.png"]) == [42, None, None]


def test_alias_table(spark):
    known = {"short": "long_name", "long_name": "long_name"}
    assert apply(spark, lambda c: N.canonical_key(c, known), [" short ", "long_name"]) == ["long_name"] * 2
    with pytest.raises(Exception, match="unsupported dataset 'x'; expected long_name"):
        apply(spark, lambda c: N.canonical_key(c, known), ["x"])
    with pytest.raises(Exception, match="unsupported dataset"):
        apply(spark, lambda c: N.canonical_key(c, known), [None])


def test_questions(spark):
    values = ["What is it", "what?", "whatever", " where x ", "A dog?", "a dog", "How", "WHO are you", "whose? yes"]
    assert apply(spark, X.is_question, values) == [True, True, False, True, True, False, False, True, True]


def test_subject_nouns(spark):
    values = [
        "There is a green bicycle near a wall.",
        "there are the two dogs interesting people",
        "The kettle is under the shelf",
        "an adult carries a crate",
        "adults run",
        "apple",
        "adult",
        "123",
        "there is  an  old adult near me",
    ]
    expected = ["bicycle", "dogs", "kettle", "person", "run", "pple", "dult", "object", "person"]
    assert apply(spark, X.subject_noun, values) == expected
    strict = apply(spark, lambda c: X.subject_noun(c, strict=True), values)
    assert strict == ["bicycle", "are", "kettle", "carries", "run", "apple", "person", "object", "person"]


def test_words_are_normalised(spark):
    assert apply(spark, X.normalise_word, ["adult_woman", "Adults", "red dog", " x "]) == ["woman", "person", "dog", "x"]
    assert apply(spark, X.clean_query, [" a dog.. ", "x.", "y"]) == ["a dog.", "x", "y"]


def test_noun_replies(spark):
    values = [
        'Output: {"target_prompt": "green bicycle"}',
        '{"target_prompt": "x"} and {more}',
        '{"target_prompt": 7}',
        '{"target_prompt": ""}',
        "Output: toy",
        '{"target_prompt": "a"}] {}',
        "{}",
        None,
    ]
    got = apply(spark, lambda c: X.noun_from_reply(c, F.lit("The kettle is on.")), values)
    assert got == ["bicycle", "more", "7", "prompt:", "toy", "a]", "kettle", "kettle"]


def test_answers(spark):
    values = [
        "Answer: the red dogs\nReasoning: x",
        "answer the boy one",
        "Answer: dog one two",
        "Answer: the one",
        "Answer: boy Target: (1,2)",
        "Answer:\n\nyes",
        "nothing",
        "ANSWER: Ünï çafé!",
        "Answer:",
    ]
    expected = ["dogs", "boy", "one", None, "boy", None, None, "çafé", None]
    assert apply(spark, X.question_answer, values) == expected
    assert apply(spark, X.statement_answer, ["Answer: dog2", "answer 9", "x"]) == ["dog", None, None]


def test_boxes_in_replies(spark):
    values = [
        "(1,2),(3,4) <|box_start|>(5, 6),(7,8)<|box_end|>",
        "(1,2),(3,4) then (5,6) , (7,8)",
        "target: 1, 2,3 ,4",
        "[1,2,3,4] [5,6,7,8]",
        "Target: None (1,2),(3,4)",
        "TARGET: NONE (1,2),(3,4)",
        "target : none (1,2),(3,4)",
        "<tool_call>(1,2),(3,4)<|box_end|>",
        "no box",
    ]
    expected = [[5, 6, 7, 8], [5, 6, 7, 8], [1, 2, 3, 4], [5, 6, 7, 8], None, [1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4], None]
    got = apply(spark, X.box_numbers, values)
    assert [None if g is None else [int(n) for n in g] for g in got] == expected


def test_reply_rows(spark):
    df = spark.createDataFrame(
        [("[500, 0, 1000, 1000]", False, 640, 480), ("[1,2,3,2000]", False, 640, 480), ("", True, 1, 1), ("cannot find it", True, 1, 1)],
        "reply string, is_question boolean, width int, height int",
    )
    got = {r["reply"]: r for r in X.parse_replies(df).collect()}
    assert tuple(got["[500, 0, 1000, 1000]"]["bbox"]) == (320, 0, 640, 480)
    assert tuple(got["[1,2,3,2000]"]["bbox"]) == (1, 2, 3, 2000)
    assert got[""]["failure_reason"] == "bbox_parsing_failed"
    assert got["cannot find it"]["failure_reason"] == "subject_not_found"


def test_error_texts(spark):
    assert apply(spark, lambda c: X.error_reason(c, F.lit(True)), ["CUDA error", "Out of memory", "x"]) == [
        "cuda_oom",
        "cuda_oom",
        "runtime_error",
    ]
    assert apply(spark, lambda c: X.error_reason(c, F.lit(False)), ["x", "killed"]) == ["general_exception"] * 2
    assert apply(spark, lambda c: X.is_memory_error(c, killed=True), ["Killed", "x"]) == [True, False]


def test_request_messages(spark):
    import json

    row = spark.range(1).select(X.request_messages(F.lit("what?"), F.lit("QUJD"), F.lit("image/png"), question_template="Q:{query}")).first()
    assert json.loads(row[0]) == [
        {
            "role": "user",
            "content": [
                {"type": "image_url", "image_url": {"url": "data:image/png;base64,QUJD"}},
                {"type": "text", "text": "Q:what?"},
            ],
        }
    ]
