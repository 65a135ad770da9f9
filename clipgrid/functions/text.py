"""Sentences and model replies: nouns, answers, boxes, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.functions.boxes import SIDES, decode_coordinates
from clipgrid.functions.names import SPACE, WORD, strip, words

# Word lists and reply notations that decide results.
QUESTION_WORDS = ("what", "where", "who", "which", "when", "how", "why", "whose", "whom")
PREPOSITIONS = (
    "in", "on", "at", "under", "beneath", "behind", "above", "next", "near", "with", "towards", "watching",
    "biting", "facing",
)
ARTICLES = ("a", "an", "the")
ANSWER_STOP_WORDS = (
    "the", "a", "an", "this", "that", "these", "those",
    "another", "other", "others", "one", "two", "three", "four", "five",
    "six", "seven", "eight", "nine", "ten",
    "yes", "no", "none", "target", "object", "subject",
    "some", "many", "few", "several", "all", "both",
    "first", "second", "third", "last", "next", "previous",
)
NOT_FOUND_PHRASES = (
    "target: none", "target:none", "subject does not exist", "no subject", "cannot find", "not found",
)

_S = f"[{SPACE}]"
_N = "([0-9]+)"
_SEP = f"{_S}*,{_S}*"
_CORNERS = rf"\({_N}{_SEP}{_N}\){_SEP}\({_N}{_SEP}{_N}\)"
_FOUR = f"{_N}{_SEP}{_N}{_SEP}{_N}{_SEP}{_N}"
# The four box notations, most trusted first.
BOX_NOTATIONS = (
    rf"(?:<\|box_start\|>|<tool_call>){_S}*{_CORNERS}{_S}*<\|box_end\|>",
    _CORNERS,
    rf"[Tt]arget{_S}*:{_S}*{_FOUR}",
    rf"\[{_FOUR}\]",
)


def is_question(text: Column) -> Column:
    """Ends with a question mark, or starts with a question word before a blank or a question mark."""
    trimmed = strip(text)
    return trimmed.endswith("?") | F.lower(trimmed).rlike(rf"^(?:{'|'.join(QUESTION_WORDS)})[ ?]")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def clean_query(text: Column) -> Column:
    """Trimmed, without one final full stop."""
    return F.regexp_replace(strip(text), r"\.\z", "")


def generalise(word: Column) -> Column:
    """``adult`` and ``adults`` become ``person``; any other word is kept as it is."""
    return F.when(F.lower(word).isin("adult", "adults"), F.lit("person")).otherwise(word)


def normalise_word(word: Column) -> Column:
    """Underscores as blanks, then the last word, then :func:`generalise`."""
    spaced = strip(F.replace(word, F.lit("_"), F.lit(" ")))
    return generalise(F.coalesce(F.try_element_at(words(spaced), F.lit(-1)), spaced))


def _last_word(text: Column, pattern: str) -> Column:
    return F.try_element_at(words(F.regexp_extract(text, pattern, 1)), F.lit(-1))


def subject_noun(text: Column, strict: bool = False) -> Column:
    """Head noun of a sentence by three rules, else ``object``.

    Rules in order: "there is/are X <preposition>", "X is", the first one or two words; the noun is the last word
    of X. By default the optional article and the prepositions have no word boundary, so "apple" alone gives
    "pple" and "in" also ends X before "inside"; ``strict`` adds the boundaries.
    """
    lowered = strip(F.lower(text))
    article = f"(?:(?:{'|'.join(ARTICLES)}){_S}+)?" if strict else f"(?:{'|'.join(ARTICLES)})?{_S}*"
    ends = rf"(?:{_S}|\z)" if strict else ""
    phrase = f"([a-z{SPACE}]+?)"
    rules = (
        f"there{_S}+(?:is|are){_S}+{article}{phrase}{_S}+(?:{'|'.join(PREPOSITIONS)}){ends}",
        f"^{article}{phrase}{_S}+is{_S}+",
        f"^{article}([a-z]+(?:{_S}+[a-z]+)?)",
    )
    noun = F.coalesce(*[generalise(_last_word(lowered, rule)) for rule in rules], F.lit("object"))
    return F.when(text.isNotNull(), noun)


def noun_from_reply(reply: Column, text_query: Column) -> Column:
    """Noun named by a model reply.

    The text between the first ``{`` and the last ``}`` is read as JSON with the key ``target_prompt``; failing
    that the reply itself without its markup is used; an empty one falls back to :func:`subject_noun`.
    """
    braced = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    # The parser stops after one value, so trailing text only shows inside a wrapper, whatever bracket it holds.
    in_list = F.try_parse_json(F.concat(F.lit("["), braced, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), braced, F.lit("}")))
    value = F.try_variant_get(in_object, "$.v.target_prompt", "variant")
    named = F.when(
        in_list.isNotNull() & (F.schema_of_variant(value) == "STRING"),
        strip(F.try_variant_get(value, "$", "string")),
    )
    bare = reply
    for mark in ("Output:", '"', "}", "{"):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    stated = F.coalesce(F.nullif(named, F.lit("")), F.nullif(strip(bare), F.lit("")))
    return F.coalesce(normalise_word(stated), subject_noun(clean_query(text_query)))


def target_object(reply: Column, text_query: Column, question: Column) -> Column:
    """A question is its own target; a statement gives its noun."""
    return F.when(question, text_query).otherwise(noun_from_reply(reply, text_query))


def answer_words(reply: Column) -> Column:
    """Words of the answer part of a reply to a question, lower case, without punctuation."""
    part = F.regexp_extract(
        reply, rf"(?isU)answer[:{SPACE}]+(.*?)(?:\n|reasoning|target|\z)", 1
    )
    return words(F.regexp_replace(F.lower(strip(part)), rf"[^{WORD}{SPACE}]", ""))


def answer_of_words(answer: Column) -> Column:
    """The last word, or the one before it when the last is a stop word; null if only stop words are left."""
    stop = F.array(*[F.lit(w) for w in ANSWER_STOP_WORDS])
    telling = F.size(F.array_except(answer, stop)) > 0
    last = F.try_element_at(answer, F.lit(-1))
    return F.when(~last.isin(*ANSWER_STOP_WORDS), last).when(telling, F.try_element_at(answer, F.lit(-2)))


def question_answer(reply: Column) -> Column:
    return answer_of_words(answer_words(reply))


def statement_answer(reply: Column) -> Column:
    """First run of ASCII letters after the word ``Answer``."""
    return F.nullif(F.regexp_extract(reply, rf"[Aa]nswer[:{SPACE}]+([A-Za-z]+)", 1), F.lit(""))


def _last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))


def denies_target(reply: Column) -> Column:
    """The reply states that there is no target."""
    return F.lower(reply).rlike("target: ?none") & reply.rlike(rf"[Tt]arget{_S}*:{_S}*[Nn]one")


def box_numbers(reply: Column) -> Column:
    """The four integers of the last box in the first notation that occurs; null if denied or absent."""
    match = F.coalesce(*[_last_match(reply, notation) for notation in BOX_NOTATIONS])
    return F.when(~denies_target(reply), F.regexp_extract_all(match, F.lit("([0-9]+)"), F.lit(1)))


def failure_reason(reply: Column) -> Column:
    """Why a reply gave no box."""
    absent = F.lower(reply).rlike("|".join(NOT_FOUND_PHRASES))
    return (
        F.when(reply.isNull() | (reply == ""), F.lit("bbox_parsing_failed"))
        .when(absent, F.lit("subject_not_found"))
        .otherwise(F.lit("bbox_not_detected"))
    )


def is_memory_error(message: Column, killed: bool = False) -> Column:
    """The error text speaks of exhausted device memory; ``killed`` also accepts a killed process."""
    return F.lower(message).rlike("out of memory|cuda|killed" if killed else "out of memory|cuda")


def error_reason(message: Column, runtime: Column) -> Column:
    """``cuda_oom``, else ``runtime_error`` or ``general_exception`` by the kind of the error."""
    return (
        F.when(is_memory_error(message), F.lit("cuda_oom"))
        .when(runtime, F.lit("runtime_error"))
        .otherwise(F.lit("general_exception"))
    )


def parse_replies(
    rows: DataFrame,
    reply: str = "reply",
    question: str = "is_question",
    width: str = "width",
    height: str = "height",
    mode: str | Column = "auto",
) -> DataFrame:
    """Add ``answer``, ``bbox``, ``success`` and ``failure_reason`` to rows of replies.

    The numbers are extracted and cast in a step of their own, so each pattern runs once per row and the generated
    code of the next step stays small.
    """
    numbers = box_numbers(F.col(reply)).try_cast("array<int>")
    staged = rows.withColumn("_numbers", numbers).withColumn("_words", answer_words(F.col(reply)))
    number = [F.col("_numbers")[i] for i in range(4)]
    complete = number[0].isNotNull() & number[1].isNotNull() & number[2].isNotNull() & number[3].isNotNull()
    stated = F.struct(*[n.alias(side) for n, side in zip(number, SIDES)])
    return (
        staged.withColumn("_stated", F.when(complete, stated))
        .withColumn("bbox", decode_coordinates(F.col("_stated"), F.col(width), F.col(height), mode))
        .withColumn(
            "answer",
            F.when(F.col(question), answer_of_words(F.col("_words"))).otherwise(statement_answer(F.col(reply))),
        )
        .withColumn("success", F.col("bbox").isNotNull())
        .withColumn("failure_reason", F.when(~F.col("success"), failure_reason(F.col(reply))))
        .drop("_numbers", "_words", "_stated")
    )


# Wording of the two requests; jobs may pass their own, with {query} for the sentence.
QUESTION_REQUEST = (
    "Answer the question with one noun and give the box of the object: {query}\n"
    "Reply as:\nAnswer: noun\nTarget: <|box_start|>(x1,y1),(x2,y2)<|box_end|>"
)
STATEMENT_REQUEST = (
    "Give the box of the object described by: {query}\n"
    "Reply as:\nTarget: <|box_start|>(x1,y1),(x2,y2)<|box_end|>\nor\nTarget: None"
)


def request_text(
    text_query: Column,
    question_template: str = QUESTION_REQUEST,
    statement_template: str = STATEMENT_REQUEST,
) -> Column:
    """Request for a sentence, by its kind."""
    template = F.when(is_question(text_query), F.lit(question_template)).otherwise(F.lit(statement_template))
    return F.replace(template, F.lit("{query}"), text_query)


def request_messages(text_query: Column, image_base64: Column, mime: Column, **templates: str) -> Column:
    """One user message with an inline image and the request, as a JSON array."""
    url = F.concat(F.lit("data:"), mime, F.lit(";base64,"), image_base64)
    null_text = F.lit(None).cast("string")
    image = F.struct(
        F.lit("image_url").alias("type"),
        F.struct(url.alias("url")).alias("image_url"),
        null_text.alias("text"),
    )
    text = F.struct(
        F.lit("text").alias("type"),
        F.lit(None).cast("struct<url:string>").alias("image_url"),
        request_text(text_query, **templates).alias("text"),
    )
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.array(image, text).alias("content"))))
