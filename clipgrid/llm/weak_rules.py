"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at counts of one text and votes good (1) or bad (-1), or abstains (0). How far a rule can be trusted is
not set by hand: expectation-maximisation finds the accuracy of each rule and the share of good documents under which the
votes of the whole corpus are likeliest, and a document is kept if its posterior probability of being good is at least
one half. Documents enter the estimate as counts of vote patterns, of which there are at most 3 to the number of rules
whatever the corpus; one iteration is one aggregate over that table.

Texts are handled whole in their own row: repeated three-word windows are found by sorting their hashes, not by joins, so
neither a long text nor a hot source moves any row. A null text has no words; documents without words have every count
zero and fail the base rule. Repeated rows vote each for themselves. Columns to keep pass through; columns that this
module adds replace old ones of the same name, so keep those inside a struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.llm.common import WORD_GAP
from clipgrid.session import cut_lineage

ITERATIONS, START, LEAST = 12, 0.7, 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_shouts", "n_stops")
#: Rule: when it votes bad, and when it votes good; SQL that Spark and other engines read alike.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    "repeats": ("10 * n_repeat_words > 4 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    "duplicate_lines": ("10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    "distinct": ("100 * n_distinct < 5 * n_words", "10 * n_distinct >= 4 * n_words"),
    "shouts": ("5 * n_shouts > n_words", "100 * n_shouts <= n_words"),
    "length": ("n_words < 50", "n_words BETWEEN 50 AND 100000"),
    "sentences": ("200 * n_stops < n_words OR 2 * n_stops > n_words", "50 * n_stops >= n_words AND 3 * n_stops <= n_words"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _left(text: Column, pattern: str) -> Column:
    """Code points that stay when ``pattern`` is removed."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns COUNTS."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.drop(*COUNTS).withColumn("_words", F.array_remove(F.split(whole, WORD_GAP), ""))
    windows = F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0)))
    keys = F.transform(windows, lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    rows = rows.withColumn("_keys", keys)
    placed = F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    repeats = F.size(F.array_distinct("_keys")) < F.size("_keys")
    # Only texts with a repeated window sort theirs: equal hashes are then neighbours.
    rows = rows.withColumn("_sorted", F.when(repeats, F.sort_array(placed))).drop("_keys")
    again = F.transform(
        "_sorted",
        lambda x, j: F.when((F.get("_sorted", j - 1)["k"] == x["k"]) | (F.get("_sorted", j + 1)["k"] == x["k"]), x["i"]),
    )
    rows = rows.withColumn("_at", F.sort_array(F.filter(again, lambda i: i.isNotNull()))).drop("_sorted")
    covered = F.aggregate(
        F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(p - F.get("_at", j - 1), F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", lines)
    added = {
        "n_words": F.size("_words"),
        "word_chars": _left(whole, WORD_GAP),
        "n_symbols": _left(whole, r"[^#*$%&|<>]+"),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_distinct": F.size(F.array_distinct("_words")),
        "n_shouts": _left(whole, r"[^!]+"),
        "n_stops": _left(whole, r"[^.!?]+"),
    }
    return rows.withColumns({k: v.cast("long") for k, v in added.items()}).drop("_words", "_at", "_lines")


def votes(counted: DataFrame) -> DataFrame:
    """Adds ``vote_<rule>`` for every rule."""
    vote = {f"vote_{k}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for k, (bad, good) in RULES.items()}
    return counted.withColumns(vote)


def _posterior(bias: float, weights: dict[str, float]) -> Column:
    """Probability of good under independent rules: the votes add up in log odds."""
    odds = F.lit(bias)
    for rule, weight in weights.items():
        odds = odds + F.lit(weight) * F.col(f"vote_{rule}")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _logit(p: float) -> float:
    return math.log(p / (1.0 - p))


def estimate(voted: DataFrame, iterations: int = ITERATIONS) -> tuple[float, dict[str, float]]:
    """Log odds of good, and of being right for every rule."""
    columns = [f"vote_{k}" for k in RULES]
    patterns = cut_lineage(voted.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1))
    bias, weights = 0.0, dict.fromkeys(RULES, _logit(START))
    for _ in range(iterations):
        scored = patterns.withColumn("q", _posterior(bias, weights))
        right = [F.sum(F.when(F.col(c) > 0, F.col("q")).when(F.col(c) < 0, 1 - F.col("q")).otherwise(0.0) * F.col("n")).alias(f"r_{c}") for c in columns]
        cast = [F.sum(F.when(F.col(c) != 0, F.col("n")).otherwise(0.0)).alias(f"c_{c}") for c in columns]
        found = scored.agg(F.sum("n").alias("n"), F.sum(F.col("q") * F.col("n")).alias("good"), *right, *cast).first()
        if not found.n:
            break
        bias = _logit((found.good + 1.0) / (found.n + 2.0))
        weights = {k: _logit((found[f"r_vote_{k}"] + 1.0) / (found[f"c_vote_{k}"] + 2.0)) for k in RULES}
    return bias, weights


def judge(
    docs: DataFrame, keep: list[str], text: str = "text", least: float = LEAST, iterations: int = ITERATIONS
) -> DataFrame:
    """The columns ``keep`` with COUNTS, votes, ``quality`` (posterior), ``base_failed`` and ``kept``.

    Texts are counted once and the result is written, as the estimate and the verdict both read it.
    """
    voted = votes(cut_lineage(counts(docs, text).select(*keep, *COUNTS)))
    bias, weights = estimate(voted, iterations)
    judged = voted.withColumn("quality", F.round(_posterior(bias, weights), 6)).withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, quality and kept."""
    judged = judge(docs.select("doc_id", "text"), ["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"
    )


def verdicts_sql(iterations: int = ITERATIONS) -> str:
    """The same in DuckDB; one table expression per iteration."""
    cases = ",\n".join(f"    CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS vote_{k}" for k, (bad, good) in RULES.items())
    columns = ", ".join(f"vote_{k}" for k in RULES)
    start = _logit(START)
    steps = ["e0 AS (SELECT 0.0::DOUBLE AS bias, " + ", ".join(f"{start!r}::DOUBLE AS w_{k}" for k in RULES) + ")"]
    odds = "bias + " + " + ".join(f"w_{k} * vote_{k}" for k in RULES)
    for i in range(iterations):
        right = ", ".join(
            f"ln((sum(CASE WHEN vote_{k} > 0 THEN q WHEN vote_{k} < 0 THEN 1 - q ELSE 0 END * n) + 1)"
            f" / (sum(CASE WHEN vote_{k} <> 0 THEN n ELSE 0 END) - sum(CASE WHEN vote_{k} > 0 THEN q WHEN vote_{k} < 0 THEN 1 - q ELSE 0 END * n) + 1)) AS w_{k}"
            for k in RULES
        )
        steps.append(
            f"e{i + 1} AS MATERIALIZED (SELECT ln((sum(q * n) + 1) / (sum(n) - sum(q * n) + 1)) AS bias, {right}"
            f" FROM (SELECT p.*, 1 / (1 + exp(-({odds}))) AS q FROM patterns p, e{i}))"
        )
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, sum(step)::BIGINT AS n FROM (
  SELECT r, least(3, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 3)) AS step FROM again) GROUP BY r),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_distinct(words))::BIGINT AS n_distinct, length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_shouts,
    length(regexp_replace(text, '[^.!?]+', '', 'g'))::BIGINT AS n_stops
  FROM split s LEFT JOIN covered c ON s.r = c.r),
voted AS (SELECT *,
{cases}
  FROM counted),
patterns AS MATERIALIZED (SELECT {columns}, count(*)::DOUBLE AS n FROM voted GROUP BY {columns}),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
  round(1 / (1 + exp(-({odds}))), 6) AS quality,
  NOT ({BASE_FAILED}) AND round(1 / (1 + exp(-({odds}))), 6) >= {LEAST} AS kept
FROM voted, e{iterations}"""
