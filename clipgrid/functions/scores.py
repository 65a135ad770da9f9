"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Inner product of two numeric arrays, summed left to right in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def match_probability(no_match: Column, match: Column) -> Column:
    """Second entry of the softmax over two logits; no overflow for large ones."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no_match - match))


def match_score(no_match: Column, match: Column, image_logit: Column | None = None) -> Column:
    """Match probability, else the plain image logit, else one half."""
    fallbacks = [match_probability(no_match, match)]
    if image_logit is not None:
        fallbacks.append(image_logit)
    return F.coalesce(*fallbacks, F.lit(0.5))


def clean_score(score: Column) -> Column:
    """NaN becomes 0, +inf becomes 1 and -inf becomes 0."""
    infinity = F.lit(float("inf"))
    return F.when(F.isnan(score), F.lit(0.0)).when(score == infinity, F.lit(1.0)).when(
        score == -infinity, F.lit(0.0)
    ).otherwise(score)


def round_half_up(value: Column, places: int) -> Column:
    """A double that is not negative, rounded in doubles as SQL engines do; ``F.round`` makes a decimal of every value.

    Twice the scaled value is exact, so a half goes up if and only if the scaled value is one.
    """
    scale = 10.0**places
    return F.shiftright(F.floor(value * (2 * scale)) + 1, 1) / F.lit(scale)


def sample_time(sample_idx: Column, fps: Column) -> Column:
    """Seconds from the start of the clip."""
    return F.try_divide(sample_idx, fps)


def confidence(box_similarity: Column, mask_similarity: Column) -> Column:
    return F.coalesce(box_similarity, mask_similarity).cast("double")
