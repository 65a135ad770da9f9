"""Which of several columns a row should use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipgrid.functions.names import strip


def read_frame(original_frame_idx: Column, key_frame_idx: Column) -> Column:
    """Index of the frame in its source: the original index, else the sampled one."""
    return F.coalesce(original_frame_idx, key_frame_idx)


def prompt(answer: Column, target_object: Column, text_query: Column) -> Column:
    """Answer, else target, else the query; empty text counts as missing."""
    return F.coalesce(F.nullif(answer, F.lit("")), F.nullif(target_object, F.lit("")), text_query)


def prompt_by_type(
    sentence_type: Column,
    target_object: Column,
    answer: Column,
    text_query: Column,
    target_types: tuple[str, ...] = ("declarative",),
    override: Column | None = None,
) -> Column:
    """Target for the types in ``target_types``, answer for the others, each falling back to the query.

    A non-blank override wins.
    """
    chosen = F.when(
        sentence_type.isin(*target_types), F.coalesce(target_object, text_query)
    ).otherwise(F.coalesce(answer, text_query))
    if override is None:
        return chosen
    return F.coalesce(F.nullif(strip(override), F.lit("")), chosen)


def binarise_float(value: Column) -> Column:
    return value > 0.5


def binarise_int(value: Column, largest: Column) -> Column:
    """Foreground of an integer mask: values above 0, or above 127 when the mask holds more than 0 and 1."""
    return F.when(largest > 1, value > 127).otherwise(value > 0)
