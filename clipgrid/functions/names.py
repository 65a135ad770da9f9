"""Clip identifiers, table keys and file names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes spelled out, so that Unicode text is treated alike on every engine.
WORD = r"\p{L}\p{N}_"
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(text: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def words(text: Column) -> Column:
    """Split on runs of white space; blank text gives an empty array."""
    return F.array_remove(F.split(text, rf"[{SPACE}]+"), "")


def base_vid(vid: Column) -> Column:
    """Everything before the last underscore; the whole identifier if there is none."""
    return F.regexp_replace(vid, r"(?s)_[^_]*\z", "")


def clip_idx(vid: Column) -> Column:
    """Text after the last underscore (not always a number); null if there is none."""
    return F.when(vid.contains("_"), F.substring_index(vid, "_", -1))


def compose_vid(base: Column, idx: Column) -> Column:
    """``base_idx``; a null index leaves the base alone."""
    return F.concat_ws("_", base, idx.cast("string"))


def output_key(root: Column | str, subdir: Column | str, vid: Column) -> Column:
    """``root/subdir/base[/idx]``."""
    root = F.lit(root) if isinstance(root, str) else root
    subdir = F.lit(subdir) if isinstance(subdir, str) else subdir
    return F.concat_ws("/", root, subdir, base_vid(vid), clip_idx(vid))


def object_key(prompt: Column) -> Column:
    """Prompt as an object name: lower case, runs of other characters as one underscore, none at the ends."""
    cleaned = F.regexp_replace(strip(F.lower(prompt)), rf"[^{WORD}\-]", "_")
    return F.regexp_replace(F.regexp_replace(cleaned, "_+", "_"), r"^_+|_+\z", "")


def prompt_key(prompt: Column) -> Column:
    """Prompt as a folder name: other characters dropped, blanks as underscores, ``unknown`` when nothing is left."""
    kept = strip(F.regexp_replace(prompt, rf"[^{WORD}{SPACE}\-]", ""))
    key = F.replace(kept, F.lit(" "), F.lit("_"))
    return F.when(key == "", F.lit("unknown")).otherwise(key)


def mask_name(frame_idx: Column) -> Column:
    """``mask_00042.png``."""
    return F.format_string("mask_%05d.png", frame_idx.cast("long"))


def mask_index(name: Column) -> Column:
    """Frame index in a mask file name, null for any other name."""
    return F.regexp_extract(name, r"^mask_([0-9]+)\.png\z", 1).try_cast("long")


def file_stem(name: Column) -> Column:
    """File name without its last extension; leading dots do not start an extension."""
    stem = F.regexp_extract(name, r"(?s)^((?:.*/)?\.*[^./][^/]*)\.[^./]*\z", 1)
    return F.when(stem == "", name).otherwise(stem)


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(?s)(?:^|/)\.*[^./][^/]*(\.[^./]*)\z", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def canonical_key(alias: Column, known: Mapping[str, str]) -> Column:
    """Canonical dataset key of an alias; an unknown alias fails the job and lists the known keys.

    The alias table is job configuration, so it travels as a literal map and no join is planned.
    """
    if not known:
        raise ValueError("an alias table has at least one entry")
    pairs = [F.lit(v) for item in known.items() for v in item]
    expected = ", ".join(sorted(set(known.values())))
    found = F.try_element_at(F.create_map(*pairs), strip(F.coalesce(alias, F.lit(""))))
    message = F.concat(F.lit("unsupported dataset '"), F.coalesce(alias, F.lit("")), F.lit(f"'; expected {expected}"))
    return F.coalesce(found, F.raise_error(message).cast("string"))


def key_from_path(path: Column, rules: Mapping[str, str]) -> Column:
    """Value of the first rule, in the given order, whose text occurs in the path; else null."""
    result = F.lit(None).cast("string")
    for needle, value in reversed(list(rules.items())):
        result = F.when(path.contains(needle), F.lit(value)).otherwise(result)
    return result
