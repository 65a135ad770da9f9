"""Tube sets computed earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_tube_sets(clips: DataFrame, tube_sets: DataFrame, tube_frames: DataFrame | None = None) -> DataFrame:
    """Tube state of every clip: ``not_found``, ``zero`` or ``tubes``.

    A set belongs to a clip only if video, prompt and media path all match. Of several sets with the same three the one of the
    last run counts (column ``run``, if there is one), then that of the greatest ``set_id``. A set that claims tubes but has no
    mask counts as not found.
    """
    key = ["base_vid", "prompt", "video_path"]
    age = F.coalesce("run", F.lit(-1)) if "run" in tube_sets.columns else F.lit(-1)
    claim = F.struct("set_id", F.coalesce("num_tubes", F.lit(0)).alias("num_tubes"))
    last = tube_sets.groupBy(*key).agg(F.max_by(claim, F.struct(age.alias("age"), "set_id")).alias("_set"))
    sets = last.select(*key, "_set.*")
    if tube_frames is not None:  # before the clips, most of which may have no set
        have = tube_frames.groupBy("set_id").agg(F.lit(True).alias("_have"))
        sets = sets.join(have, "set_id", "left")
    joined = clips.join(sets, key, "left")
    state = F.when(F.col("num_tubes").isNull(), F.lit("not_found")).when(F.col("num_tubes") == 0, F.lit("zero"))
    if tube_frames is None:
        return joined.withColumn("tube_state", state.otherwise(F.lit("tubes")))
    found = state.when(F.col("_have"), F.lit("tubes")).otherwise(F.lit("not_found"))
    return joined.withColumn("tube_state", found).drop("_have")


def find_tube_set(tube_sets: DataFrame, object_name: str | None = None) -> DataFrame:
    """The tube set to use per video: the named object, or the first object, or the layout without objects."""
    if object_name is not None:
        return tube_sets.filter(F.col("object_name") == object_name)
    fields = [c for c in tube_sets.columns if c != "base_vid"]
    rank = F.struct(F.col("object_name").isNull(), F.coalesce("object_name", F.lit("")))
    first = tube_sets.groupBy("base_vid").agg(F.min_by(F.struct(*fields), rank).alias("_set"))
    return first.select("base_vid", "_set.*")
