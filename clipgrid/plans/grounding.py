"""From key frames to boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.functions.text import is_question, parse_replies
from clipgrid.operators.resume import limit_then_drop
from clipgrid.operators.scoring import DEFAULT_REASON, Registry, grounding_rows, run_scorers
from clipgrid.schemas import GROUNDING_COLUMNS
from clipgrid.sinks.tables import legacy_grounding_rows


def ground(
    records: DataFrame,
    registry: Registry,
    method: str,
    done: DataFrame | None = None,
    limit: int | None = None,
    force: bool = False,
    default_reason: str = DEFAULT_REASON,
) -> DataFrame:
    """Score the records that are left and give the grounding rows to write.

    Finished records are removed before the scorer, as a filter behind it would not spare any work.
    """
    registry.get(method)
    pending = records
    if done is not None:
        pending = limit_then_drop(records, limit, done, force)
    elif limit is not None:
        pending = limit_then_drop(records, limit, records.limit(0), True)
    raw = run_scorers(pending.withColumn("method", F.lit(method)), registry)
    return grounding_rows(pending, raw, method, default_reason)


def ground_from_replies(records: DataFrame, method: str, mode: str = "auto") -> DataFrame:
    """Grounding rows from model replies, for models that answer with a box in text.

    ``records`` has ``vid, text_query, target_object, reply, width, height``.
    """
    asked = records.withColumn("is_question", is_question(F.col("text_query")))
    parsed = parse_replies(asked, mode=mode).withColumns(
        {
            "method": F.lit(method),
            "confidence": F.lit(None).cast("double"),
            "mask_path": F.lit(None).cast("string"),
            "raw_output": F.col("reply"),
            "extras": F.lit(None).cast("map<string,double>"),
        }
    )
    return legacy_grounding_rows(parsed).select(*GROUNDING_COLUMNS)
