"""Plug-in scorers and propagators: user models behind one distributed contract."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import clipgrid
from clipgrid.functions.scores import confidence, dot, match_probability
from clipgrid.operators.skew import join_by_group
from clipgrid.operators.spans import union_runs
from clipgrid.schemas import GROUNDING_COLUMNS, RAW_GROUNDING
from clipgrid.session import cut_lineage

DEFAULT_REASON = "scorer_failed"

# Functions of this package travel to the workers with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(clipgrid)


@dataclass(frozen=True)
class Plugin:
    """A model behind functions.

    ``load()`` runs once per task and method, ``apply(model, rows)`` per Arrow batch, ``close(model)`` at the end.
    A scorer returns one row per input row with ``vid, success`` and any of the raw columns; a propagator yields
    frames of runs (``vid, frame_idx, y, x0, x1``), none if it cannot propagate.
    """

    apply: Callable[[Any, pd.DataFrame], pd.DataFrame | Iterable[pd.DataFrame]]
    load: Callable[[], Any] = lambda: None
    close: Callable[[Any], None] = lambda model: None


class Registry:
    """Named plug-ins."""

    def __init__(self, plugins: dict[str, Plugin] | None = None) -> None:
        self._plugins: dict[str, Plugin] = dict(plugins or {})

    def register(self, name: str, plugin: Plugin) -> None:
        self._plugins[name] = plugin

    def names(self) -> tuple[str, ...]:
        return tuple(sorted(self._plugins))

    def get(self, name: str) -> Plugin:
        if name not in self._plugins:
            raise ValueError(f"unknown method {name!r}; available: {', '.join(self.names())}")
        return self._plugins[name]

    def known(self, method: Column) -> Column:
        """True for known methods; an unknown one fails the job and lists the known ones."""
        message = F.concat(
            F.lit("unknown method "), F.coalesce(method, F.lit("null")), F.lit(f"; available: {', '.join(self.names())}")
        )
        return F.when(F.coalesce(method.isin(*self.names()), F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(message).cast("boolean")
        )

    def subset(self) -> dict[str, Plugin]:
        return dict(self._plugins)


_RAW_FIELDS = [f.name for f in RAW_GROUNDING.fields]


def _plain_text(frame: pd.DataFrame, columns: Iterable[str]) -> pd.DataFrame:
    """Text columns as plain objects with None, whatever string type the plug-in used."""
    for name in columns:
        frame[name] = frame[name].astype(object).where(frame[name].notna(), None)
    return frame


def _score_or_explain(plugin: Plugin, model: Any, rows: pd.DataFrame) -> pd.DataFrame:
    """Score a batch; if it fails, score its halves, so that in the end only the faulty rows become failures."""
    try:
        return plugin.apply(model, rows)
    except Exception as error:  # noqa: BLE001 - any model error becomes a failure row
        if len(rows) == 1:
            return pd.DataFrame({"vid": [rows["vid"].iloc[0]], "success": [False], "failure_reason": [str(error)]})
        middle = len(rows) // 2
        halves = [_score_or_explain(plugin, model, part) for part in (rows.iloc[:middle], rows.iloc[middle:])]
        return pd.concat(halves, ignore_index=True)


def run_scorers(
    records: DataFrame, registry: Registry, method: str = "method", partitions: int | None = None
) -> DataFrame:
    """Raw scorer output, one row per record, routed by the method named in the row.

    Scoring a record costs far more than moving it, so records are dealt evenly over ``partitions`` tasks (default:
    the session's shuffle partitions). One pass over the records; a task loads a model when it first meets its
    method and closes all at its end.
    """
    plugins = registry.subset()
    tasks = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, Any] = {}
        try:
            for batch in batches:
                for name, rows in batch.groupby(method, sort=False):
                    if name not in models:
                        models[name] = plugins[name].load()
                    out = _score_or_explain(plugins[name], models[name], rows).reindex(columns=_RAW_FIELDS)
                    # An absent box must be None: the struct column takes no NaN.
                    out["bbox"] = [box if isinstance(box, dict) else None for box in out["bbox"]]
                    yield _plain_text(out, ("vid", "failure_reason"))
        finally:
            for name, model in models.items():
                plugins[name].close(model)

    known = records.filter(registry.known(F.col(method)))
    return known.repartition(tasks).mapInPandas(score, RAW_GROUNDING)


def grounding_rows(
    records: DataFrame, raw: DataFrame, method: Column | str, default_reason: str = DEFAULT_REASON
) -> DataFrame:
    """The twelve-column grounding table from records and raw scorer output.

    A record without output, or without success, becomes a failure row with the stated or default reason.
    """
    label = F.lit(method) if isinstance(method, str) else method
    output = raw.select(
        "vid",
        F.coalesce("success", F.lit(False)).alias("_ok"),
        *[F.col(n).alias(f"_{n}") for n in _RAW_FIELDS if n not in ("vid", "success")],
    )
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    # The three figures kept beside the confidence.
    extras = F.create_map(
        F.lit("clip_box_similarity"),
        F.col("_box_similarity"),
        F.lit("clip_mask_similarity"),
        F.col("_mask_similarity"),
        F.lit("mask_coverage"),
        F.col("_mask_coverage"),
    )
    mask_path = F.col("mask_path") if "mask_path" in records.columns else F.lit(None).cast("string")
    null_text = F.lit(None).cast("string")
    no_extras = F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.DoubleType()))
    columns = {
        "vid": F.col("vid"),
        "text_query": F.col("text_query"),
        "target_object": F.col("target_object"),
        "method": label,
        "success": ok,
        "bbox": F.when(ok, F.col("_bbox")),
        "confidence": F.when(ok, confidence(F.col("_box_similarity"), F.col("_mask_similarity"))),
        "answer": null_text,
        "mask_path": F.when(ok, mask_path),
        "raw_output": null_text,
        "failure_reason": F.when(~ok, F.coalesce("_failure_reason", F.lit(default_reason))),
        "extras": F.when(ok, extras).otherwise(no_extras),
    }
    joined = records.join(output, "vid", "left")
    return joined.select(*[columns[name].alias(name) for name in GROUNDING_COLUMNS])


RUNS = T.StructType(
    [
        T.StructField("vid", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("y", T.LongType()),
        T.StructField("x0", T.LongType()),
        T.StructField("x1", T.LongType()),
    ]
)


def run_propagators(
    inputs: DataFrame, registry: Registry, backend: str = "backend", partitions: int | None = None
) -> DataFrame:
    """Runs of the propagated masks, computed by ``partitions`` tasks (default: the session's shuffle partitions).

    An input row is a clip or, for long clips, one chunk of it, so a single clip can be spread over many tasks. A
    propagator yields its frames piece by piece and nothing gathers a clip.
    """
    plugins = registry.subset()

    def propagate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, Any] = {}
        try:
            for batch in batches:
                for name, rows in batch.groupby(backend, sort=False):
                    if name not in models:
                        models[name] = plugins[name].load()
                    for i in range(len(rows)):
                        out = plugins[name].apply(models[name], rows.iloc[[i]])
                        for part in [out] if isinstance(out, pd.DataFrame) else out:
                            yield _plain_text(part.reindex(columns=[f.name for f in RUNS.fields]), ("vid",))
        finally:
            for name, model in models.items():
                plugins[name].close(model)

    tasks = partitions or int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = inputs.filter(registry.known(F.col(backend)))
    return known.repartition(tasks).mapInPandas(propagate, RUNS)


#: Leads a propagator (a function of one input row) over all chunks of a clip, from the row of its first chunk.
Walk = Callable[[Callable[[pd.DataFrame], Any], pd.DataFrame], Iterable[pd.DataFrame]]


def chunk_propagator(registry: Registry, backend: str, boxes: DataFrame | None = None, partitions: int | None = None):
    """A registered propagator as the function that chunks are propagated with.

    Its input row is a chunk (``vid, chunk_id, chunk_start, chunk_end, prompt_idx, height, width``) with ``prompt``, the
    runs of the prompt mask, and the columns of ``boxes`` for its ``vid``. A row with an empty run (``x1 <= x0``, or
    none) stands for a frame without foreground. The runs are written once, as frames and masks are made from them.

    ``along`` of the result has a clip walk through its chunks inside one task, so that no job is needed per chunk.
    """
    registry.get(backend)

    def inputs(chunks: DataFrame, frames: DataFrame, spans: DataFrame) -> DataFrame:
        # One mask per chunk, so the list is bounded by an image.
        prompts = spans.groupBy("vid").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("prompt"))
        size = frames.select("vid", "height", "width")
        rows = chunks.join(size, "vid").join(prompts, "vid", "left").withColumn("backend", F.lit(backend))
        return rows if boxes is None else rows.join(boxes, "vid", "left")

    def propagate(chunks: DataFrame, frames: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
        runs = cut_lineage(run_propagators(inputs(chunks, frames, spans), registry, partitions=partitions))
        made = runs.select("vid", "frame_idx").distinct().join(frames.select("vid", "height", "width"), "vid")
        return made, union_runs(runs.filter("x1 > x0"), ["vid", "frame_idx"])

    def along(walk: Walk, chunks: DataFrame, frames: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All chunks of a clip one after another in one task, which ``walk`` leads from the row of the first one."""
        plugin = registry.subset()[backend]
        walking = registry.subset() | {backend: Plugin(lambda model, row: walk(lambda at: plugin.apply(model, at), row), plugin.load, plugin.close)}
        rows = inputs(chunks, frames, spans)
        runs = cut_lineage(run_propagators(rows, Registry(walking), partitions=partitions))
        made = join_by_group(runs.select("vid", "frame_idx").distinct(), frames.select("vid", "height", "width"), ["vid"], ["frame_idx"])
        return made, runs.filter("x1 > x0")

    propagate.along = along
    return propagate


def similarity_scores(frames: DataFrame, queries: DataFrame, key: str = "vid", vector: str = "vector") -> DataFrame:
    """Built-in scorer without Python: inner product of frame and query vector as a match probability.

    ``queries`` has one ``query_vector`` per clip.
    """
    joined = join_by_group(frames, queries.select(key, "query_vector"), [key], ["sample_idx"])
    similarity = dot(F.col(vector), F.col("query_vector"))
    return joined.withColumn("similarity", similarity).withColumn(
        "score", match_probability(-F.col("similarity"), F.col("similarity"))
    )
