"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the wanted total in proportion to its weight, is clamped at a number of epochs of its own
size, and what it cannot take is shared among the others by weight until no source is above its clamp. The share per
source then becomes whole repetitions of every document and one more of a seeded part of them.

Sources are aggregated first, so a hot source is a row; each round of filling is one aggregate over that table.
The fractional part picks documents inside strata of about ``STRATUM`` documents of one source: by falling size, every
document at which ``fraction * rank + start`` passes a whole number. Such a pick misses the wanted words of a stratum by
less than its longest document, and the random starts of the strata cancel out. Nothing is drawn at run time: the strata,
starts and ties come from MD5 of the seed and the document, so reruns agree.

A null text has size zero; a null source is a source of its own, last in order; documents with equal ids are separate
rows with equal draws, ordered by text; all targets are zero where all sizes are. New columns replace old ones of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgrid.llm.common import WORD_GAP
from clipgrid.llm.ranks import global_rank
from clipgrid.session import cut_lineage

WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 7
#: Documents of one source that are picked from together, about.
STRATUM = 1024


def word_count(text: Column) -> Column:
    """Words between white space."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_GAP, " ")
    inner = F.trim(gaps)
    return F.when(inner == "", 0).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1).cast("long")


def weigh(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the given ones in turn, by code point of ``source`` with null last."""
    ranked = global_rank(sources, F.col("source").isNull(), F.coalesce(F.col("source"), F.lit("")), name="_rank")
    given = F.array(*(F.lit(float(w)) for w in weights))
    return ranked.withColumn("weight", F.element_at(given, (F.col("_rank") % len(weights) + 1).cast("int"))).drop("_rank")


def fill(sources: DataFrame, total: float, epochs: float = EPOCHS) -> DataFrame:
    """Adds ``target``. Needs ``weight`` and ``source_size``; ``total`` beyond all clamps leaves every source clamped."""
    cap = F.col("source_size") * F.lit(float(epochs))
    sources = sources.withColumn("_cap", cap).withColumn("_full", F.lit(False))
    level, last = None, -1
    while True:
        state = sources.agg(
            F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if("_full").alias("full"),
        ).first()
        if state.full == last or not state.weight:
            break
        last, left, weight = state.full, total - (state.taken or 0.0), state.weight
        level = F.lit(left) * F.col("weight") / F.lit(weight)
        sources = cut_lineage(sources.withColumn("_full", F.col("_full") | (level > F.col("_cap"))))
    target = F.col("_cap") if level is None else F.when(F.col("_full"), F.col("_cap")).otherwise(level)
    return sources.withColumn("target", target).drop("_cap", "_full")


def draw(*parts: Column | str) -> Column:
    """A number below 16**12 from MD5 of the parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, times (copies that the mix takes), taken (words), and ``keep``."""
    extra = [c for c in keep if c not in ("doc_id", "size", "source_size", "target", "times", "taken")]
    docs = docs.select(
        *dict.fromkeys(["doc_id", "source", *extra]),
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text"),
    )
    sizes = cut_lineage(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")))
    total = (sizes.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    sources = cut_lineage(fill(weigh(sizes, weights), total, epochs)).withColumnRenamed("source", "_source")
    rows = docs.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    strata = F.ceil(F.col("_docs") / STRATUM)
    rows = rows.withColumn("_times", times)
    rows = rows.withColumn("_stratum", draw(str(seed), F.col("doc_id"), F.col("_text")) % strata)
    group = Window.partitionBy("source", "_stratum")
    rank = F.row_number().over(group.orderBy(F.desc("size"), draw(str(seed), "order", F.col("doc_id")), "doc_id", "_text"))
    start = draw(str(seed), "start", F.coalesce(F.col("source"), F.lit("")), F.col("_stratum")) / F.lit(float(16**12))
    part = F.col("_times") - F.floor("_times")
    passed = F.floor(part * rank + start) - F.floor(part * (rank - 1) + start)
    copies = (F.floor("_times") + passed).cast("long")
    return rows.withColumn("times", copies).select(
        *dict.fromkeys(["doc_id", *extra]), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")
    )


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM docs GROUP BY source),
ordered AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    sum(source_size * 2.0::DOUBLE) OVER w - source_size * 2.0::DOUBLE AS below,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM sizes WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT total - below AS rest, weights FROM ordered WHERE (total - below) * weight / weights <= cap ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT o.source, o.source_size, o.n, CASE WHEN l.rest IS NULL OR l.rest * o.weight / l.weights > o.cap THEN o.cap ELSE l.rest * o.weight / l.weights END AS target
  FROM ordered o LEFT JOIN level l ON true),
strata AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS times,
    ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, '-') || ':' || text_md5), 1, 12))::BIGINT % ceil(t.n / 1024)::BIGINT AS stratum
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, times - floor(times) AS part,
    row_number() OVER (PARTITION BY source, stratum ORDER BY size DESC, ('0x' || substr(md5('7:order:' || coalesce(doc_id::VARCHAR, '-')), 1, 12))::BIGINT, doc_id, text_md5) AS rank,
    ('0x' || substr(md5('7:start:' || coalesce(source, '') || ':' || stratum), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS start
  FROM strata)
SELECT doc_id, size, source_size, target,
  ((floor(times) + floor(part * rank + start) - floor(part * (rank - 1) + start)) * size)::BIGINT AS taken
FROM ranked"""
