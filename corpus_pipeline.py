"""A corpus pipeline of five stages: quality rules, near-duplicates, repeated passages, source mixture, tokens.

Each stage takes (spark, docs, sf_dir) and gives what the next one reads; all but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgrid.llm import byte_bpe, mixing, near_copies, simhash, suffix_dedup, weak_rules
from clipgrid.llm.common import table
from clipgrid.session import shared_folder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and that the rules together find good."""
    judged = weak_rules.judge(docs.select(F.struct(*docs.columns).alias("row")), ["row"], "row.text")
    return judged.where("kept").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: SimHash groups, and five-word Jaccard similarity of 0.8 or more between them."""
    return simhash.representatives(docs, near_copies.simhash_and_copies)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one or an earlier place holds."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*others).alias("row"))
    found = suffix_dedup.remove_repeats(rows, keep=["row"], whole_characters=True)
    text = F.col("kept").cast("string")
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; those without words bring nothing to it."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    taken = mixing.mix(rows, keep=("row",)).where("times > 0 AND size > 0")
    copies = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy"))
    return copies.select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether they decode to the text."""
    encoded = byte_bpe.encode(docs, ["doc_id", "source"], verify=True)
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("quality_rules", good_documents),
    ("simhash_near_duplicates", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("source_mixing", mixed_sources),
    ("byte_level_bpe", tokens),
]

#: Near-duplicate groups and suffix order are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
