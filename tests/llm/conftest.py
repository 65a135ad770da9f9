from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

@pytest.fixture
def documents(spark: SparkSession):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows: list[tuple], schema: str = DOCUMENTS) -> DataFrame:
        full = [(*r, *("en", "s")[len(r) - 2 :], len(r[1]) if r[1] else None)[:5] for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make
