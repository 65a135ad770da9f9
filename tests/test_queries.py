"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    text, _, _, good = compare.compare(spark, connection, FOLDER, name, QUERIES[name], SQL.get(name))
    assert good, text


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["vid", "key_frame_idx", "num_sampled_frames", "max_similarity", "min_similarity", "mean_similarity"]
    assert result.count() > 0
