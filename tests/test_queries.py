"""Every registered query against its SQL."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from __spark_entry__ import entry  # noqa: E402
from doctables.registry.entries import QUERIES  # noqa: E402
from doctables.registry.oracle import ORACLE  # noqa: E402
from tools.check_queries import connect, differences  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, name, SF) is None


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns[:2] == ["file_path", "query_idx"] and rows.count() > 0
