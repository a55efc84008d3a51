"""The subpackage's queries over empty tables and over tables with nulls, repeated rows and clashing extra columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from edge_tables import SF, make

from lorespark.llm import queries as q

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def tables(request, spark, tmp_path_factory):
    return make(spark, str(tmp_path_factory.mktemp("edges")), request.param)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_no_crash(spark, tables, name):
    rows = q.QUERIES[name](spark, tables).collect()
    if tables.endswith("empty"):
        assert rows == []
