"""Every core query over empty tables and over tables with nulls, repeated rows and clashing extra columns."""

import os

import pytest
from edge_tables import SF, make

from lorespark.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def tables(request, spark, tmp_path_factory):
    return make(spark, str(tmp_path_factory.mktemp("edges")), request.param)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_no_crash(spark, tables, name):
    registry.queries()[name](spark, tables).collect()
