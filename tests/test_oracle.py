"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from tests import harness

SF_DIR = "/root/testdata/sf0.001"
KEYS = list(entry_module.queries())


@pytest.fixture(scope="module")
def duck():
    return harness.connect(SF_DIR)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")
@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, duck, key):
    result = entry_module.queries()[key](spark, SF_DIR)
    sql = entry_module.oracle_sql().get(key)
    if sql is None:
        assert result.count() > 0
    else:
        assert harness.difference(result, duck, sql) is None
