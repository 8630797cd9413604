import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference, spark_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
CORE = [name for name, query in entry.queries().items() if not query.__module__.startswith("quirework.llm")]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, name):
    sql = entry.oracle_sql().get(name)
    if sql:
        assert difference(spark, FOLDER, name, entry.queries()[name], sql) == ""
    else:
        names, _ = spark_rows(entry.queries()[name](spark, FOLDER))
        assert names


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
