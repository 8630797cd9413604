import os

import pytest

from quirework.llm.queries import QUERIES, SQL
from tests.compare import difference, spark_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
COLUMNS = {
    "p2_found": ["entry_id", "field_name"], "p3_found": ["entry_id_a", "entry_id_b"], "p4_found": ["copy_entry_id", "first_entry_id"],
    "p5_found": ["fault", "field_name", "row_id", "table_name"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    if name in SQL:
        assert difference(spark, FOLDER, name, QUERIES[name], SQL[name]) == ""
        return
    names, rows = spark_rows(QUERIES[name](spark, FOLDER))
    assert rows and names == COLUMNS.get(name, names)
    if name in COLUMNS:
        assert len(rows) == len(set(rows))
