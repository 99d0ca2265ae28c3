"""The found-queries have exactly the columns that the driver compares."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
FOUND = {
    "p1_found": [("id_a", "bigint"), ("id_b", "bigint")], "p2_found": [("id", "bigint")], "p3_found": [("id", "bigint"), ("line_no", "bigint")],
    "p4_found": [("id_a", "bigint"), ("id_b", "bigint")], "p5_found": [("id", "bigint")], "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p7_found": [("source", "string")], "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_columns(spark, name):
    from ragstone.llm.queries import llm_queries

    df = llm_queries()[name](spark, DATA)
    assert df.dtypes == FOUND[name]
    rows = df.collect()
    assert len(rows) == len(set(rows)) > 0
