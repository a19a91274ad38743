"""The queries over the smallest tables: beside their SQL, or with what must hold of their rows."""

import oracle
import pytest

from quillstream.llm import queries as q

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    assert oracle.compare(QUERIES[name](spark, small), oracle.duck(small), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert rows and len(set(map(str, rows))) == len(rows)


def test_columns(spark, small):
    want = {"p1_found": ["unit_id_a", "unit_id_b"], "p2_found": ["group_image", "image"], "p3_found": ["unit_id", "concept_raw", "cid"], "p4_found": ["entry_id", "slide_id"], "p5_found": ["file_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    for name, cols in want.items():
        assert QUERIES[name](spark, small).columns == cols
