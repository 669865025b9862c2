"""The queries of the subpackage against their SQL, and their columns."""

import pytest

from oracle import duck_rows, spark_rows
from statuta.llm.queries import QUERIES

COLUMNS = {
    "p2_found": ["place", "concept_id", "instance_of_type", "nro", "ref_id"], "p3_found": ["nro", "field", "defect"], "p4_found": ["point_a", "point_b"],
    "p6_found": ["act_nro", "reconstruct_id"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    query, sql = QUERIES[name]
    df = query(spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if sql:
        assert spark_rows(df) == duck_rows(small, sql)
    else:
        df.collect()


def test_recall_of_the_search(spark, small):
    """Recall over the queries whose id is divisible by 20, against the exact search."""
    near = lambda name: {(r.point_id, r.near) for r in QUERIES[name][0](spark, small).where("point_id % 20 = 0").collect()}
    from statuta.llm import queries as q

    exact = {(r.point_id, r.near) for r in q._nearest(spark, small, 1.0).where("point_id % 20 = 0").collect()}
    assert len(near("p4_nearest") & exact) >= 0.95 * len(exact)
