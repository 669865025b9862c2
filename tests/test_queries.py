"""Every core query against its SQL on the smallest tables."""

import importlib
import os

import pytest

from oracle import duck_rows, spark_rows

CORE = {}
for _file in sorted(os.listdir(os.path.join(os.path.dirname(__file__), "../statuta/queries"))):
    _module = importlib.import_module(f"statuta.queries.{_file[:-3]}") if _file.endswith(".py") and not _file.startswith("_") else None
    CORE |= getattr(_module, "QUERIES", {})


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, small, name):
    query, sql = CORE[name]
    columns, rows = spark_rows(query(spark, small))
    assert sql, "a core query has SQL"
    expected_columns, expected = duck_rows(small, sql)
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark, small):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["qid", "nro", "title", "pos", "cite_id", "text", "act_rank"]
    assert set(CORE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
