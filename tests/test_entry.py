"""The entry points, and all queries that have SQL, against that SQL."""

import pytest
from compare import same_rows

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_sql(name, spark, sf_dir, oracle):
    same_rows(entry.queries()[name](spark, sf_dir).toPandas(), oracle(entry.oracle_sql()[name]))
