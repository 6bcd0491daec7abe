"""Operators' queries against their SQL."""

import pytest
from compare import same_rows

from tidemill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(name, spark, sf_dir, oracle):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), oracle(ORACLE_SQL[name]))
