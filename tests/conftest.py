"""Shared session and tables of the tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemill.session import local_session  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SMALL


@pytest.fixture(scope="session")
def oracle(sf_dir):
    """Rows of SQL over the test tables, as sorted text, with its column names."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        source = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return lambda sql: con.execute(sql).df()
