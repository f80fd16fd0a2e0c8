"""One local session for all tests, and DuckDB over a small data directory."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from terrafacet.session import local_session

    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(columns, values):
    """Rows as sorted tuples of comparable text, columns by name."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Assert that a query and its oracle have the same rows."""

    def check(query, sql):
        mine = query(spark, sf_dir)
        theirs = duck.sql(sql)
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())

    return check
