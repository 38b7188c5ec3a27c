import os
import sys
from pathlib import Path

import duckdb
import pytest
from helpers import rows_of

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from textloom.session import local_session

    return local_session(8, 4, "6g")


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same(spark, small, duck):
    """Checks that a query and its SQL agree in columns and rows."""

    def check(query, sql):
        got = query(spark, small)
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows_of(got.collect(), names) == rows_of([dict(zip(names, r, strict=True)) for r in want.fetchall()], names)

    return check
