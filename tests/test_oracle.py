"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from ravelin.plans import records, reports  # noqa: F401  (these register their queries in the catalogue)
from ravelin.plans.catalogue import ORACLE_SQL, QUERIES

DATA = os.environ.get("RAVELIN_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    order = sorted(got.columns)
    frame = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in frame.description]
    assert sorted(names) == order
    want = [tuple(plain(r[names.index(c)]) for c in order) for r in frame.fetchall()]
    have = [tuple(plain(r[c]) for c in order) for r in got.collect()]
    assert sorted(map(repr, have)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
