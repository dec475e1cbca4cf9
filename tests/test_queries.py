"""Each of the engine's own queries against its SQL at the smallest scale."""

import math

import duckdb
import pytest

from veilframe.plans import files, lists, parts, sessions  # noqa: F401
from veilframe.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in cols)) for r in got.collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
