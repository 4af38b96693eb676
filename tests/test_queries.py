"""Every registered query of the engine against its SQL on the small tables."""

import datetime
import math

import duckdb
import pytest

from sightline.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def _row(values):
    return tuple(("null",) if v is None else round(v, 9) if isinstance(v, float) and not math.isnan(v) else v.isoformat() if isinstance(v, datetime.date) else v for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((_row(r[c] for c in columns) for r in df.collect()), key=str)
    found = duck.sql(ORACLE_SQL[name])
    at = [found.columns.index(c) for c in columns]
    want = sorted((_row(r[i] for i in at) for r in found.fetchall()), key=str)
    assert sorted(found.columns) == columns
    assert got == want
