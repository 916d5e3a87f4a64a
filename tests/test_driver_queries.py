"""Every query with SQL gives what DuckDB does."""

import math
from decimal import Decimal

import duckdb
import pytest

from lexloom.plans import driver_queries as Q
from lexloom.plans import library_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 9)
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_equals_duckdb(spark, db, name):
    df = Q.queries()[name](spark, SF)
    cur = db.execute(Q.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted([tuple(_norm(r[cols.index(c)]) for c in order) for r in cur.fetchall()], key=str)
    got = sorted([tuple(_norm(r[c]) for c in order) for r in df.collect()], key=str)
    assert len(got) > 0 and got == want
