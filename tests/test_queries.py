"""Every query with SQL equals what DuckDB makes of it on the same tables."""

import glob
import os

import duckdb
import pytest

from tagweave.plans import queries as _  # noqa: F401  registers
from tagweave.plans.base import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(pdf):
    def text(v):
        if v is None or v != v:
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(text(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        want = db.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
