"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewright.plans.catalog import ORACLES, QUERIES

D = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return v if isinstance(v, (int, bool)) or v is None else str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{D}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(names)
        want = rows(names, found.fetchall())
        assert len(got) == len(want)
        assert got == want
