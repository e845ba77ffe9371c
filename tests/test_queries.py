"""Every registered query against its SQL counterpart on the smallest tables."""

import glob
import math
import os

import pytest
from conftest import DATA, needs_data

from florilege.queries import registry

QUERIES, ORACLE = registry.collect()


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        import duckdb

        con = duckdb.connect()
        con.sql("set timezone='UTC'")
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        rel = con.sql(ORACLE[name])
        at = [rel.columns.index(c) for c in sorted(df.columns)]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
