"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from texweave.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame.where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalog.ORACLES:
        want = sql.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
    else:
        assert len(got)
