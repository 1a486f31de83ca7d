"""Every registered query against its SQL oracle."""

import math
import os

import duckdb
import pytest

from siftwork.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return int(v) if v == math.floor(v) else round(v, 9)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return int(v) if hasattr(v, "__int__") else v


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = sorted((tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
    return len(got)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, sf, name):
    compare(spark, con, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry_points_agree(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
