"""Every query of the catalog against its SQL, and without SQL for a stable schema."""

import math

import duckdb
import pytest

from foliant.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    held = duckdb.connect()
    for t in TABLES:
        held.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return held


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(repr(value(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalog.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    assert df.columns
    df.collect()
