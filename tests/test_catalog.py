"""Every query of the catalogue against its SQL, on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from prosemill.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    own = sorted(([plain(r[c]) for c in sorted(columns)] for r in df.collect()), key=str)
    assert own == sorted(([plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)] for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    rows = catalog.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == 200
    if name == "signature":
        assert {r["integrity_error"] for r in rows} == {None}
    if name == "scored_documents":
        assert {r["point_estimate"] for r in rows} == {r["mental_age"] for r in rows} == {None}


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
