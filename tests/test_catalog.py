"""Every query of the catalog against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def row(values):
    return tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, D), sql.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((row(r) for r in got.select(*(f"`{c}`" for c in want.columns)).collect()), key=repr)
    assert rows == sorted((row(r) for r in want.fetchall()), key=repr)
    assert rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert "win_rate" in out.columns
    assert out.count() == 3


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["extraction_status", "extraction_statuses", "preference_pairs"])
def test_null_and_empty_texts_against_sql(spark, tmp_path, name):
    c = duckdb.connect()
    text, n = "CASE WHEN doc_id % 7 = 1 THEN NULL WHEN doc_id % 7 = 2 THEN '' ELSE text END", "CASE WHEN doc_id % 7 IN (1, 2) THEN 0 ELSE n_chars END"
    c.sql(f"CREATE TABLE documents AS SELECT * REPLACE ({text} AS text, {n} AS n_chars) FROM '{D}/documents.parquet'")
    c.sql(f"COPY documents TO '{tmp_path}/documents.parquet'")
    want = c.sql(catalog.SQL[name])
    rows = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want.fetchall(), key=repr)
    assert rows
