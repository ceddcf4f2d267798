"""Every registered graph query that has SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from graphloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    want = duck.sql(plans.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(plans.queries()) <= set(e.queries())


@pytest.mark.parametrize("name", ["mut_add_obs_whole", "mut_upsert_obs_whole", "mut_edit_obs_whole", "mut_merge_observations_whole", "get_entity_observations_whole"])
def test_whole_tables_hold_documents(spark, duck, name):
    documents = plans.queries()[name](spark, SF).filter("entity_id >= 6000000000 AND entity_id < 7000000000")
    assert documents.count() == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
