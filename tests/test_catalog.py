from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from loamline.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the shared tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = catalog.QUERIES[name](spark, str(DATA))
    wanted = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in wanted.fetchall()), key=str)


def test_entry_registers_the_library():
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
