import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import queries as own

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(own.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    result = con.execute(own.ORACLES[name])
    names = [c[0] for c in result.description]
    got = own.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    tidy = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert tidy(got.select(*names).collect()) == tidy(result.fetchall())
