import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from pacemark.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(rows, order):
    return sorted(
        repr(tuple(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in order)) for r in rows
    )


def test_every_query_has_its_sql():
    assert CATALOG.keys() <= oracle_sql().keys() and CATALOG.keys() <= queries().keys()


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cursor = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = plain(cursor.fetchall(), [names.index(c) for c in columns])
    got = plain(df.select(*columns).collect(), range(len(columns)))
    assert got == want
