import duckdb
import pytest

from lexiloom.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: repr(round(x, 6)) if isinstance(x, float) else str(x)
    return [columns[i] for i in order], sorted([cell(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    got = registry.queries()[name](spark, D)
    want = db.sql(registry.oracle_sql()[name])
    assert shown(got.columns, got.collect()) == shown(want.columns, want.fetchall())
