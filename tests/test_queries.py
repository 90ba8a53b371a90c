"""Every query with SQL against DuckDB; all others run."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Those of the training-data operators that have no SQL are tested beside them.
NAMES = [n for n in QUERIES if n in SQL or not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    return format(x + 0.0, ".8g") if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert got
    if name in SQL:
        rel = duck.execute(SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        want = sorted([plain(r[names.index(c)]) for c in columns] for r in rel.fetchall())
        assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(SQL) <= set(QUERIES)
