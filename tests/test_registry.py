"""Every registered analysis query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from strandflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def said(i, v):
        if v is None:
            return ""
        if not isinstance(v, float):
            return str(v)
        return f"{v:.4e}" if columns[i] in registry._SMALL else str(round(v, 5))

    return sorted(tuple(said(i, r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(set(df.columns)) == len(df.columns)
    if name in registry.SQL:
        want = con.execute(registry.SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(want.fetchall(), columns)
