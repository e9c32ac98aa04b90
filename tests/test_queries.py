"""Every registered query against its SQL counterpart in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sparkreel.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows as text, columns by name, numbers to six decimals."""

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    ours = registry.QUERIES[name](spark, D).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(ours)
        return
    theirs = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
