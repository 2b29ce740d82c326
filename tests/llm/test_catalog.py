"""Every corpus query with an SQL form gives the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

from orderloom.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    folder = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/**' if os.path.isdir(path) else path}')")
    df = catalog.queries()[name](spark, folder)
    columns = sorted(df.columns)
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in result.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want
