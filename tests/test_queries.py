"""Each query against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from clamorframe.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    out = frame[sorted(frame.columns)]
    return sorted(tuple(str(float(x)) if isinstance(x, (int, float)) else str(x) for x in r) for r in out.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert len(want) and rows(got) == rows(want)
