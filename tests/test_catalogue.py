"""Every query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lodestrata import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(frame, columns):
    def text(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name]).df()
        columns = sorted(found.columns)
        assert columns == sorted(want.columns)
        assert rows(found, columns) == rows(want, columns)
    else:
        assert len(found)
