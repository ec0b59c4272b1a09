"""Every catalogue query against its SQL at sf0.001."""

import math
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows of plain Python values, columns by name: null, str or, for any kind of number, float."""
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        rows.append(tuple(None if pd.isna(x) else float(x) if isinstance(x, numbers.Real) and not isinstance(x, (bool, np.bool_)) else str(x) for x in row))
    return sorted(rows, key=lambda row: [str(round(x, 3) + 0.0) if isinstance(x, float) else str(x) for x in row])


def alike(x: float | str | None, y: float | str | None) -> bool:
    """Equal, doubles but for what rounding to six places in both engines leaves."""
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    found = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.SQL:
        assert len(found) > 0
        return
    want = con.execute(catalogue.SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert len(found) == len(want)
    assert [pair for pair in zip(plain(found), plain(want), strict=True) if not all(map(alike, *pair))] == []
