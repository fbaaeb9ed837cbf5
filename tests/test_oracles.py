"""Every query over the driver tables against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from conftest import SF

from quarrygraph.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(df):
    """Columns by name and rows as sorted text, floats rounded."""
    df = df[sorted(df.columns)]
    show = lambda x: "None" if x is None or x != x else repr(round(float(x), 6)) if isinstance(x, float) else str(x)
    return list(df.columns), sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(con.execute(ORACLES[name]).df())
