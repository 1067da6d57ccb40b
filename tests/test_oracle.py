"""Every query of the library against its own SQL, run by DuckDB over the same tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quillgrid.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else (float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v).removesuffix(" 00:00:00"))
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=lambda r: [(v is None, isinstance(v, str), v if v is not None else 0) for v in r])


#: Likeness by matching blocks is no SQL; tests/test_retrieval.py holds it against a plain version.
WITHOUT_SQL = {"param_match"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == tuple(pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v for v in y)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) | WITHOUT_SQL
