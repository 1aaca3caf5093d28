"""Every registered query against its SQL, on the smallest tables that have rows for all of them."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidegauge.plans import queries as engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    with duckdb.connect() as con:
        for path in Path(DATA).glob("*.parquet"):
            con.execute(f"create view {path.stem} as select * from '{path}'")
        yield con


def tidy(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else value


def rows(frame):
    columns = sorted(frame.columns)
    found = [tuple(tidy(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return columns, sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query_equals_its_sql(spark, base, name):
    got = engine.queries()[name](spark, DATA).toPandas()
    want = base.execute(engine.oracle_sql()[name]).fetchdf()
    (have, a), (need, b) = rows(got), rows(want)
    assert have == need
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not different, f"{len(different)} of {len(a)} rows; first: {different[:2]}"
