import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sondage.plans import catalog, evaluation, records

MODULES = (catalog, evaluation, records)
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return [plain(v) for v in value]
    if value is None or pd.isna(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float, np.number)) and not isinstance(value, (bool, np.bool_)) else str(value)


@pytest.mark.parametrize("name", SQL)
def test_query_agrees_with_its_sql(spark, sf, duck, name):
    found, wanted = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    key = sorted(found.columns)
    assert key == sorted(wanted.columns)
    rows = lambda df: sorted(repr([plain(v) for v in row]) for row in df[key].itertuples(index=False))
    assert rows(found) == rows(wanted)
