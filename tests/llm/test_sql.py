import glob
import os
from collections import Counter

import duckdb
import pytest

from strataflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    r = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(row[c] for c in columns) for row in df.collect()) == Counter(r.fetchall())


def test_names():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))
