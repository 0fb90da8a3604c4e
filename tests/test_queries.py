"""Every query with SQL gives the rows of that SQL; the others give rows."""

import os
from collections import Counter

import duckdb
import pytest

from evenkeel.plans import catalogue, catalogue2, catalogue3, catalogue4, catalogue5, catalogue6  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(str([plain(v) for v in r]) for r in df.select([f"`{c}`" for c in cols]).collect())
    if name in catalogue.SQL:
        rel = duck.execute(catalogue.SQL[name])
        names = [d[0] for d in rel.description]
        at = [names.index(c) for c in cols]
        assert sorted(names) == cols
        assert rows == Counter(str([plain(r[i]) for i in at]) for r in rel.fetchall())
    else:
        assert rows
