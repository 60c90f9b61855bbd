"""Every registered query of the engine equals its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from tributary.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return None if x != x else round(x, 4) + 0.0
    return x


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    if isinstance(a, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    return abs(a - b) <= 2e-4 if isinstance(a, float) and isinstance(b, (int, float)) else a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    names, rows = table(df.columns, [tuple(r) for r in df.collect()])
    assert rows
    if name in ORACLE_SQL:
        found = con.execute(ORACLE_SQL[name])
        want_names, want = table([d[0] for d in found.description], found.fetchall())
        assert names == want_names and len(rows) == len(want)
        assert all(map(close, rows, want))
