"""Every registered query against its SQL twin on the smallest tables.

A spread of queries by default; ``SIGNALMILL_PARITY=all`` runs the whole registry.
"""

import datetime
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from signalmill.plans.all_queries import QUERIES, SQL, run  # noqa: E402

FOLDER = os.environ.get("SIGNALMILL_DATA", "/root/testdata/sf0.001")
EVERY = 1 if os.environ.get("SIGNALMILL_PARITY") == "all" else 9

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def order(row):
    return tuple((v is None, type(v).__name__, str(v) if isinstance(v, tuple) else v) if v is not None else (True, "", "") for v in row)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES)[::EVERY])
def test_query(spark, database, name):
    df = run(name, spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    if name not in SQL:
        return
    rel = database.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=order)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.queries()) >= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert isinstance(__spark_entry__.entry(spark).collect(), list)
