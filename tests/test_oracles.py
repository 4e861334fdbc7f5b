"""Every query with an oracle gives its rows at the smallest scale."""

import datetime
import os
import re
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from lakepress.plans import catalog
from lakepress.plans.domain import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.10g}") + 0.0 if v == v else "nan"
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(names, table):
    return sorted(repr([plain(r[i]) for i in sorted(range(len(names)), key=lambda i: names[i])]) for r in table)


def compare(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    ours = rows(df.columns, df.collect())
    if name not in catalog.ORACLES:
        return None
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {df.columns} and {names}"
    return None if ours == rows(names, r.fetchall()) else f"{name}: other rows"


def test_queries_match_their_oracles(spark):
    with ThreadPoolExecutor(4) as pool:
        wrong = [x for x in pool.map(lambda n: compare(spark, n), catalog.QUERIES) if x]
    assert not wrong


def test_names_are_those_of_identifiers():
    assert all(re.fullmatch(r"[A-Za-z0-9_]+", n) for n in catalog.QUERIES)
    assert len(catalog.ORACLES) > 0.9 * len(catalog.QUERIES)
