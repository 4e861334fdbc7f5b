"""The as-of join against all pairs, with ties, nulls, strictness, tolerance and a hot key in many slices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakepress.operators import asof


def brute(left, right, strict, within):
    out = []
    for i, k, t in left:
        fits = [(s, x) for q, s, x in right if k is not None and t is not None and q == k and s is not None and (s < t if strict else s <= t)]
        best = max(fits, key=lambda f: (f[0], (f[1] is not None, f[1] or 0)), default=(None, None))
        out.append((i, k, t, *(best if best[0] is None or within is None or t - best[0] <= within else (None, None))))
    return sorted(map(repr, out))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("within", [None, 5])
@pytest.mark.parametrize("size", [10, 1_000_000])
def test_asof_against_all_pairs(spark, monkeypatch, strict, within, size):
    monkeypatch.setattr(asof, "SLICE", size)
    r = random.Random(3)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), r.choice([None, 40, *range(0, 300)])) for i in range(400)] + [(1000 + i, "hot", 77) for i in range(50)] + [(5, "none", 9)]
    right = [(key(), r.choice([None, *range(20, 280, 3)]), r.choice([None, 1, 2, 3])) for _ in range(200)] + [("far", 1, 1)]
    a, b = spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, t int, x int")
    out = asof.asof_join(a, b, ["k"], "at", "t", ["x"], strict, (lambda s, t: s - t <= within) if within else None)
    assert sorted(repr(tuple(x)) for x in out.collect()) == brute(left, right, strict, within)


def test_asof_of_times_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(asof, "SLICE", 2)
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    a = spark.createDataFrame([(1, "x", "p", day(d)) for d in (1, 5, 9)] + [(2, "x", "q", day(9))], "k int, l string, o string, at timestamp")
    b = spark.createDataFrame([(1, "x", day(2), 2.0), (1, "x", day(9), 9.0), (1, "y", day(8), 8.0), (2, "x", day(3, 1), None)], "k int, l string, t timestamp, v double")
    rows = [tuple(r) for r in asof.asof_join(a, b, ["k", "l"], "at", "t", ["v"]).orderBy("k", "at").collect()]
    assert rows == [(1, "x", "p", day(1), None, None), (1, "x", "p", day(5), day(2), 2.0), (1, "x", "p", day(9), day(9), 9.0), (2, "x", "q", day(9), day(3, 1), None)]
    assert asof.asof_join(a.limit(0), b, ["k", "l"], "at", "t", ["v"]).count() == 0
    assert asof.asof_join(a, b.limit(0), ["k", "l"], "at", "t", ["v"]).where(F.col("t").isNull()).count() == 4
