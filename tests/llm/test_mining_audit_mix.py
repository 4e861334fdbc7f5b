"""Hard negatives, the filter audit and the source mix against brute force, with odd rows and empty tables."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakepress.llm import filter_audit, hard_negatives, mixing

SCHEMA = "vec_id long, embedding array<double>, label int, vec string, cluster int"


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.hard_negatives(df, label, F.col("vec_id") % 10 == 0)
    return sorted(tuple(r) for r in out.collect())


def brute(rows):
    by_id = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        one = (label, [math.floor(256 * x) for x in v])
        by_id[i] = min(by_id.get(i, one), one, key=lambda r: r[0])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for a in (i for i in by_id if i % 10 == 0):
        label, v = by_id[a]
        scored = sorted((-dot(v, w), j, other) for j, (other, w) in by_id.items() if j != a)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            fits = [(n, j) for n, j, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(fits[:10])]
    return sorted(out)


def vectors(n, dim, labels, spread, seed=1):
    r = np.random.default_rng(seed)
    mids = r.normal(size=(labels, dim))
    return [(i, (mids[i % labels] + spread * r.normal(size=dim)).tolist(), i % labels if i % 11 else 3) for i in range(n)]


ODD = [
    (None, [1.0, 2.0], 1), (500, None, 1), (510, [1.0, 2.0], None), (520, [1.0, None], 1), (530, [float("nan"), 1.0], 1), (540, [float("inf"), 1.0], 1),
    (550, [], 2), (560, [0.5], 2), (570, [0.0, 0.0], 2), (580, [-1.0, -2.0], 5), (590, [1.0, 1.0, 1.0, 1.0], 77),
]


@pytest.mark.parametrize("spread", [0.05, 0.5, 5.0])
def test_hard_negatives_against_brute_force(spark, spread):
    rows = vectors(400, 6, 8, spread)
    got = mined(spark, rows)
    assert got and got == brute(rows)


def test_hard_negatives_of_odd_rows(spark):
    same = [(600 + i, [0.3, 0.3, 0.1, 0.9], 4 + i % 2) for i in range(60)]  # a vector that many rows share: ties
    rows = vectors(100, 4, 5, 0.4) + ODD + same + [(10, [1.0, 1.0, 1.0, 1.0], 9), same[0], same[0]]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, ODD[:6]) == []
    huge = [(i, [x * 1e9 for x in v], label) for i, v, label in vectors(40, 3, 3, 0.5)]  # beyond what floats add up exactly
    huge = [(i, [math.copysign(min(abs(x), 3e6) * 1.0, x) if k else x / 1e4 for k, x in enumerate(v)], label) for i, v, label in huge]
    assert mined(spark, huge) == brute(huge)
    assert all(abs(r[4]) <= 2**63 for r in mined(spark, [(i, [1e300, 1e300], i % 2) for i in range(0, 40, 10)]))


def test_hard_negatives_in_salts_tiles_and_small_lists(spark, monkeypatch):
    rows = vectors(300, 5, 6, 0.3) + [(1000 + i, [0.3] * 5, 4 + i % 2) for i in range(200)]
    monkeypatch.setattr(hard_negatives, "BUNDLE", 30)
    monkeypatch.setattr(hard_negatives, "TILE", 10)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 50)
    assert mined(spark, rows) == brute(rows)


def test_second_wave_skips_lists(spark):
    """Of vectors in tight clusters most lists are never visited after the first wave."""
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in vectors(3000, 8, 30, 0.01)], SCHEMA)
    lists = hard_negatives.Lists(hard_negatives.quantised(df.select("vec_id", F.col("label").cast("long").alias("label"), "embedding"), 8, 256), 8)
    a = lists.rows.where("vec_id % 100 = 0").toPandas()
    a = a.assign(low=[[-(2**63)]] * len(a), high=[[2**63 - 1]] * len(a))
    first = lists.known().visits(a.assign(least=[[-(2**63)]] * len(a)), 0)
    x = lists.rows.toPandas()
    found = hard_negatives.scores(hard_negatives.unpack(a["vec"]), hard_negatives.unpack(x["vec"]))
    kth = [[int(np.sort(row)[-5])] for row in found]
    second = lists.known().visits(a.assign(least=kth), 1)
    assert not (first & second).any() and second.mean() < 0.2
    at = x["cluster"].to_numpy()
    for i in range(len(a)):  # what is left out scores below the fifth
        left = ~(first[i] | second[i])[at]
        assert not left.any() or found[i][left].max() < kth[i][0]


LONG = " ".join(f"w{i}" for i in range(5000))
TEXTS = [None, "", "", " \n\t", "A B C", "$ one", LONG, LONG, "a " * 400, "a " * 400 + "Z" * 50, "Wort中 " * 201, "x" * 200_000, LONG + " & #", "ÉÉÉ t"]
DOCS = [(i, t, ("s", None, "", "t中")[i % 4]) for i, t in enumerate(TEXTS)] + [(None, "", "s"), (None, LONG, None), (6, LONG, "s"), (7, LONG, "s"), (20, "", "t中")]
LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (99, 1, 1)]


def documents(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "'x' AS part", "1 AS mask", "2 AS n", "3 AS size", "'c' AS cell", "4 AS target")


def audited():
    rows = []
    for i, t, source in DOCS:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in DOCS)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), copy)
        mark = lambda k, i=i: i is not None and any(x[0] == i and x[k] == 1 for x in LABELS)
        rows.append((source or "", dict(zip("ABCDE", fails, strict=True)), mark(1), mark(2)))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                failing = sum(r[1][f] for r in mine)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                left = [r for r in left if not r[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_against_brute_force(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    out = filter_audit.filter_audit(documents(spark), labels)
    assert out.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert [t for _, t in out.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert sorted(tuple(r) for r in out.collect()) == audited()
    assert filter_audit.filter_audit(documents(spark).limit(0), labels).count() == 0


def goals(sizes):
    """Targets by a plain loop; sizes by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def check_mix(spark, rows):
    got = mixing.mix(documents(spark, rows)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    target = goals(sizes)
    assert sorted((repr(r.doc_id), r.size, r.source_size, round(r.target, 6)) for r in got) == sorted((repr(i), count(t), sizes[s], round(target[s], 6)) for i, t, s in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    return got, sizes, target


def test_mix_of_odd_rows(spark):
    check_mix(spark, DOCS)
    assert mixing.mix(documents(spark, []).limit(0)).count() == 0
    assert [(r.taken, r.target) for r in mixing.mix(documents(spark, [(1, None, None), (2, "", "a")])).collect()] == [(0, 0.0)] * 2


def test_mix_meets_its_targets(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, "w " * (r.choice((1, 2, 3, 7, 30, 400)) if i % 3 else 5), r.choice(("a", "b", "b", "b", "c", "d", None, "\U0001f600", "￮"))) for i in range(1500)]
    got, sizes, target = check_mix(spark, rows)
    source = dict((i, s) for i, _, s in rows)
    for s in sizes:
        assert abs(sum(x.taken for x in got if source[x.doc_id] == s) - target[s]) <= 1, s
    monkeypatch.setattr(mixing, "GROUP", 10)  # many salted groups, and another way of the same rows
    again = mixing.mix(documents(spark, rows[::-1]).repartition(7)).collect()
    for s in sizes:
        assert abs(sum(x.taken for x in again if source[x.doc_id] == s) - target[s]) <= 1, s
    monkeypatch.undo()
    assert sorted(map(tuple, mixing.mix(documents(spark, rows[::-1]).repartition(7)).collect())) == sorted(map(tuple, got))


def test_multipliers_against_bisection(spark):
    r = random.Random(2)
    sizes = {f"s{k}": {r.randint(1, 5000): r.randint(1, 90) for _ in range(40)} for k in range(6)}
    want = {}
    goal_rows = []
    for k, (s, cells) in enumerate(sizes.items()):
        total, longest = sum(x * n for x, n in cells.items()), max(cells)
        target = total * (0.02, 0.5, 1.0, 1.3, 1.9, 1.999)[k]
        low, high = -40.0 * longest, float(longest)
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(2, math.exp(min(mid * x / longest, 1))) * x * n for x, n in cells.items()) < target else (low, mid)
        want[s] = mid
        goal_rows.append((s, target, total, longest))
    cells = spark.createDataFrame([(s, x, n) for s, c in sizes.items() for x, n in c.items()], "source_key string, size long, n long")
    got = mixing.multipliers(cells, spark.createDataFrame(goal_rows, "source_key string, target double, source_size long, longest long"))
    for x in got.collect():
        assert x.tilt == pytest.approx(want[x.source_key], rel=1e-4, abs=1e-6)
