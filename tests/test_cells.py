"""Joins in cells against brute force, with chunks of a few rows, and what they write of many copies."""

import math
import random

import numpy as np
import pytest

from lakepress.functions import cells, similarity
from lakepress.operators import crowd, dedup, threads
from lakepress.operators.graph import connected_components


def grams(s):
    return {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def texts(seed, n):
    """Texts of syllables of one and of two alphabets, of many lengths, with near and exact copies."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = ["".join(rng.choice(["an", "er", "th", "ou", "де", "на"][(i % 2) * 2 : 4 + (i % 2) * 2]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 25))]
        out.append(rng.choice(out) if out and rng.random() < 0.2 else " ".join(words))
        if rng.random() < 0.3:
            out[-1] = rng.choice(out) + " x" + str(i % 4)
    return out


def written(spark, name):
    """Rows of the tables of this name that were written to the shared folder."""
    top = f"{spark.conf.get('spark.checkpoint.dir')}/lakepress"
    try:
        return spark.read.parquet(f"{top}/{name}-*").count()
    except Exception as e:  # none was
        assert "PATH_NOT_FOUND" in str(e)
        return 0


def groups(nodes, links):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {n: root(n) for n in nodes}


def component_of(spark, nodes, links):
    found = {r.node: r.component for r in connected_components(links.toDF("u", "v")).collect()}
    return {n: found.get(n, n) for n in nodes}


def test_reprints_of_many_copies_write_no_pairs(spark):
    rng = random.Random(3)
    kinds = ["a minister came to the town", "a minister came to the town x1", "quite another story of the day"]
    rows = [(i, rng.choice(kinds), rng.randrange(20) * 40000, "c") for i in range(3000)]
    df = spark.createDataFrame(rows, "article_id long, title string, at_s long, country_code string")
    before = written(spark, "pairs") + written(spark, "state")
    got = {r.article_id: (r.parent_id, r.sim) for r in dedup.best_parent(df).collect()}
    assert written(spark, "pairs") + written(spark, "state") == before
    roots, want = [], {}
    for i, title, at, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        near = [(-jaccard(grams(title), grams(t)), k) for k, t, s in roots if at - s <= 172800]
        best = min([x for x in near if -x[0] > 0.85], default=None)
        if best:
            want[i] = (best[1], -best[0])
        else:
            roots.append((i, title, at))
    assert got == want and len(roots) > 6


@pytest.mark.parametrize("above", [0.25, 0.5, 0.6, 0.85])
def test_trigram_join_in_small_chunks_equals_all_pairs(spark, monkeypatch, above):
    monkeypatch.setattr(cells, "CELL", 17)
    monkeypatch.setattr(similarity, "PART", 2)
    rows = [(i, t, [None, "a", "b"][i % 3], i % 5) for i, t in enumerate(texts(8, 150))]
    df = spark.createDataFrame(rows, "id long, t string, part string, s long")
    got = similarity.trigram_join(df, "id", "t", above, ["part"], similarity.F.col("a.s") <= similarity.F.col("b.s"), ["s"])
    want = {(a[0], b[0]): jaccard(grams(a[1]), grams(b[1])) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and a[3] <= b[3]}
    want = {k: v for k, v in want.items() if v > above}
    got = [(r.id_1, r.id_2, r.sim) for r in got.collect()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items()) and len(got) > 5


def unit(seed, n, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    return [[c + rng.gauss(0, 0.35) for c in centres[i % 7]] for i in range(n)]


def cos(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


def test_cosine_join_in_small_chunks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 13)
    rows = [(i, i % 3, v) for i, v in enumerate(unit(4, 90))] + [(90, None, [1.0] * 6), (91, 0, None), (92, 0, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, part long, v array<double>")
    full = [r for r in rows[:90]]
    for above in (0.25, 0.8):
        out = similarity.cosine_join(df, "id", "v", above, ["part"])
        assert "aggregate(" not in out._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroups")[0]  # pairs are not compared row by row
        got = sorted((r.id_1, r.id_2, round(r.cos, 9)) for r in out.collect())
        assert got == sorted((a[0], b[0], round(cos(a[2], b[2]), 9)) for a in full for b in full if a[0] < b[0] and a[1] == b[1] and cos(a[2], b[2]) > above)
        assert "FlatMapCoGroups" in out._jdf.queryExecution().executedPlan().toString()


def test_retrospective_of_many_copies_writes_no_pairs_of_copies(spark):
    kinds = ["one two three four five six seven", "two three four five six seven eight", "three four five six seven eight nine", "apart from all of these"]
    rows = [(i, kinds[(i * 7 + i // 9) % 4], (i * 37) % 400, "c") for i in range(800)]
    df = spark.createDataFrame(rows, "article_id long, title string, at_s long, country_code string")
    before = written(spark, "pairs")
    got = {r.article_id: r.parent_id for r in dedup.retrospective(df, above=0.6).collect()}
    assert written(spark, "pairs") - before <= 3
    roots, want = [], {}
    for i, title, at, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        found = [k for k, t in roots if jaccard(grams(title), grams(t)) > 0.6]
        if found:
            want[i] = found[0]
        else:
            roots.append((i, title))
    assert got == want and len(roots) > 1


def test_retrospective_names_classes_by_their_first_article(spark):
    rows = [(1, "one two three four", 9), (2, "One two three four", 3), (3, "one two, three four", 3), (4, "one two three four five", 1), (5, "apart from all", 2), (6, "Apart from all", None)]
    df = spark.createDataFrame(rows, "article_id long, title string, at_s long").withColumn("country_code", similarity.F.lit("c"))
    before = written(spark, "firsts")
    assert {(r.article_id, r.parent_id) for r in dedup.retrospective(df, above=0.6).collect()} == {(1, 4), (2, 4), (3, 4), (5, 6)}
    assert {(r.article_id, r.parent_id) for r in dedup.retrospective(df).collect()} == {(1, 2), (3, 2), (5, 6)}
    assert written(spark, "firsts") == before


def test_words_are_made_once_and_rows_without_trigrams_are_in_no_class(spark, monkeypatch):
    plans, plain = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), plain(df, name))[1])
    rows = [(1, "one two three four"), (2, ""), (3, None), (4, " ?! "), (5, "one"), (6, "One, two three four"), (7, "__ __ __ __ __ __")]
    df = spark.createDataFrame(rows, "article_id long, title string").withColumn("at_s", similarity.F.lit(1)).withColumn("c", similarity.F.lit("c"))
    members, classes = similarity.trigram_classes(dedup._titled(df, 10), "article_id", "title", ["c"])
    assert sorted((r.article_id, r.rep) for r in members.collect()) == [(1, 1), (6, 1)] and [(r.rep, r.many) for r in classes.collect()] == [(1, 2)]
    assert [name for name, _ in plans] == ["sets", "classes"] and "Filter" not in plans[0][1]


def test_cosine_join_without_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 20)
    rows = list(enumerate(unit(9, 100)))
    out = similarity.cosine_join(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.71)
    assert "FlatMapCoGroups" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.id_1, r.id_2) for r in out.collect()} == {(a, b) for a, x in rows for b, y in rows if a < b and cos(x, y) > 0.71}


def test_copies_are_compared_as_one(spark):
    rows = [(i, ["a minister came to the town", "a minister went to the town", "Talks!"][i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t string")
    before = written(spark, "class-pairs")
    assert similarity.trigram_join(df, "id", "t", 0.6).count() == 3 * 200 * 199 // 2 + 200 * 200
    assert written(spark, "class-pairs") == before + 1


@pytest.mark.parametrize("within", [None, 0, 7, 40])
def test_title_pairs_meet_by_bins_of_time(spark, monkeypatch, within):
    monkeypatch.setattr(similarity, "PART", 5)
    kinds = ["one two three four five six seven", "One two three four five six seven!", "apart from all of these", "one two three four five six sevens", "one two three"]
    rows = [(i, kinds[(i * 7 + i // 9) % 5], None if i % 50 == 49 else (i * 37) % 100 - 30, "c") for i in range(200)]
    out = dedup.title_pairs(spark.createDataFrame(rows, "article_id long, title string, at_s long, country_code string"), 0.7, within)
    assert ("_bin" in out._jdf.queryExecution().optimizedPlan().toString()) == (within is not None)
    gram = {k: grams(k.replace("!", "").lower()) for k in kinds}
    near = lambda a, b: within is None or (a is not None and b is not None and abs(a - b) <= within)
    want = [(a[0], b[0], jaccard(gram[a[1]], gram[b[1]])) for a in rows for b in rows if a[0] < b[0] and near(a[2], b[2]) and jaccard(gram[a[1]], gram[b[1]]) > 0.7]
    assert sorted((r.id_1, r.id_2, r.sim) for r in out.collect()) == sorted(want) and len(want) > 5


def test_pairs_of_single_texts_are_not_looked_up(spark):
    rows = [(i, t) for i, t in enumerate(["a minister came to the town", "a minister came to the towns", "a minister came to town", "Talks!", "talks", "talks a"])]
    members, classes = similarity.trigram_classes(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    pairs = similarity.class_pairs(classes, 0.6)
    found = lambda m, extra=None: sorted((r.id_1, r.id_2) for r in similarity.expanded(m, classes, pairs, "id", extra).collect())
    assert found(members) == [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]
    assert found(members.limit(0)) == [(0, 1), (0, 2), (1, 2)]
    assert found(members.limit(0), similarity.F.lit(True)) == []


def test_audience_pairs_are_found_from_the_top(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 25)
    rows = [(i, t, "s", str(i % 2), i * 7919 % 900000, (i % 61 - 30) / 10) for i, t in enumerate(texts(12, 160))]
    df = spark.createDataFrame(rows, "article_id long, title string, source string, lang string, at_s long, sentiment double")
    want = [(jaccard(grams(a[1]), grams(b[1])), a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] != b[3] and abs(a[4] - b[4]) < 172800 and abs(a[5] - b[5]) >= 1]
    want = sorted((-round(s + 1e-9, 4), a, b) for s, a, b in want if s > 0.3)
    tried = []
    plain = crowd.class_pairs
    monkeypatch.setattr(crowd, "class_pairs", lambda c, above: (tried.append(above), plain(c, above))[1])
    for most in (3, 40, len(want) + 5):
        tried.clear()
        assert [(-r.sim, r.id_1, r.id_2) for r in crowd.audience_pairs(df, most=most).collect()] == want[:most]
        assert (0.3 in tried) == (-want[: most][-1][0] <= 0.6 or most > len(want))


def test_cosine_links_connect_what_all_pairs_do_and_are_few(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 40)
    rows = [(i, i % 2, v) for i, v in enumerate(unit(2, 300))]
    df = spark.createDataFrame(rows, "id long, part long, v array<double>")
    ids = range(300)
    links = similarity.cosine_links(df, "id", "v", 0.9, ["part"])
    sure = groups(ids, [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and cos(a[2], b[2]) >= 0.9])
    assert component_of(spark, ids, links) == sure and len(set(sure.values())) > 14
    parts = spark.createDataFrame(sorted(sure.items()), "id long, _part long")
    doubt = {(r.id_1, r.id_2) for r in similarity.cosine_between(df.join(parts, "id"), "id", "v", 0.7, ["part"]).collect()}
    assert doubt == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and sure[a[0]] != sure[b[0]] and cos(a[2], b[2]) > 0.7}
    near = spark.createDataFrame([(i, [1.0, i / 1e4]) for i in range(200)], "id long, v array<double>")
    assert similarity.cosine_links(near, "id", "v", 0.9).count() < 2000  # of 19900 pairs


def test_clusters_with_a_judge_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 30)
    rows = [(i, str(i % 2), None, v) for i, v in enumerate(unit(6, 150))]
    df = spark.createDataFrame(rows, "article_id long, country_code string, event_key string, embedding array<double>")
    got = {r.article_id: r.cluster for r in threads.cluster(df, auto=0.93, maybe=0.8, judge=lambda p: p.where("(id_1 + id_2) % 3 = 0")).collect()}
    pairs = [(a[0], b[0], cos(a[3], b[3])) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1]]
    assert got == groups(range(150), [(a, b) for a, b, c in pairs if c >= 0.93 or (c > 0.8 and (a + b) % 3 == 0)])


@pytest.mark.parametrize("above, cell", [(0.25, 11), (0.3, 60), (0.7, 23)])
def test_trigram_links_connect_what_all_pairs_do(spark, monkeypatch, above, cell):
    monkeypatch.setattr(cells, "CELL", cell)
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(dict.fromkeys(texts(5, 200)))] + [(900, "q", "a"), (901, "zz zz", "b")]
    _, classes = similarity.trigram_classes(spark.createDataFrame(rows, "id long, t string, part string"), "id", "t", ["part"])
    reps = {r.rep for r in classes.collect()}
    links = similarity.trigram_links(classes, above)
    want = groups(reps, [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and {a[0], b[0]} <= reps and a[2] == b[2] and jaccard(grams(a[1]), grams(b[1])) > above])
    assert component_of(spark, reps, links) == want and links.count() < 4000


def test_links_compare_few_rows_of_one_large_part_with_all(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 40)
    rng = random.Random(7)
    names = ["ant", "bee", "cat", "dog", "elk", "fox"]
    rows = [(i, " ".join([*rng.choices(names, k=4 * 2 ** (i % 4)), f"q{i}"])) for i in range(300)] + [(900, "zzz yyy")]
    _, classes = similarity.trigram_classes(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    met, plain = [], similarity.in_cells
    monkeypatch.setattr(similarity, "in_cells", lambda x, *a, **k: (met.append(x.count()), plain(x, *a, **k))[1])
    links = similarity.trigram_links(classes, 0.25)
    want = groups([r[0] for r in rows], [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and jaccard(grams(a[1]), grams(b[1])) > 0.25])
    assert component_of(spark, [r[0] for r in rows], links) == want
    assert len(met) == 1 and met[0] < 30  # of 301


def test_trigram_sets_equal_the_expression(spark):
    texts = ["Ab, c d!", "déjà vu", "", " . ", None, "\U00010400b \U00010428", "a a a", "x-1  Y_2\tz", "ИЖ é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("g", similarity.trigram_codes(similarity.F.col("t")))
    members, classes = similarity.trigram_classes(df, "id", "t", carry=["g"])
    got = {r.id: (r.g, list(r._g), r._n) for r in members.join(classes, "rep").collect()}
    assert sorted(got) == [0, 1, 5, 6, 7, 8] and all(g == h and n == len(h) for g, h, n in got.values())


@pytest.mark.parametrize("seed, above, split", [(1, 0.3, 0), (2, 0.4, 0), (3, 0.55, 0), (4, 0.4, 90), (5, 0.5, 40)])
def test_links_of_a_cell_in_small_batches_connect_all(monkeypatch, seed, above, split):
    monkeypatch.setattr(cells, "BATCH", 5)
    rng = random.Random(seed)
    sets = [sorted({i % 20 * 10 + rng.randrange(15) for _ in range(rng.randint(3, 25))}) for i in range(160)]
    rows = cells.pd.DataFrame({"id": [(i * 37) % 160 for i in range(160)], "_g": sets})
    got = cells.jaccard_links("id", above)(rows.iloc[: split or 160], rows.iloc[split or 160 :])
    ids = rows["id"].tolist()
    near = [(i, j) for i in range(160) for j in range(160) if i < j and (not split or i < split <= j) and jaccard(set(sets[i]), set(sets[j])) > above]
    want = groups(sorted(ids), [(ids[i], ids[j]) for i, j in near])
    assert groups(sorted(ids), zip(got["id_1"].tolist(), got["id_2"].tolist(), strict=True)) == want and 3 < len(set(want.values())) < 157


def test_cosine_join_leaves_out_pairs_of_one_language_in_the_cell(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 20)
    made, plain = [], similarity.cosine_cell
    rows = [(i, i % 3, v) for i, v in enumerate(unit(9, 100))]
    monkeypatch.setattr(similarity, "cosine_cell", lambda *a, **k: (made.append(plain(*a, **k)), made[-1])[1])
    out = similarity.cosine_join(spark.createDataFrame(rows, "id long, s long, v array<double>"), "id", "v", 0.71, apart=similarity.F.col("s"))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and cos(a[2], b[2]) > 0.71}
    assert {(r.id_1, r.id_2) for r in out.collect()} == want
    table = cells.pd.DataFrame([(i, p, np.array(v) / math.sqrt(sum(x * x for x in v))) for i, p, v in rows], columns=["id", "_part", "_u"])
    assert len(made[0](table, table.iloc[:0])) == len(want) > 5


def test_length_of_a_vector_is_not_made_once_for_each_component(spark):
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(unit(5, 20))], "id long, part long, v array<float>")
    out = similarity.unit_vectors(df, "id", "v", ["part"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "/ sqrt(" not in plan.lower() and plan.count("aggregate(") == 2
    for r in out.collect():
        assert abs(sum(x * x for x in r._u) - 1) < 1e-12


@pytest.mark.parametrize("copies", [1, 40])
def test_cosine_cell_in_tiles_equals_all_pairs(monkeypatch, copies):
    monkeypatch.setattr(cells, "TILE", 7)
    vectors = [v for v in unit(6, 60 // copies + 3) for _ in range(copies)]
    table = cells.pd.DataFrame([((i * 37) % 1009, i % 3, np.array(v) / math.sqrt(sum(x * x for x in v))) for i, v in enumerate(vectors)], columns=["id", "_part", "_u"])
    rows = list(zip(table["id"].tolist(), table["_part"], table["_u"], strict=True))
    for x, above in ((table, 0.25), (table.drop(columns="_part"), 0.25)):
        near = lambda a, b: float(a[2] @ b[2]) > above and ("_part" not in x or a[1] != b[1])  # noqa: B023, E731
        for cut in (len(rows), 25):
            got = cells.cosine_cell("id", above)(x.iloc[:cut], x.iloc[cut:])
            want = [(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for j, b in enumerate(rows) if (i < j if cut == len(rows) else i < cut <= j) and near(a, b)]
            assert sorted(zip(got["id_1"].tolist(), got["id_2"].tolist(), strict=True)) == sorted(want) and len(want) > 5
