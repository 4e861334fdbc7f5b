"""The license scan against a plain comparison of all spans, on texts put together from the templates."""

import random
import re
from collections import defaultdict

from lakepress.llm import licenses


def plain(text, share=0.6, slack=4, k=licenses.K):
    """labels and spans of a text: every span is compared with every other one."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    grams, size, named = defaultdict(list), {}, {}
    for tid, label, base, t in licenses._templates():
        size[tid], named[tid] = len(t) - k + 1, (label, base)
        for i in range(size[tid]):
            grams[tuple(t[i : i + k])].append((tid, i))
    bands = defaultdict(list)
    for at in range(len(w) - k + 1):
        for tid, i in grams.get(tuple(w[at : at + k]), ()):
            width = slack + size[tid] // 8
            for b in [at - i] if named[tid][1] else [(at - i) // width, (at - i) // width + 1]:
                bands[tid, b].append((i, at))
    found = []
    for (tid, _), hits in bands.items():
        label, base = named[tid]
        part = len({i for i, _ in hits}) / size[tid]
        if part == 1 if base else part >= share:
            found.append((label, base, part, min(at for _, at in hits), max(at for _, at in hits) + k))

    def beaten(s):
        return any(not o[1] and o[0] != s[0] and o[2] > s[2] and 2 * (min(o[4], s[4]) - max(o[3], s[3])) >= s[4] - s[3] for o in found)

    stay = [s for s in found if s[1] or not beaten(s)]
    return ",".join(sorted({s[0] for s in stay})), ",".join(sorted({f"{s[0]}:{s[3]}:{s[4]}" for s in stay}))


def test_every_overlapping_span_is_compared(spark):
    rng, pool = random.Random(11), [t for _, _, _, t in licenses._templates()]
    texts = []
    for _ in range(400):
        w = [x for t in rng.choices(pool, k=rng.randint(1, 8)) for x in t]
        for i in rng.sample(range(len(w)), rng.randint(0, len(w) // 10)):
            w[i] = "changed"
        texts.append(" ".join(w))
    # one notice over and over: more found spans beside each other than any fixed number of neighbours
    texts += [" ".join(pool[4] * 40), " ".join(" ".join(p) for p in pool), " ".join(pool[0] * 60 + pool[5])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.spans) for r in licenses.license_scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
