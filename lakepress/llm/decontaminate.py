"""Benchmark decontamination by spaced seeds (operator 8).

A mask is a fixed row of places that count or are ignored. Every window of a benchmark item and of a document is
hashed over the places that count, under each mask, and equal hashes are hits. A substituted word breaks only the
seeds in which it counts, so masks with different gaps still hit. A family of masks has every choice of `weight`
places within `span`. An item takes the first family that is sure to hit wherever enough of its words agree, however
the substitutions lie (`sure`), so no diagonal that is to be found is missed. Each hit names a diagonal (document
place minus item place); there the words are compared one by one, substitutions count as misses, and the item is
found when

- at least `share` of the item's words agree on the diagonal, or
- some window of `window` of its words on the diagonal has at least `window_hits` that agree; where the item or the
  document ends sooner, the window has only the words that both have.

Of an item under `whole_under` words so few may differ that any text would do; it is found where all its words stand
in order. Its seed is its whole phrase.

The seeds of both sides are joined in Spark. Before, a bitmap of the benchmark's seeds (bounded size, collected from
its parts) goes to all tasks, and documents send only seeds that are in it; it lets all seeds of the benchmark pass.
Documents with such seeds are stored with their texts, and meet their candidates once more for the comparison, dealt
by salts so that no task gets an unbounded list. The seed table is broadcast only when it is counted and small.

Defined results: null or empty texts and items match nothing; repeated rows each get their own result; a null id is
kept as null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
import secrets
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .bitmaps import bitmap, within
from .wordhash import ALNUM, combine, slices

#: (weight, span) of the families of masks, the most telling first; the last one hits wherever a word agrees.
FAMILIES = ((4, 6), (3, 5), (2, 3), (1, 1))
#: Seeds of a benchmark that may be broadcast (under 40 bytes each); more are shuffled.
FEW_SEEDS = 200_000
#: Words of items that one task compares with one document at a time.
SALT_WORDS = 100_000


def family(weight: int, span: int) -> list[str]:
    """All masks of a weight that fit into a span: 1 counts, 0 is ignored."""
    inner = [c for c in itertools.combinations(range(1, span), weight - 1)]
    return ["".join("1" if i in (0, *c) else "0" for i in range(max((0, *c)) + 1)) for c in inner]


def sure(n: int, hits: int, weight: int, span: int) -> bool:
    """Whether `hits` agreeing words among n always have `weight` within some `span`: else, n words hold fewer."""
    return hits > n // span * (weight - 1) + min(n % span, weight - 1)


def family_of(n: int, share: float, window: int, window_hits: int, whole_under: int) -> int:
    """Which masks an item of n words takes: the number of a family, or -n for its whole phrase."""
    if n < whole_under:
        return -n
    both = (n, math.ceil(share * n)), (min(window, n), window_hits)
    return next((k for k, (w, s) in enumerate(FAMILIES) if all(sure(m, hits, w, s) for m, hits in both)), len(FAMILIES) - 1)


def masks_of(number: int) -> list[str]:
    return ["1" * -number] if number < 0 else family(*FAMILIES[number])


def mask_places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of h under a mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return h[:0]
    return combine([h[p : p + n] for p in mask_places(mask)], sum(1 << p for p in mask_places(mask)))


def compare(doc: np.ndarray, item: np.ndarray, shift: int, share: float, window: int, window_hits: int, whole_under: int) -> tuple[int, int, int] | None:
    """(agreeing words, first, last + 1 place in doc) if the item is found on the diagonal."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return None
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    n = int(same.sum())
    whole = len(item) < whole_under
    found = n == len(item) if whole else n >= share * len(item)
    if not found and not whole:
        c, reach = np.concatenate(([0], np.cumsum(same))), min(window, len(same))
        found = int((c[reach:] - c[:-reach]).max()) >= window_hits
    if not found or not n:
        return None
    at = np.flatnonzero(same)
    return n, lo + shift + int(at[0]), lo + shift + int(at[-1]) + 1


def _items(how: tuple):
    """Items to their words' hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = []
            for w in slices(b.column("text"), ALNUM):
                h = w.hashes().view(np.int64)
                words += [h[w.at[r] : w.at[r + 1]] for r in range(w.last - w.first)]
            size = [len(x) for x in words]
            kind = [family_of(n, *how) for n in size]
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), pa.array(words, pa.list_(pa.int64())), pa.array(size, pa.int64()), pa.array(kind, pa.int32())], names=["item", "item_id", "words", "size", "kind"])

    return run


def _seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to all their seeds."""
    for b in batches:
        for item, words, kind in zip(*(b.column(c).to_pylist() for c in ("item", "words", "kind")), strict=True):
            h = np.array(words, np.int64).view(np.uint64)
            for m in masks_of(kind):
                s = seeds(h, m)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), item, np.int64)), pa.array(np.arange(len(s), dtype=np.int64))], names=["key", "item", "place"])


_HITS = "row long, doc_id long, text_hash long, text string, hits array<struct<key: long, at: long>>"


def _hits(masks: list[str], bits: int, packed: bytes):
    """Documents with seeds that may be in the benchmark; each gets a number of its own, stored with it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(packed, np.uint8)
        for b in batches:
            row, at, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for w in slices(b.column("text"), ALNUM):
                h = w.hashes()
                for m in masks:
                    s = seeds(h, m)
                    pos = within(s, bits, there)
                    r = np.searchsorted(w.at, pos, "right") - 1
                    ok = pos + len(m) <= w.at[r + 1]
                    row.append(w.first + r[ok])
                    at.append((pos - w.at[r])[ok])
                    key.append(s[pos[ok]])
            r = np.concatenate(row)
            order = np.argsort(r, kind="stable")
            some, n = np.unique(r, return_counts=True)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(key)[order].view(np.int64)), pa.array(np.concatenate(at)[order])], names=["key", "at"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pairs)
            number = secrets.randbits(62) + np.arange(len(some), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(number), *(b.column(c).take(pa.array(some)) for c in ("doc_id", "text_hash", "text")), lists], names=["row", "doc_id", "text_hash", "text", "hits"])

    return run


_FOUND = "row long, doc_id long, text_hash long, item_id long, n_same long, n_item long, first_char long, end_char long"


def _compared(how: tuple):
    """Documents with a list of candidates each to the ones that are found."""
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            ids = [b.column(c).to_pylist() for c in names[:3]]
            lists = b.column("candidates").to_pylist()
            for w in slices(b.column("text"), ALNUM):
                h, chars = w.hashes(), w.chars()
                for r in range(w.last - w.first):
                    a, e, base = int(w.at[r]), int(w.at[r + 1]), chars[w.row_at[r]]
                    for c in lists[w.first + r]:
                        words = np.array(c["words"], np.int64).view(np.uint64)
                        got = compare(h[a:e], words, c["shift"], *how)
                        if got:
                            rows.append((*(x[w.first + r] for x in ids), c["item_id"], got[0], len(words), int(chars[w.start[a + got[1]]] - base), int(chars[w.end[a + got[2] - 1]] - base)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(8)], names=names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, window: int = 16, window_hits: int = 13, whole_under: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_same, n_item, first_char, end_char, text_hash): one row per document row and item found, the best diagonal.

    n_same of the item's n_item words agree; the stretch is first_char..end_char - 1 in code points.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    how = (share, window, window_hits, whole_under)
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    b = b.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    items = shared.materialize(b.mapInArrow(_items(how), "item long, item_id long, words array<long>, size long, kind int").where("size > 0"), "items")
    table = shared.materialize(items.select("item", "words", "kind").mapInArrow(_seeds, "key long, item long, place long"), "seeds")
    n = table.count()
    kinds = [r.kind for r in items.select("kind").distinct().collect()]  # a family or a size under whole_under each
    masks = sorted({m for k in kinds for m in masks_of(k)})
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    found = shared.materialize(d.mapInArrow(_hits(masks, *bitmap(table, n)), _HITS), "hits")
    hits = found.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    joined = hits.join(F.broadcast(table) if n <= FEW_SEEDS else table.hint("merge"), "key")
    candidates = shared.materialize(joined.select("row", "item", (F.col("at") - F.col("place")).alias("shift")).distinct(), "candidates")
    few = n <= FEW_SEEDS  # every item has about as many words as seeds at least
    candidates = candidates.join(F.broadcast(items) if few else items.hint("merge"), "item")
    load = candidates.groupBy("row").agg(F.sum("size").alias("load"))
    dealt = candidates.join(load.hint("merge"), "row").withColumn("salt", F.pmod(F.xxhash64("item", "shift"), F.ceil(F.col("load") / SALT_WORDS)))
    lists = dealt.groupBy("row", "salt").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("candidates")).drop("salt")
    both = found.select("row", "doc_id", "text_hash", "text").join(lists.hint("merge"), "row")
    out = both.select("row", "doc_id", "text_hash", "text", "candidates").mapInArrow(_compared(how), _FOUND)
    best = F.max(F.struct("n_same", (-F.col("first_char")).alias("f"), F.col("end_char").alias("e"), "n_item")).alias("b")
    out = out.groupBy("row", "doc_id", "text_hash", "item_id").agg(best)
    return out.select("doc_id", "item_id", "b.n_same", "b.n_item", (-F.col("b.f")).alias("first_char"), F.col("b.e").alias("end_char"), "text_hash")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows in which a benchmark item is found; other rows with the same id stay."""
    return shared.without_rows(docs, contamination(docs, benchmark, **how))
