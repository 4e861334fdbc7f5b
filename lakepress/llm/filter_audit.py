"""Audit of how filters overlap, over all their orders and subsets (operator 12).

Five filters look at each document; the sets of filters that a document fails are counted for each part (its source).
The subset-zeta transform turns a part's 32 counts into the survivors of every subset of filters at once, in 5 * 32
additions. A step of an order leads from one subset to a neighbour with one filter more, so what it removes is the
difference of their survivors, and the same for labelled documents; a filter's share over all orders (Shapley) is the
sum of these differences, each as often as orders pass there.

One scan reads the texts and leaves a narrow row for each document. Copies are found by the text's SHA-256: its
smallest doc_id is aggregated before it is shuffled, and rows meet it by digest and doc_id together, so a text that a
third of all rows share is no hot key.

Defined results: a null text is empty, and an empty text fails A (no words) and, if another row with a smaller doc_id
is empty, E; B and C do not fail (0 < 0, 0 > 0). A null source is the part of the empty string. Rows of a null doc_id
have no smaller doc_id and no labels: E never fails for them. Repeated rows each count; of equal texts all rows of the
smallest doc_id stand (ties are no smaller ids). A document labelled by several rows has a label if one of them says 1.
Other columns are not read, so their names cannot clash. Very long texts are counted whole. An empty table gives no rows.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

FILTERS = "ABCDE"
COPY = 16  # the bit of E
SETS = 1 << len(FILTERS)
COUNTED = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; E needs the whole table."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"))
    rows = rows.join(marks.where("doc_id IS NOT NULL"), "doc_id", "left").fillna(0, ["good", "toxic"])
    rows = shared.materialize(rows, "audit")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    stand = rows.join(first, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id IS NULL").select("digest", "doc_id", "part", "mask", "good", "toxic"))

    def counted(x: DataFrame, mask: Column, sign: int) -> DataFrame:
        return x.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).select("part", "mask", *[(sign * F.col(c)).alias(c) for c in COUNTED])

    copies = F.col("mask").bitwiseOR(F.lit(COPY))
    parts = counted(rows, copies, 1).unionByName(counted(stand, copies, -1)).unionByName(counted(stand, F.col("mask"), 1))
    return parts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTED])


def with_subsets(sums: str, bit: int) -> Column:
    """A round of the transform: masks that hold the bit take in the sum of those that differ in it alone."""
    without = lambda m: F.get(F.col(sums), m.bitwiseXOR(F.lit(bit)))
    return F.transform(sums, lambda v, m: v + F.when(m.bitwiseAND(F.lit(bit)) != 0, without(m)).otherwise(0))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, n, good, toxic as arrays by mask, and n_left, good_left, toxic_left): left[S] is what passes all filters of S.

    A part has at most 32 rows of counts, whatever the size of the corpus.
    """
    held = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTED))))
    x = counts.groupBy("part").agg(held.alias("held"))
    by_mask = lambda c: F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda m: F.coalesce(F.col("held")[m].getField(c), F.lit(0).cast("long")))
    x = x.select("part", *[by_mask(c).alias(c) for c in COUNTED])
    for c in COUNTED:
        x = x.withColumn(f"{c}_in", F.col(c))
    for bit in (1 << k for k in range(len(FILTERS))):
        for c in COUNTED:
            x = x.withColumn(f"{c}_in", with_subsets(f"{c}_in", bit))
    # a document passes all filters of S if it fails none but those outside of S
    return x.select("part", *COUNTED, *[F.reverse(f"{c}_in").alias(f"{c}_left") for c in COUNTED])


def steps() -> list[dict]:
    """The steps of all orders: the filters applied before, the one applied, as bits."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": k + 1, "before": before, "bit": bit})
            before |= bit
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step; see the module's text.

    docs: doc_id, text, source; labels: doc_id, quality, toxic.
    """
    left = survivors(mask_counts(docs, labels))
    lost = lambda c, s, bit: F.get(F.col(f"{c}_left"), s) - F.get(F.col(f"{c}_left"), s.bitwiseOR(bit))

    def shapley(k: int) -> Column:
        """The part's documents that a filter removes, over all orders: subsets without it, each as often as orders lead there."""
        bit, others = 1 << k, [s for s in range(SETS) if not s >> k & 1]
        often = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        return sum((often(s) * lost("n", F.lit(s), F.lit(bit)) for s in others[1:]), often(0) * lost("n", F.lit(0), F.lit(bit)))

    left = left.withColumn("by_filter", F.array(*[shapley(k) for k in range(len(FILTERS))]))
    every = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    x = left.withColumn("s", F.explode(every)).select("*", "s.*")
    removed = lost("n", F.col("before"), F.col("bit"))
    failing = lost("n", F.lit(0), F.col("bit"))
    place = F.log2(F.col("bit")).cast("int")
    return x.select(
        "part", "filter_order", "step", F.get("n_left", F.col("before").bitwiseOR(F.col("bit"))).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"), F.get("n", "bit").alias("unique_fails"),
        lost("good", F.col("before"), F.col("bit")).alias("good_lost"), lost("toxic", F.col("before"), F.col("bit")).alias("toxic_lost"), F.get("by_filter", place).alias("shapley"),
    )
