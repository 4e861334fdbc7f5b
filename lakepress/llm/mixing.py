"""Mixing sources to target weights by entropy balancing (operator 13).

Each source gets a target of words. Among all document rates between 0 and 2 whose words meet the targets, those are
chosen that differ least from taking each document once, in relative entropy. Their dual is convex and has a
multiplier for each source: a document of x words has the rate min(2, exp(multiplier * x)), so rates are exponentially
tilted by what the document adds to the constraint. Newton's method solves the dual; each iteration is one aggregation
over the corpus. As all documents of a source with as many words share a rate, the iterations run over the table of
(source, size) and its counts, which is exact and is aggregated before it is shuffled.

Rates become whole copies (0, 1 or 2). Per source the sizes are gone through from the largest, and what rounding one
size leaves over is made up by the next, so the sum misses the target by about half the smallest document (or by more
where too few documents are there to meet it at all). Which documents of a size get a copy more is decided by a hash of
their id; of a frequent size, by shares of salted groups, so no group meets in one task.

Sums of an iteration are of decimals and the exponential is the strict one, so the order of tasks does not change a
digit: reruns agree.

Defined results: a null text has size 0 and is taken 0 times its nothing; a null source is a source of its own, the
last; documents without words and sources of such have the target 0; rows of one id and equal rows are documents each,
null ids included (which of wholly equal rows gets the copy cannot be told apart). Very long texts count whole. Other
columns are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Weights that sources take in turn, by their order.
WEIGHTS = (5, 2, 1)
#: Words wanted, as a share of all words, in halves; and the most copies of a document.
HALVES, MOST = 3, 2
#: Rows of one size that are ranked in one task.
GROUP = 10_000
#: Newton steps of one job; jobs after which every source must have settled.
STEPS, JOBS = 4, 40
#: Digits behind the point of a summed term, relative to the longest document of its source.
DIGITS = 12


def numbered(names: DataFrame, name: str) -> DataFrame:
    """names with `place`, from 0, in the order of `name` (code points, nulls last): sorted in ranges, no task sees all."""
    order = F.col(name).asc_nulls_last()
    parts = shared.materialize(names.repartitionByRange(order).sortWithinPartitions(order).withColumn("range", F.spark_partition_id()), "names")
    counts = dict(parts.groupBy("range").count().collect())  # a number for each range
    before, at = {}, 0
    for k in sorted(counts):
        before[k], at = at, at + counts[k]
    first = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("range")] if before else F.lit(0)
    return parts.withColumn("place", first + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1).drop("range")


def targets(sources: DataFrame, name: str = "source", words: str = "source_size") -> DataFrame:
    """sources (name, words, ...) with `target`: shares by weight, what exceeds MOST times a source's words dealt again by weight.

    Each round settles the sources over their bound; two sums are all that a round brings to the driver.
    """
    s = numbered(sources, name)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    s = shared.materialize(s.withColumn("most", MOST * F.col(words)).withColumn("full", F.lit(False)), "sources")
    halves = HALVES * (s.agg(F.sum(words)).first()[0] or 0)
    while True:
        held, weights = s.agg(F.sum(F.when(F.col("full"), F.col("most"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        if not weights:
            break
        share = F.lit(float(halves - 2 * (held or 0))) / F.lit(2.0 * weights) * F.col("weight")
        over = ~F.col("full") & (share > F.col("most"))
        if s.where(over).isEmpty():
            return s.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share)).drop("weight", "most", "full", "place")
        s = shared.materialize(s.withColumn("full", F.col("full") | over), "sources")
    return s.withColumn("target", F.col("most").cast("double")).drop("weight", "most", "full", "place")


def multipliers(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (source_key, target, source_size, longest) with `tilt`: rates min(2, exp(tilt * size / longest)) meet the target.

    sizes: (source_key, size, n). A Newton step that leaves the bracket of the multiplier is replaced by its middle. The
    bracket ends at +-BRACKET times the longest size over the shortest, where all rates are 2 or next to 0.
    """
    x = F.col("size") / F.col("longest")
    rate = F.least(F.lit(float(MOST)), F.exp(F.col("tilt") * x))
    decimal = lambda c: F.sum((F.round(c * F.lit(10.0**DIGITS)).cast("decimal(30,0)") * F.col("n")).cast("decimal(38,0)"))
    free = F.exp(F.col("tilt") * x) < MOST
    whole = F.col("target") >= MOST * F.col("source_size")  # at the bound: every document twice
    state = goals.withColumn("low", -40.0 * F.col("longest")).withColumn("high", F.col("longest").cast("double")).withColumn("tilt", F.lit(0.0)).withColumn("done", whole | (F.col("target") <= 0))
    for _ in range(JOBS):
        for _ in range(STEPS):
            sums = sizes.join(state.where("NOT done"), "source_key").groupBy("source_key").agg(decimal(rate * x).alias("g"), decimal(F.when(free, rate * x * x).otherwise(0.0)).alias("h"))
            state = state.join(sums, "source_key", "left")
            gap = F.col("g").cast("double") / 10.0**DIGITS - F.col("target") / F.col("longest")
            settled = F.col("done") | (F.abs(gap) * F.col("longest") <= F.greatest(F.lit(1e-3), 1e-9 * F.col("target"))) | (F.col("high") - F.col("low") <= 1e-12)
            low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
            step = F.col("tilt") - gap / (F.col("h").cast("double") / 10.0**DIGITS)
            state = state.select("source_key", "target", "source_size", "longest", low.alias("low"), high.alias("high"), "tilt", settled.alias("done"), step.alias("step"))
            inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
            tilt = F.when(F.col("done"), F.col("tilt")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
            state = state.withColumn("tilt", tilt).drop("step")
        state = shared.materialize(state, "dual")
        if state.where("NOT done").isEmpty():
            break
    else:
        raise RuntimeError(f"the dual did not settle in {STEPS * JOBS} steps")
    return state.withColumn("tilt", F.when(whole, F.lit(float("inf"))).otherwise(F.col("tilt"))).drop("low", "high", "done")


def copies_by_size(sizes: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
    """Copies of each size of a source, from the largest; the group has a row for each different size, not for each document."""
    s = sizes.sort_values("size", ascending=False)
    size, n = s["size"].to_numpy(np.int64), s["n"].to_numpy(np.int64)
    out, left = np.zeros(len(s), np.int64), 0.0
    for k, wanted in enumerate(np.clip(s["rate"].to_numpy(), 0, MOST) * n * size):
        if size[k]:
            left += wanted
            out[k] = min(max(int(np.floor(left / size[k] + 0.5)), 0), MOST * int(n[k]))
            left -= out[k] * int(size[k])
    return pd.DataFrame({"cell": s["cell"].to_numpy(), "n": n, "copies": out})


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for each row of docs (doc_id, text, source); see the module's text."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # never null, and no two sources alike
    rows = docs.select("doc_id", F.col("source").alias("source"), key.alias("source_key"), words.alias("size"))
    rows = shared.materialize(rows.withColumn("cell", F.concat_ws(" ", F.col("size").cast("string"), "source_key")).drop("source"), "sized")
    sizes = shared.materialize(rows.groupBy("cell", "source_key", "size").agg(F.count("*").alias("n")), "sizes")
    name = F.when(F.col("source_key") != "n", F.substr("source_key", F.lit(2))).alias("source")
    sources = sizes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.greatest(F.max("size"), F.lit(1)).alias("longest")).select("source_key", name, "source_size", "longest")
    goals = shared.materialize(targets(sources).drop("source"), "goals")
    tilts = multipliers(sizes, goals)
    rate = F.when(F.col("tilt") == float("inf"), float(MOST)).otherwise(F.least(F.lit(float(MOST)), F.exp(F.col("tilt") * F.col("size") / F.col("longest"))))
    rated = sizes.join(tilts, "source_key").select("cell", "source_key", "size", "n", rate.alias("rate"))
    copies = rated.groupBy("source_key").applyInPandas(copies_by_size, "cell string, n long, copies long")
    cells = shared.materialize(copies.join(sizes.select("cell", "source_key"), "cell").join(goals.select("source_key", "source_size", "target"), "source_key").drop("source_key"), "copies")
    return deal(rows.drop("source_key"), cells)


def deal(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (doc_id, size, cell) with copies: those of a cell differ by one at most, and their sum is the cell's."""
    hot = shared.hot_keys(cells, "cell", "n")
    order = F.xxhash64("doc_id", "cell")
    x = shared.join_ones(rows, cells, "cell", hot)
    x = x.withColumn("salt", F.pmod(order, F.ceil(F.col("n") / GROUP)))
    x = shared.materialize(x.withColumn("rest", F.col("copies") % F.col("n")), "dealt")
    even = F.floor(F.col("copies") / F.col("n"))
    # of the copies left over, a salted group gets the difference of the shares up to its end and up to its start
    some = x.where("rest > 0")
    groups = some.groupBy("cell", "salt", "n", "rest").agg(F.count("*").alias("m"))
    end = F.sum("m").over(Window.partitionBy("cell").orderBy("salt"))
    share = lambda c: F.floor(F.col("rest").cast("decimal(19,0)") * c.cast("decimal(19,0)") / F.col("n").cast("decimal(19,0)")).cast("long")
    quota = groups.withColumn("end", end).select("cell", "salt", (share(F.col("end")) - share(F.col("end") - F.col("m"))).alias("quota"))
    place = F.row_number().over(Window.partitionBy("cell", "salt").orderBy(order, "doc_id"))
    met = some.join(quota.hint("merge"), ["cell", "salt"]).withColumn("more", (place <= F.col("quota")).cast("long"))
    out = x.where("rest = 0").withColumn("more", F.lit(0).cast("long")).unionByName(met.drop("quota"))
    n = (even + F.col("more")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"))
