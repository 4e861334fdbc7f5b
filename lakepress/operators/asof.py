"""As-of join: to each row the last row of another table at or before its time."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialize

#: Points of a slice of time, over all keys; slices at most, beyond which they grow.
SLICE, SLICES = 1_000_000, 4096


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, time: str, values: list[str], strict: bool = False, within: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """left with `values` and `time` of the last row of right of the same keys with time <= at, or < at if strict.

    Where there is none, or where within(at, time) does not hold for it, they are null; all rows of left stay, those of
    a null key or time as well. Rows of right with a null key or time are never met; of those of one time the greatest
    by values stands.

    Only different points (keys, time) are sorted, so many rows of one time are no burden. Time is cut at quantiles of
    all points: a key is sorted by slices, not whole, and the last row of the slices before a slice is handed over to
    it. left must have none of right's columns `time` and `values`.
    """
    known = lambda df, c: df.where(F.col(c).isNotNull() & ~F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x))
    asked = known(left, at).select(*keys, F.col(at).alias("_t")).distinct().withColumn("_r", F.lit(None))
    had = known(right, time).groupBy(*keys, F.col(time).alias("_t")).agg(F.max(F.struct(*values)).alias("_v"))
    had = had.select(*keys, "_t", F.struct(F.col("_t").alias(time), *[F.col(f"_v.{c}").alias(c) for c in values]).alias("_r"))
    points = had.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_r", F.lit(None).cast(had.schema["_r"].dataType)).withColumn("_asked", F.lit(True)))
    points = materialize(points, "points")
    n = min(SLICES, math.ceil(points.count() / SLICE))
    if n > 1:
        cuts = points.agg(F.percentile_approx("_t", [k / n for k in range(1, n)], 10 * n).alias("c")).first().c
        cut = F.array(*[F.lit(c) for c in sorted(set(cuts))])
        points = points.withColumn("_s", F.size(F.filter(cut, lambda c: c <= F.col("_t"))))
    else:
        points = points.withColumn("_s", F.lit(0))
    first = F.col("_asked") if not strict else ~F.col("_asked")  # of one time: rows of right come first, or last
    inside = Window.partitionBy(*keys, "_s").orderBy("_t", first).rowsBetween(Window.unboundedPreceding, 0)
    found = points.withColumn("_in", F.last("_r", ignorenulls=True).over(inside)).where("_asked").drop("_r", "_asked")
    if n > 1:
        ends = points.groupBy(*keys, "_s").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_end"))  # a row for each slice of a key
        before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        found = found.join(carry, [*keys, "_s"]).withColumn("_in", F.coalesce("_in", "_carry"))
    if within is not None:
        found = found.withColumn("_in", F.when(within(F.col("_t"), F.col("_in")[time]), F.col("_in")))
    found = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_t", "_in")
    on = [left[k] == F.col(f"_k{i}") for i, k in enumerate(keys)] + [left[at] == F.col("_t")]
    return left.join(found, on, "left").select(*left.columns, *[F.col("_in")[c].alias(c) for c in [time, *values]])
