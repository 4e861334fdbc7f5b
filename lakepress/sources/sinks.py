"""Writes as pure functions of the old table and the new rows; the caller stores the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.alias("o").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")


def _keys(keys: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of equal key whole."""
    there = F.col(f"n.{keys[0]}").isNotNull()
    return _both(old, new, keys).select(*_keys(keys), *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c not in keys])


def upsert_keep(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As upsert, but a null keeps the old value."""
    return _both(old, new, keys).select(*_keys(keys), *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns if c not in keys])


def upsert_span(old: DataFrame, new: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """As upsert, but the first seen is the earlier and the last seen the later one."""
    pick = {first: F.least(f"o.{first}", f"n.{first}"), last: F.greatest(f"o.{last}", f"n.{last}")}
    return _both(old, new, keys).select(*_keys(keys), *[pick.get(c, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).alias(c) for c in old.columns if c not in keys])


def upsert_shift(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, previous, delta): the stored value becomes the previous one."""
    n, o = F.col(f"n.{value}"), F.col(f"o.{value}")
    return _both(old, new, keys).select(*_keys(keys), F.coalesce(n, o).alias(value), F.when(n.isNotNull(), o).alias("previous"), (n - o).alias("delta"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti").select(*old.columns))


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    return old.where(~F.coalesce(condition, F.lit(False)))


def delete_dangling(links: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return links.join(parents.select(key).distinct(), key, "left_semi").select(*links.columns)


def recount(parents: DataFrame, links: DataFrame, key: str, into: str) -> DataFrame:
    n = links.groupBy(key).agg(F.count("*").alias("_n"))
    return parents.drop(into).join(n, key, "left").withColumn(into, F.coalesce("_n", F.lit(0))).drop("_n").select(*parents.columns)


def sync_catalog(old: DataFrame, new: DataFrame, countries: DataFrame) -> DataFrame:
    """new (country_code, name, url) with what to do: skip, update or insert; countries not known are left out."""
    known = new.join(countries.select("country_code").distinct(), "country_code", "left_semi")
    by_url = old.select("country_code", "url", F.lit(True).alias("_u")).distinct()
    by_name = old.select("country_code", "name", F.lit(True).alias("_m")).distinct()
    out = known.join(by_url, ["country_code", "url"], "left").join(by_name, ["country_code", "name"], "left")
    return out.select("country_code", "name", "url", F.when(F.col("_u"), "skip").when(F.col("_m"), "update").otherwise("insert").alias("action"))
