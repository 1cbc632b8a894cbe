"""Resolving references: prefixes of paths against a dictionary of citekeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """One row per key: the value that comes first in ``order``; combined before the shuffle."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_wins(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def unique_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(value, key)`` of the values that occur once."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(key)).where("_n = 1").drop("_n")


def keys_by_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(value, keys)``: all keys of a value in order. For values that few keys have; a list is one row."""
    return df.groupBy(value).agg(F.sort_array(F.collect_list(key)).alias("keys"))


def prefixes(path: Column, least: int = 2) -> Column:
    """Keys of the path's prefixes with at least ``least`` components, longest first; none for shorter paths."""
    n = F.size(path)
    made = F.transform(F.sequence(n, F.lit(least), F.lit(-1)), lambda k: F.struct(k.alias("cut"), F.array_join(F.slice(path, F.lit(1), k), "_").alias("citekey")))
    return F.when(n >= least, made).otherwise(F.array().cast("array<struct<cut:int,citekey:string>>"))


def resolve_longest(refs: DataFrame, lookup: DataFrame, path: str, keys: list[str], target: str = "key") -> DataFrame:
    """``keys`` and ``target`` of every reference that resolves, by the longest of its prefixes that the dictionary has.

    References are spread over their prefixes (a handful each) and meet the dictionary in an equi-join; the longest
    hit per reference is a maximum, which is combined before its shuffle. ``keys`` name a reference.
    """
    spread = refs.select(*keys, F.explode(prefixes(F.col(path))).alias("_p")).select(*keys, "_p.cut", "_p.citekey")
    hits = spread.join(lookup.select("citekey", target), "citekey")
    return hits.groupBy(*keys).agg(F.max_by(target, "cut").alias(target))


def resolve_fixed(refs: DataFrame, lookup: DataFrame, path: str, keys: list[str], length: int = 2, target: str = "key") -> DataFrame:
    """References by their first ``length`` components; shorter ones and misses are left out."""
    at = refs.where(F.size(path) >= length).select(*keys, F.array_join(F.slice(F.col(path), 1, length), "_").alias("citekey"))
    return at.join(lookup.select("citekey", target), "citekey").select(*keys, target)


def resolve_authority(refs: DataFrame, lookup: DataFrame, law_roots: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Paths of several components as ``resolve_fixed``; a single one is a law, whose root node ``(citekey, key)`` is meant."""
    law = refs.where(F.size(path) == 1).select(*keys, F.col(path)[0].alias("citekey")).join(law_roots.select("citekey", "key"), "citekey").select(*keys, "key")
    return resolve_fixed(refs, lookup, path, keys).unionByName(law)


def kind_by_list(items: DataFrame, name: str, lists: DataFrame, length: int = 13) -> DataFrame:
    """Left join of ``lists(id, kind, rank)`` on the first characters of a file's name; the list of the highest rank wins."""
    best = last_wins(lists, "id", "kind", ["rank"])
    return items.withColumn("id", F.substring(name, 1, length)).join(best, "id", "left")


def with_short_names(names: DataFrame, short: Column, name: str = "name", citekey: str = "citekey") -> DataFrame:
    """Adds names without their year where all laws of that short name are one, and no law has it as its own name."""
    cut = names.withColumn("_short", short).where("_short is not null")
    one = cut.groupBy("_short").agg(F.min(citekey).alias(citekey), F.max(citekey).alias("_hi")).where(F.col(citekey) == F.col("_hi"))
    new = one.select(F.col("_short").alias(name), citekey).join(names.select(name), name, "left_anti")
    return names.select(name, citekey).unionByName(new)
