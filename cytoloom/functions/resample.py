"""Permutation and bootstrap axes as DataFrames.

Draws are ordered or picked by md5 of seed, draw and row, so they don't depend on partitions and any SQL engine can
repeat them. Ranks over a whole table are found in two levels: rows are bucketed by the leading digits of their hash,
buckets are counted, and ranks within a bucket are offset by the counts before it. No task orders all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import hash_key, hash_number


def axis(df: DataFrame, n: int, name: str) -> DataFrame:
    """Every row n times, numbered 0 to n - 1 in column name."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def hash_ranked(df: DataFrame, by: Sequence[str], key: str, ties: Sequence[str], out: str, digits: int = 2) -> DataFrame:
    """Rank rows (from 1) within `by` by the hexadecimal text `key`, then `ties`."""
    bucketed = df.withColumn("_b", F.substring(key, 1, digits))
    counts = bucketed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key, *ties))
    return bucketed.join(before, [*by, "_b"]).withColumn(out, (within + F.col("_o")).cast("long")).drop("_b", "_o")


def shuffled_labels(df: DataFrame, unit: str, label: str, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, perm, unit, label): n shuffles of the labels over the units, within `by`. The unit with hash rank r gets the label
    of the unit with plain rank r; plain order is by md5 of the unit under permutation -1."""
    plain = hash_ranked(df.select(*by, unit, label).withColumn("_k", hash_key(seed, -1, unit)), by, "_k", [unit], "_r")
    drawn = hash_ranked(axis(df.select(*by, unit), n, "perm").withColumn("_k", hash_key(seed, "perm", unit)), [*by, "perm"], "_k", [unit], "_r")
    return drawn.select(*by, "perm", unit, "_r").join(plain.select(*by, "_r", label), [*by, "_r"]).select(*by, "perm", unit, label)


def bootstrap_means(df: DataFrame, group: Sequence[str], value: str, order: Sequence[str], n: int, seed: int) -> DataFrame:
    """(group, boot, mean): n resamples, with replacement, of each group's values. Draw k of resample b takes the value
    at hash(seed, b, k) modulo the group's size, in `order`."""
    at = df.select(*group, value, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*group)).alias("_n"))
    picks = axis(at.select(*group, F.col("_i").alias("_k"), "_n"), n, "boot").withColumn("_i", (hash_number(hash_key(seed, "boot", "_k")) % F.col("_n")).cast("int"))
    return picks.select(*group, "boot", "_i").join(at.select(*group, "_i", value), [*group, "_i"]).groupBy(*group, "boot").agg(F.avg(value).alias("mean"))


def subset_draws(names: DataFrame, name: str, k: int, n: int, seed: int, numbers: Column | None = None) -> DataFrame:
    """(draw, name): n subsets of size k, without replacement, in hash order; numbers, an array, tells which draws instead."""
    which = F.sequence(F.lit(0), F.lit(n - 1)) if numbers is None else numbers
    drawn = names.select(name).withColumn("draw", F.explode(which)).withColumn("_k", hash_key(seed, "draw", name))
    return drawn.withColumn("_r", F.row_number().over(Window.partitionBy("draw").orderBy("_k", name))).filter(F.col("_r") <= k).select("draw", name)
