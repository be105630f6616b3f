"""How unevenly genes are expressed: entropy over types, Gini over cells, and whether important rules are the uneven ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resample import shuffled_labels
from ..functions.stats import average_rank, correlation
from ..sources.work import stored


def _shares(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """means with p, each type's share of its gene's summed means."""
    total = F.sum("value").over(Window.partitionBy(*by))
    return means.withColumn("p", F.when(total > 0, F.col("value") / F.when(total > 0, total)))


def _bits():
    return F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")))


def type_entropy(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, entropy) in bits of the shares of types in a gene's summed type means; zeros add nothing, no total gives null.
    means: (by, cell_type, value)."""
    return _shares(means, by).groupBy(*by).agg(_bits().alias("entropy"))


def with_type_entropy(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """means with the entropy of each row's gene beside it, in one pass over rows dealt by gene, where a join would make and
    shuffle them a second time."""
    return _shares(means, by).withColumn("entropy", _bits().over(Window.partitionBy(*by))).drop("p")


def gini(values: DataFrame, sizes: DataFrame, by: Sequence[str], group: Sequence[str]) -> DataFrame:
    """(by, gini) over all cells of a group, those without a row as zeros; null under two cells or without a total.

    Zeros are not made into rows: they come first in order, so they only move the places of the others. values: (by,
    value), above zero; sizes: (group, size)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("value"))
    held = F.count("*").over(Window.partitionBy(*by))
    rows = values.filter("value > 0").join(F.broadcast(sizes), list(group)).withColumn("i", place + F.col("size") - held)
    out = rows.groupBy(*by).agg(F.first("size").alias("n"), F.sum((2 * F.col("i") - F.col("size") - 1) * F.col("value")).alias("top"), F.sum("value").alias("total"))
    return out.select(*by, F.when((F.col("n") >= 2) & (F.col("total") > 0), F.col("top") / (F.col("n") * F.col("total"))).alias("gini"))


def by_rule(genes: DataFrame, rule_genes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(lr_name, columns): means over regions for each gene, then over the rule's genes, counted once."""
    means = genes.groupBy("gene").agg(*(F.avg(c).alias(c) for c in columns))
    return rule_genes.select("lr_name", "gene").distinct().join(F.broadcast(means), "gene").groupBy("lr_name").agg(*(F.avg(c).alias(c) for c in columns))


def importance_test(rows: DataFrame, n: int = 1000, seed: int = 42, least: int = 10) -> DataFrame:
    """One row (rules, rho_entropy, rho_gini, p_entropy, p_gini) of rows (lr_name, importance, entropy, gini), one a rule: rank
    correlations of importance with entropy below zero and with gini, and the share of n shuffles of importance that
    reach them, one added above and below. Rules with a null or NaN don't count; under `least` rules, or without spread,
    correlation and p are null. Ranks don't change in a shuffle, so the sum of their products tells the correlation: it
    is exact, and what is added up is one row a rule and shuffle. The ranking of rules, a dimension, is one task's."""
    numbers = ["importance", "entropy", "gini"]
    fine = rows.dropna(subset=numbers).select("lr_name", "importance", (-F.col("entropy")).alias("entropy"), "gini")
    ranked = stored(fine.select("lr_name", *(average_rank(c, []).alias(c) for c in numbers)))
    products = [F.sum(F.col("importance") * F.col(c)).alias(f"sum_{c}") for c in numbers[1:]]
    own = ranked.agg(F.count("*").alias("rules"), *products, *(correlation("importance", c).alias(f"rho_{c}") for c in numbers[1:]))
    drawn = shuffled_labels(ranked.select("lr_name", "importance"), "lr_name", "importance", n, seed)
    sums = drawn.join(ranked.drop("importance"), "lr_name").groupBy("perm").agg(*products).withColumnsRenamed({f"sum_{c}": f"null_{c}" for c in numbers[1:]})
    reached = [F.count(F.when(F.col(f"null_{c}") >= F.col(f"sum_{c}"), 1)).alias(f"n_{c}") for c in numbers[1:]]
    found = own.join(sums, F.lit(True), "left").groupBy(*own.columns).agg(*reached)  # own is one row
    told = lambda c, v: F.when((F.col("rules") >= least) & F.col(f"rho_{c}").isNotNull(), v)
    return found.select("rules", *(told(c, F.col(f"rho_{c}")).alias(f"rho_{c}") for c in numbers[1:]), *(told(c, (F.col(f"n_{c}") + 1) / F.lit(n + 1.0)).alias(f"p_{c}") for c in numbers[1:]))
