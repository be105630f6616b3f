"""Edges and the features that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import correlation


def region_of(label: str) -> Column:
    return F.trim(F.split(label, "::", 2)[0])


def type_of(label: str) -> Column:
    """What follows the first ::, '' where nothing does."""
    return F.coalesce(F.trim(F.get(F.split(label, "::", 2), F.lit(1))), F.lit(""))


def strict_pair(label: str) -> tuple[Column, Column]:
    """Region and type where the label has exactly one ::, else the label twice."""
    parts = F.split(label, "::")
    both = F.size(parts) == 2
    return F.when(both, parts[0]).otherwise(F.col(label)), F.when(both, F.get(parts, F.lit(1))).otherwise(F.col(label))


def with_alias(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Names in column replaced by what they are called elsewhere."""
    if not names:
        return df
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def edge_table(regions: DataFrame) -> DataFrame:
    """(edge_idx, src_region, tgt_region) of all ordered pairs; the source varies fastest in region order."""
    rows = regions.select("region").distinct().orderBy("region").collect()  # a dimension
    names = [r["region"] for r in rows]
    n = len(names)
    at = F.create_map(*[F.lit(x) for i, r in enumerate(names) for x in (r, i)]) if names else F.create_map()
    src = regions.select(F.col("region").alias("src_region")).distinct()
    pairs = src.join(F.broadcast(src.withColumnRenamed("src_region", "tgt_region")))
    return pairs.select((at[F.col("src_region")] + F.lit(n) * at[F.col("tgt_region")]).cast("long").alias("edge_idx"), "src_region", "tgt_region")


def edge_features(net: DataFrame) -> DataFrame:
    """(src_region, tgt_region, lr_name, ct_l, ct_r, feature, value) of a network over region::type nodes."""
    rows = net.select(region_of("sender").alias("src_region"), region_of("receiver").alias("tgt_region"), "lr_name", type_of("sender").alias("ct_l"), type_of("receiver").alias("ct_r"), F.col("net").alias("value"))
    return rows.withColumn("feature", F.regexp_replace(F.concat_ws("_", "lr_name", "ct_l", "ct_r"), " ", "."))


def kept_features(rows: DataFrame, n_edges: int, least_valid: float, most_zero: float) -> DataFrame:
    """(feature, valid, zero): features with enough edges present and few enough zeros, absent edges being zeros."""
    found = rows.groupBy("feature").agg((F.count("value") / float(n_edges)).alias("valid"), (1 - F.sum((F.col("value") != 0).cast("int")) / float(n_edges)).alias("zero"))
    return found.filter((F.col("valid") >= least_valid) & (F.col("zero") <= most_zero))


def varying_features(rows: DataFrame, n_edges: int, least: float) -> DataFrame:
    """(feature, variance) of at least `least`: population variance over all edges, absent ones as zeros."""
    v = F.col("value")
    found = rows.groupBy("feature").agg((F.sum(v * v) / float(n_edges) - F.pow(F.sum(v) / float(n_edges), F.lit(2.0))).alias("variance"))
    return found.filter(F.col("variance") >= least)


def not_all_null(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature").agg(F.count("value").alias("n")).filter("n > 0")


def region_collapsed(net: DataFrame) -> DataFrame:
    """(src_region, tgt_region, lr_name, value): mean over the pairs of nodes, nulls aside."""
    return net.groupBy(region_of("sender").alias("src_region"), region_of("receiver").alias("tgt_region"), "lr_name").agg(F.avg("net").alias("value"))


def expression_product(means: DataFrame, rule_genes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_idx, lr_name, value): mean of the ligand genes at the source times that of the receptor genes at the target;
    null for rules with a side that has no gene."""
    sides = means.join(F.broadcast(rule_genes), "gene").groupBy("lr_name", "side", "region").agg(F.avg("value").alias("x"))
    lig = sides.filter("side = 'lig'").select("lr_name", F.col("region").alias("src_region"), F.col("x").alias("l"))
    rec = sides.filter("side = 'rec'").select("lr_name", F.col("region").alias("tgt_region"), F.col("x").alias("r"))
    grid = edges.join(F.broadcast(rule_genes.select("lr_name").distinct()))
    return grid.join(F.broadcast(lig), ["lr_name", "src_region"], "left").join(F.broadcast(rec), ["lr_name", "tgt_region"], "left").select("edge_idx", "lr_name", (F.col("l") * F.col("r")).alias("value"))


def region_coexpression(means: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_idx, value): Pearson of the two regions' profiles over genes. Each unordered pair is worked out once."""
    a = means.select("gene", F.col("region").alias("a"), F.col("value").alias("x"))
    b = means.select("gene", F.col("region").alias("b"), F.col("value").alias("y"))
    pairs = a.join(b, "gene").filter("a <= b").groupBy("a", "b").agg(correlation("x", "y").alias("value"))
    ordered = edges.withColumns({"a": F.least("src_region", "tgt_region"), "b": F.greatest("src_region", "tgt_region")})
    return ordered.join(F.broadcast(pairs), ["a", "b"], "left").select("edge_idx", "value")


def aligned_features(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (edge_idx, feature, value) for exactly the wanted features, 0 where a feature or edge is missing."""
    grid = rows.select("edge_idx").distinct().join(F.broadcast(wanted.select("feature")))
    return grid.join(rows, ["edge_idx", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
