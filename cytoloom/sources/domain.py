"""The star-schema tables seen as the engine's domain, and the rule table.

A customer is a cell; its region and market segment are the cell's region and type, its nation the subject; a brand is
a gene, and the quantity of it that the customer ordered is the expression. An absent (cell, gene) row is a zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Synthetic rules: name, then for either side the genes, their groups, and the groups' coefficients.
RULES = [
    ("R1_single", ["Brand#11"], [1], [1.0], ["Brand#12"], [1], [1.0]),
    ("R2_one_group", ["Brand#13", "Brand#14"], [1, 1], [1.0], ["Brand#15"], [1], [1.0]),
    ("R3_two_groups", ["Brand#21", "Brand#22"], [1, 2], [1.0, 1.0], ["Brand#23"], [1], [1.0]),
    ("R4_coefficients", ["Brand#24", "Brand#25"], [1, 2], [2.0, 1.0], ["Brand#31", "Brand#32"], [1, 2], [1.0, 1.0]),
    ("R5_part_absent", ["Brand#33", "Absent#1"], [1, 1], [1.0], ["Brand#34"], [1], [1.0]),
    ("R6_group_absent", ["Brand#35", "Absent#2"], [1, 2], [1.0, 1.0], ["Brand#41"], [1], [1.0]),
    ("R7_receptor_absent", ["Brand#42"], [1], [1.0], ["Absent#3"], [1], [1.0]),
    ("R8_same_gene", ["Brand#43"], [1], [1.0], ["Brand#43"], [1], [1.0]),
]

RULE_SCHEMA = (
    "lr_name string, lig_contributor array<string>, lig_contributor_group array<int>, lig_contributor_coeff array<double>, "
    "receptor_subunit array<string>, receptor_subunit_group array<int>, receptor_subunit_coeff array<double>"
)


def rule_table(spark: SparkSession, rules: list | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, RULE_SCHEMA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, region, cell_type, node, subject, balance)."""
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    out = own.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(F.col("c_custkey").alias("cell_id"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("cell_type"), F.concat_ws("::", "r_name", "c_mktsegment").alias("node"), F.col("n_name").alias("subject"), F.col("c_acctbal").alias("balance"))


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, gene, value), one row for each non-zero."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    out = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return out.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy (label, parent, set_label, name): regions over nations over customers."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("label"), F.lit(None).cast("string").alias("parent"), F.lit("LEVEL_SUPC").alias("set_label"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("label"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.lit("LEVEL_CLUS").alias("set_label"), F.col("n_name").alias("name"))
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("label"), F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.lit("LEVEL_SUBC").alias("set_label"), F.col("c_name").alias("name"))
    return region.unionByName(nation).unionByName(own)
