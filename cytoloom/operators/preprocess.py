"""Preparation of expression tables: checks, normalisation, annotation, taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def raw_count_check(expr: DataFrame, sample: int = 100, normalised_max: float = 20.0) -> DataFrame:
    """(whole, most, raw) of the block of the first cells and genes: raw counts are whole and exceed normalised_max."""
    first = lambda c: expr.select(c).distinct().orderBy(c).limit(sample)  # noqa: E731  a bounded block
    block = expr.join(F.broadcast(first("cell_id")), "cell_id", "left_semi").join(F.broadcast(first("gene")), "gene", "left_semi")
    whole = F.coalesce(F.bool_and(F.abs(F.col("value") - F.round("value")) <= 1e-6), F.lit(True))
    return block.agg(whole.alias("whole"), F.coalesce(F.max("value"), F.lit(0.0)).alias("most")).withColumn("raw", F.col("whole") & (F.col("most") > normalised_max))


def log_normalise(expr: DataFrame, target: float = 1e4, total: str | None = None) -> DataFrame:
    """log1p of values scaled so that each cell's total over all genes is target; cells without total stay zero. Where a
    column holds each cell's total already, its name saves the shuffle by cell."""
    total = F.sum("value").over(Window.partitionBy("cell_id")) if total is None else F.col(total)
    return expr.withColumn("value", F.when(total > 0, F.log1p(F.col("value") / total * target)).otherwise(0.0))


def normalise_if_needed(expr: DataFrame, mode: str = "auto") -> DataFrame:
    if mode not in ("auto", "always", "never"):
        raise ValueError(f"unknown mode {mode!r}")
    return log_normalise(expr) if mode == "always" or mode == "auto" and raw_count_check(expr).first()["raw"] else expr


def subset_genes(expr: DataFrame, genes: DataFrame) -> DataFrame:
    return expr.join(F.broadcast(genes.select("gene").distinct()), "gene", "left_semi")


def gene_list(table: DataFrame, columns: Sequence[str], separator: str = ";") -> DataFrame:
    """(gene): the distinct, trimmed members of lists held as text in the columns."""
    parts = [table.select(F.explode(F.split(c, separator)).alias("gene")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.trim("gene").alias("gene")).filter("gene <> ''").distinct()


def strip_suffix(column: str, pattern: str = "-[01]$"):
    return F.regexp_replace(column, pattern, "")


def annotate(cells: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Cells with metadata, null where there is none."""
    return cells.join(meta, key, "left")


def attach_assignments(cells: DataFrame, assigned: DataFrame, key: str, region: str, kind: str) -> DataFrame:
    """Cells that have an assignment, with the label region::kind."""
    return cells.join(assigned, key, "inner").withColumn("label", F.concat_ws("::", region, kind))


def nearest_marked(terms: DataFrame, suffix: str = "_SUPC", depth: int = 32) -> DataFrame:
    """(label, name): of each term and its ancestors the nearest whose set label ends in suffix; '' if the chain ends first.

    All chains climb a level at a time by an equi-join; climbing stops when none is left."""
    step = terms.select("label", F.col("label").alias("at"))
    up = terms.select(F.col("label").alias("at"), "parent", "set_label", "name")
    out = None
    for _ in range(depth):
        here = step.join(up, "at", "left")
        done = here.filter(F.col("at").isNull() | F.col("set_label").isNull() | F.col("set_label").endswith(suffix)).select("label", F.coalesce(F.when(F.col("set_label").endswith(suffix), F.col("name")), F.lit("")).alias("name"))
        out = done if out is None else out.unionByName(done)
        step = here.filter(F.col("set_label").isNotNull() & ~F.col("set_label").endswith(suffix)).select("label", F.col("parent").alias("at"))
        if step.isEmpty():
            break
    return out


def swap_ids(genes: DataFrame, key: str = "gene", other: str = "ensg") -> DataFrame:
    """The two name columns exchanged."""
    return genes.select(F.col(other).alias(key), F.col(key).alias(other), *[c for c in genes.columns if c not in (key, other)])


def dataset_cell_names(cells: DataFrame, dataset: str = "dataset", prefix: bool = True) -> DataFrame:
    """Cell ids made unique by their dataset's name; without prefix, ids found twice raise."""
    if prefix:
        return cells.withColumn("cell_id", F.concat_ws("_", "cell_id", dataset))
    if not cells.groupBy("cell_id").count().filter("count > 1").isEmpty():
        raise ValueError("a cell id stands in several datasets")
    return cells


def region_means(expr: DataFrame, labels: DataFrame, by: Sequence[str], log: str = "after") -> DataFrame:
    """(by, gene, value): mean over the cells of each group, absent rows as zeros. log: after takes log1p of the mean,
    before takes the mean of log1p, none takes neither."""
    value = F.log1p("value") if log == "before" else F.col("value")
    sizes = labels.groupBy(*by).agg(F.count("*").alias("size"))
    sums = labels.join(expr, "cell_id").groupBy(*by, "gene").agg(F.sum(value).alias("total"))
    mean = F.col("total") / F.col("size")
    return sums.join(sizes, list(by)).select(*by, "gene", (F.log1p(mean) if log == "after" else mean).alias("value"))


def pair_counts(cells: DataFrame, prefix: str = "") -> DataFrame:
    """(region, cell_type, cells); the prefix is taken off region names."""
    return cells.groupBy(F.regexp_replace("region", f"^{prefix}", "").alias("region"), "cell_type").agg(F.count("*").alias("cells"))


def complete_counts(counts: DataFrame) -> DataFrame:
    """Every region with every type, zero where there is no cell."""
    grid = counts.select("region").distinct().join(F.broadcast(counts.select("cell_type").distinct()))
    return grid.join(counts, ["region", "cell_type"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
