"""Column builders for the statistics that the operators share. All of them stay inside Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import stored


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def quantile(value: str, q: float, weight: Column | str | None = None) -> Column:
    """Exact quantile, linear between order statistics; weight is how often a value stands."""
    return F.percentile(value, q, F.col(weight) if isinstance(weight, str) else weight) if weight is not None else F.percentile(value, q)


def tri_quartile(value: str, weight: str | None = None) -> Column:
    """A quarter of the first, half of the second and a quarter of the third quartile."""
    places = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    found = F.percentile(value, places, F.col(weight)) if weight else F.percentile(value, places)  # one pass for all three
    return 0.25 * found[0] + 0.5 * found[1] + 0.25 * found[2]


def mean_positive(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0))


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Rank within `by`, ties sharing their mean rank."""
    return (F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)).cast("double")


def correlation(x: str, y: str) -> Column:
    """Pearson; null where a side is constant or there are under two rows."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / F.when(spread > 1e-12, spread))


def hill(x: Column, k: float) -> Column:
    return x * x / (x * x + k * k)


def bias_label(first: Column, second: Column, threshold: float, names: tuple[str, str] = ("SC-biased", "FC-biased"), eps: float = 1e-10) -> Column:
    ratio = (first + eps) / (second + eps)
    return F.when(ratio > threshold, names[0]).when(ratio < 1 / threshold, names[1]).otherwise("Balanced")


def significance(q: Column) -> Column:
    return F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").otherwise("")


def bh_adjusted(df: DataFrame, p: str, by: Sequence[str], out: str = "q", ties: Sequence[str] = ()) -> DataFrame:
    """Step-up adjusted values: the least p * n / rank from the row's rank on, at most 1; rows without p get none.

    Rows are ordered in ranges, one a task: counts of the ranges before give ranks, minima of those after the rest of the
    least. A range is run through once from its end, since a frame that ends at the last row is taken anew for each row."""
    own, order = [*by, "_part"], [F.col(p).asc_nulls_last(), *ties]
    rows = stored(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))

    def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
        named = ranges.withColumnsRenamed({c: f"_of_{c}" for c in own})
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in own]
        return rows.join(named, same, "left").drop(*(f"_of_{c}" for c in own))

    of = Window.partitionBy(*by)
    others = lambda part: of.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*own).agg(F.count(p).alias("_n"))
    counts = counts.select(*own, F.coalesce(F.sum("_n").over(others("_part")), F.lit(0)).alias("_before"), F.sum("_n").over(of).alias("_all"))
    ranked = with_ranges(rows, counts).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    raw = ranked.withColumn("_bh", F.when(F.col(p).isNotNull(), F.col(p) * F.col("_all") / F.col("_rank")))
    later = raw.groupBy(*own).agg(F.min("_bh").alias("_m")).select(*own, F.min("_m").over(others(F.desc("_part"))).alias("_later"))
    least = F.least(F.lit(1.0), F.min("_bh").over(Window.partitionBy(*own).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)), "_later")
    return with_ranges(raw, later).select(*df.columns, F.when(F.col(p).isNotNull(), least).alias(out))


def bh_kept(p: str, fdr: float, by: Sequence[str], order: Sequence[str]) -> Column:
    """The filter form, place by place: p below fdr * rank / n, strictly. Not step-up: a lesser p can fail."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(p, *order))
    return F.col(p) < fdr * place / F.count("*").over(Window.partitionBy(*by))


def t_two_sided_of_rho(rho: Column, df: Column) -> Column:
    """Two-sided p of a correlation, by t with a whole number of degrees of freedom: the finite sums in powers of the cosine of
    the angle whose tangent is t over the root of df, which is the correlation's own arcsine."""
    theta, cos2 = F.asin(F.abs(rho)), 1 - rho * rho
    odd, last = df % 2 == 1, F.floor((df - 2) / 2).cast("int")
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    ratio = lambda j: F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(steps, start, lambda a, j: F.struct((a["term"] * ratio(j) * cos2).alias("term"), (a["sum"] + a["term"] * ratio(j) * cos2).alias("sum")))["sum"]
    inside = F.when(df == 1, 2 / F.pi() * theta).when(odd, 2 / F.pi() * (theta + F.abs(rho) * F.sqrt(cos2) * total)).otherwise(F.abs(rho) * total)
    return F.when(rho.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), 1 - inside))


def hash_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by underscores: the engine's source of reproducible randomness."""
    return F.md5(F.concat_ws("_", *((F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts)))


def hash_number(key: Column) -> Column:
    """The first 60 bits of an md5 as a long."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
