"""Subject tables and rank association with covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.work import cut, stored
from .features import region_of, type_of
from .spatial import null_summary

LEAST_ROWS = 10


def feature_name(lr: Column, sender: Column, receiver: Column) -> Column:
    return F.concat(lr, F.lit(" | "), sender, F.lit("→"), receiver)


def parse_feature(column: str) -> tuple[Column, Column, Column]:
    """Rule, sender type and receiver type of a feature name; the arrow may be -> as well."""
    parts = F.split(F.col(column), " \\| ", 2)
    pair = F.split(F.get(parts, F.lit(1)), "→|->", 2)
    return parts[0], pair[0], F.get(pair, F.lit(1))


def subject_features(net: DataFrame, within_region: bool = False) -> DataFrame:
    """(subject, [region,] lr_name, ct_s, ct_r, value): mean over all pairs of nodes with these types; within_region takes
    only pairs of one region and keeps regions apart."""
    rows = net.select("subject", "lr_name", region_of("sender").alias("region"), region_of("receiver").alias("other"), type_of("sender").alias("ct_s"), type_of("receiver").alias("ct_r"), "net")
    if within_region:
        return rows.filter("region = other").groupBy("subject", "region", "lr_name", "ct_s", "ct_r").agg(F.avg("net").alias("value"))
    return rows.groupBy("subject", "lr_name", "ct_s", "ct_r").agg(F.avg("net").alias("value"))


def spearman(rows: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", least: int = LEAST_ROWS) -> DataFrame:
    """(by, n, rho): rank correlation over rows with both values, null under `least` rows or where a side is constant."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumns({"_rx": S.average_rank(x, by), "_ry": S.average_rank(y, by)})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, S.correlation("_rx", "_ry")).alias("rho"))


def partial_spearman_one(rows: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", c: str = "c", least: int = LEAST_ROWS) -> DataFrame:
    """(by, n, rho) with one covariate, by the closed form on ranks: no projection matrix is built."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(c).isNotNull())
    ranked = both.withColumns({"_rx": S.average_rank(x, by), "_ry": S.average_rank(y, by), "_rc": S.average_rank(c, by)})
    r = ranked.groupBy(*by).agg(F.count("*").alias("n"), S.correlation("_rx", "_ry").alias("xy"), S.correlation("_rx", "_rc").alias("xc"), S.correlation("_ry", "_rc").alias("yc"))
    below = F.sqrt((1 - F.col("xc") * F.col("xc")) * (1 - F.col("yc") * F.col("yc")))
    rho = F.when((F.col("n") >= least) & (below > 1e-12), (F.col("xy") - F.col("xc") * F.col("yc")) / F.when(below > 1e-12, below))
    return r.select(*by, "n", F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))


def partial_spearman(rows: DataFrame, by: Sequence[str], covariates: Sequence[str], x: str = "x", y: str = "y", least: int = LEAST_ROWS) -> DataFrame:
    """(by, n, rho, p) with any covariates: the rank correlation of what covariates' ranks and an intercept leave of x and y.
    p is of t with n - 2 degrees of freedom, however many covariates. Rows with a null or NaN among the columns don't
    count. Null under `least` rows and where nothing is left of x or y; covariates that others explain change nothing.

    A group is ranked by windows and becomes one row of covariances; covariates are then eliminated from that matrix one by
    one, in expressions, so no task holds a group's rows."""
    names = [x, y, *covariates]
    fine = rows.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in names)).select(*by, *names)
    ranked = fine.withColumns({f"_r{i}": S.average_rank(c, by) for i, c in enumerate(names)})
    size = len(names)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), *(F.covar_pop(f"_r{i}", f"_r{j}").alias(f"_s{i}_{j}") for i, j in pairs))
    at = lambda i, j: F.col(f"_s{min(i, j)}_{max(i, j)}")
    out = out.withColumns({f"_v{i}": at(i, i) for i in range(size)})
    for c in range(size - 1, 1, -1):
        rest = [(i, j) for i, j in pairs if j < c]
        some = at(c, c) > 1e-12 * F.col(f"_v{c}")
        out = out.select(*by, "n", *(f"_v{i}" for i in range(c)), *(F.when(some, at(i, j) - at(i, c) * at(j, c) / at(c, c)).otherwise(at(i, j)).alias(f"_s{i}_{j}") for i, j in rest))
    left = (F.col("n") >= least) & (at(0, 0) > 1e-12 * F.col("_v0")) & (at(1, 1) > 1e-12 * F.col("_v1"))
    rho = F.when(left, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at(0, 1) / F.sqrt(at(0, 0) * at(1, 1)))))
    return out.select(*by, "n", rho.alias("rho")).select(*by, "n", "rho", S.t_two_sided_of_rho(F.col("rho"), F.col("n") - 2).alias("p"))


def mean_abs_alignment(rows: DataFrame, by: Sequence[str], feature: str = "feature", covariates: Sequence[str] = (), least: int = 3) -> DataFrame:
    """(by, features, v): over a set's features, the mean absolute rank correlation of x and y given the covariates. Features
    whose correlation is undefined don't count; v is null where none is left."""
    keys = [*by, feature]
    if len(covariates) > 1:
        found = partial_spearman(rows, keys, covariates, least=least)
    else:
        found = partial_spearman_one(rows, keys, c=covariates[0], least=least) if covariates else spearman(rows, keys, least=least)
    return found.groupBy(*by).agg(F.count("rho").alias("features"), F.avg(F.abs("rho")).alias("v"))


def null_alignment(real: DataFrame, surrogates: DataFrame, y: DataFrame, unit: str, covariates: Sequence[str] = (), least: int = 3) -> DataFrame:
    """One row (real, features, p, z, mean, sd, median, surrogates): the mean absolute alignment of real features with y
    against that of surrogate sets. real: (feature, unit, x); surrogates: the same with s, the set; y: (unit, y, covariates).
    All sets go through one plan."""
    rows = real.select(F.lit(-1).alias("s"), "feature", unit, "x").unionByName(surrogates.select(F.col("s").cast("int").alias("s"), "feature", unit, "x"))
    found = stored(mean_abs_alignment(rows.join(y, unit), ["s"], covariates=covariates, least=least))
    own = found.filter("s = -1").select(F.lit(1).alias("one"), F.col("v").alias("real"), "features")
    null = found.filter("s >= 0").select(F.lit(1).alias("one"), "v")
    out = null_summary(null, own.select("one", "real"), ["one"]).join(null.groupBy("one").agg(F.count("v").alias("surrogates")), "one")
    return out.join(own.select("one", "features"), "one").drop("one")


def rule_covariate(means: DataFrame, rule_genes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, lr_name, value): mean expression of a rule's ligand and receptor genes, each counted once."""
    genes = rule_genes.select("lr_name", "gene").distinct()
    return means.join(F.broadcast(genes), "gene").groupBy(*by, "lr_name").agg(F.avg("value").alias("value"))


def first_component(rows: DataFrame, unit: str = "region", rounds: int = 40) -> DataFrame:
    """(unit, score): first principal component of the units' standardised profiles (unit, gene, value), a missing gene
    being a zero; constant genes are left out, and no profile that varies gives no rows. The sign is that which makes
    the first unit's score positive (or zero).

    The products of all pairs of units come from a join on the gene, of what is not zero, and two sums that put the means
    right. That matrix, over its trace, is squared until it has one direction left, which takes some ten rounds: a
    round's rest is the square of the last one's. What is shuffled is pairs of units; no task holds the profiles."""
    known = stored(rows.groupBy(unit, "gene").agg(F.avg("value").alias("v")).filter("v <> 0"))
    units = stored(rows.select(unit).distinct())
    n = units.count()
    genes = known.groupBy("gene").agg((F.sum("v") / n).alias("m"), F.sum(F.col("v") * F.col("v")).alias("q")).withColumn("var", F.col("q") / n - F.col("m") * F.col("m"))
    genes = stored(genes.filter("var > 1e-24 AND var > 1e-14 * q").select("gene", "m", "var"))
    own = stored(known.join(genes, "gene").select(unit, "gene", (F.col("v") / F.sqrt("var")).alias("z"), (F.col("m") / F.sqrt("var")).alias("mz")))
    base = genes.agg(F.sum(F.col("m") * F.col("m") / F.col("var"))).first()[0]
    if base is None:
        return units.select(unit, F.lit(0.0).alias("score")).limit(0)
    shift = units.join(own.groupBy(unit).agg(F.sum(F.col("z") * F.col("mz")).alias("b")), unit, "left").select(unit, F.coalesce("b", F.lit(0.0)).alias("b"))
    products = own.select(F.col(unit).alias("i"), "gene", "z").join(own.select(F.col(unit).alias("j"), "gene", F.col("z").alias("y")), "gene").groupBy("i", "j").agg(F.sum(F.col("z") * F.col("y")).alias("a"))
    grid = shift.select(F.col(unit).alias("i"), F.col("b").alias("bi")).crossJoin(shift.select(F.col(unit).alias("j"), F.col("b").alias("bj")))  # the matrix itself
    gram = stored(grid.join(products, ["i", "j"], "left").select("i", "j", (F.coalesce("a", F.lit(0.0)) - F.col("bi") - F.col("bj") + F.lit(base)).alias("g")))
    trace = lambda m: m.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("g")))).first()[0]
    now = stored(gram.withColumn("g", F.col("g") / F.lit(trace(gram))))
    for _ in range(rounds):
        square = stored(now.select("i", F.col("j").alias("k"), "g").join(now.select(F.col("i").alias("k"), "j", F.col("g").alias("h")), "k").groupBy("i", "j").agg(F.sum(F.col("g") * F.col("h")).alias("g")))
        whole = trace(square)
        now = square.withColumn("g", F.col("g") / F.lit(whole))
        if whole > 1 - 1e-14:
            break
    top = now.filter("i = j").agg(F.max_by("i", "g").alias("j"))
    axis = now.join(top, "j").select(F.col("i").alias(unit), "g")
    norm = axis.agg(F.sqrt(F.sum(F.col("g") * F.col("g")))).first()[0]
    axis = stored(axis.select(unit, (F.col("g") / norm).alias("u")))
    two = gram.join(axis.select(F.col(unit).alias("i"), F.col("u").alias("ui")), "i").join(axis.select(F.col(unit).alias("j"), F.col("u").alias("uj")), "j")
    length = two.agg(F.sqrt(F.sum(F.col("g") * F.col("ui") * F.col("uj")))).first()[0]
    first = axis.agg(F.min_by("u", unit)).first()[0]
    return axis.select(unit, (F.col("u") * length * (1.0 if first >= 0 else -1.0)).alias("score"))
