"""Region maps: atlases, centroids, distances, projections, unique spatial nodes, log marginals and null summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .biology import plus_list


def region_bridge(table: DataFrame, own: str, other: str, known: DataFrame) -> DataFrame:
    """(region, area): every pair of members of the two plus-joined lists of a row whose area is known (area)."""
    pairs = table.select(F.explode(plus_list(own)).alias("region"), plus_list(other).alias("_areas")).select("region", F.explode("_areas").alias("area"))
    return pairs.distinct().join(F.broadcast(known.select("area").distinct()), "area", "left_semi").select("region", "area")


def aligned_sizes(areas: DataFrame, sizes: DataFrame) -> DataFrame:
    """(area, voxels), 0 for areas without a count."""
    return areas.select("area").distinct().join(sizes, "area", "left").select("area", F.coalesce("voxels", F.lit(0.0)).alias("voxels"))


def area_centroids(voxels: DataFrame, affine: Sequence[Sequence[float]]) -> DataFrame:
    """(area, x, y, z): mean voxel index of each label above zero, carried to space by the 4 x 4 affine; labels that
    aren't whole raise."""
    whole = F.when(F.col("label") == F.floor("label"), F.col("label").cast("long")).otherwise(F.raise_error(F.lit("labels must be whole")).cast("long"))
    means = voxels.filter("label <> 0").groupBy(whole.alias("area")).agg(F.avg("i").alias("i"), F.avg("j").alias("j"), F.avg("k").alias("k"))
    axis = lambda r: F.col("i") * affine[r][0] + F.col("j") * affine[r][1] + F.col("k") * affine[r][2] + affine[r][3]
    return means.select("area", axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"))


def shares(bridge: DataFrame, sizes: DataFrame | None, key: str = "region") -> DataFrame:
    """(key, area, p): how much of a region each of its areas is: equally, or by size where sizes are given and their sum
    is above zero."""
    n = F.count("*").over(Window.partitionBy(key))
    if sizes is None:
        return bridge.select(key, "area", (1.0 / n).alias("p"))
    rows = bridge.join(F.broadcast(sizes), "area", "left").withColumn("voxels", F.coalesce("voxels", F.lit(0.0)))
    total = F.sum("voxels").over(Window.partitionBy(key))
    return rows.select(key, "area", F.when(total > 0, F.col("voxels") / total).otherwise(1.0 / n).alias("p"))


def weighted_centroids(p: DataFrame, centroids: DataFrame, key: str = "region") -> DataFrame:
    mean = lambda c: (F.sum(F.col("p") * F.col(c)) / F.sum("p")).alias(c)
    return p.join(F.broadcast(centroids), "area").groupBy(key).agg(mean("x"), mean("y"), mean("z"))


def distances(points: DataFrame, key: str = "region") -> DataFrame:
    """(src, tgt, d) of all ordered pairs; points are a dimension of regions."""
    a = points.select(F.col(key).alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1"))
    b = F.broadcast(points.select(F.col(key).alias("tgt"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2")))
    sq = lambda c: F.pow(F.col(f"{c}1") - F.col(f"{c}2"), F.lit(2.0))
    return a.join(b).select("src", "tgt", F.sqrt(sq("x") + sq("y") + sq("z")).alias("d"))


def distance_faults(d: DataFrame, n: int, positive: bool = False) -> DataFrame:
    """One row: what is wrong with a distance table, each a count: missing pairs, values that are not finite or below
    zero, diagonals that aren't zero, pairs that differ from their mirror, and with positive, zeros off the diagonal."""
    back = d.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("d").alias("back"))
    both = d.join(back, ["src", "tgt"], "left")
    count = lambda c: F.count(F.when(c, 1))
    bad = F.col("d").isNull() | F.isnan("d") | (F.col("d") < 0) | (F.col("d") == float("inf"))
    return both.agg(
        (F.lit(n * n) - F.count("*")).alias("missing"), count(bad).alias("invalid"), count((F.col("src") == F.col("tgt")) & (F.abs("d") > 1e-8)).alias("diagonal"),
        count(F.col("back").isNull() | (F.abs(F.col("d") - F.col("back")) > 1e-8)).alias("asymmetric"), count(F.lit(positive) & (F.col("src") != F.col("tgt")) & (F.col("d") <= 0)).alias("zero"),
    )


def projected(conn: DataFrame, p: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, tgt, v) between regions from (by, src, tgt, v) between areas: P C P', a sparse product as two joins and a
    sum; missing cells are zeros."""
    rows = p.select(F.col("region").alias("r1"), F.col("area").alias("src"), F.col("p").alias("p1"))
    cols = p.select(F.col("region").alias("r2"), F.col("area").alias("tgt"), F.col("p").alias("p2"))
    out = conn.join(F.broadcast(rows), "src").join(F.broadcast(cols), "tgt")
    return out.groupBy(*by, F.col("r1").alias("src"), F.col("r2").alias("tgt")).agg(F.sum(F.col("p1") * F.col("v") * F.col("p2")).alias("v"))


def without_nan(v: str) -> Column:
    return F.nanvl(F.coalesce(F.col(v), F.lit(0.0)), F.lit(0.0))


def unique_nodes(bridge: DataFrame) -> DataFrame:
    """(group_id, region, areas): regions with the very same areas share a node; ids count from 0 by the least region."""
    sets = bridge.groupBy("region").agg(F.array_sort(F.collect_set("area")).alias("areas"))
    ids = sets.groupBy("areas").agg(F.min("region").alias("first")).withColumn("group_id", F.row_number().over(Window.orderBy("first")) - 1)
    return sets.join(F.broadcast(ids), "areas").select("group_id", "region", "areas")


def to_unique(values: DataFrame, nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group_id, v): mean of member regions' values weighted by the voxels of their areas, equally where there are none."""
    w = nodes.select("group_id", "region", F.explode("areas").alias("area")).join(F.broadcast(sizes), "area", "left").groupBy("group_id", "region").agg(F.sum(F.coalesce("voxels", F.lit(0.0))).alias("w"))
    rows = w.join(values, "region")
    total = F.sum("w")
    return rows.groupBy("group_id").agg(F.when(total > 0, F.sum(F.col("w") * F.col("v")) / F.when(total > 0, total)).otherwise(F.avg("v")).alias("v"))


def from_unique(values: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("group_id", "region").join(F.broadcast(values), "group_id").select("region", *[c for c in values.columns if c != "group_id"])


def log_marginals(rows: DataFrame, regions: DataFrame, eps: float = 1e-3) -> DataFrame:
    """(feature, side, region, v): mean log of values (at least eps) by source and by target, self edges left out, and the
    feature's overall mean as side 'all'. A region without edges has the overall mean. One pass, by grouping sets."""
    x = rows.filter("src_region <> tgt_region").withColumn("x", F.log(F.greatest(F.col("value"), F.lit(eps))))
    sets = [["feature", "src_region"], ["feature", "tgt_region"], ["feature"]]
    means = x.groupingSets(sets, "feature", "src_region", "tgt_region").agg(F.avg("x").alias("v"), F.grouping_id().alias("g"))
    base = means.filter("g = 3").select("feature", F.col("v").alias("base"))
    sides = means.filter("g <> 3").select("feature", F.when(F.col("g") == 1, "source").otherwise("target").alias("side"), F.coalesce("src_region", "tgt_region").alias("region"), "v")
    grid = base.join(F.broadcast(regions.select("region").distinct())).withColumn("side", F.explode(F.array(F.lit("source"), F.lit("target"))))
    full = grid.join(sides, ["feature", "side", "region"], "left").select("feature", "side", "region", F.coalesce("v", "base").alias("v"))
    return full.unionByName(base.select("feature", F.lit("all").alias("side"), F.lit(None).cast("string").alias("region"), F.col("base").alias("v")))


def reconstructed(marginals: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, edge_idx, value): exp of the source's and target's log means less the overall mean."""
    side = lambda s, r, n: marginals.filter(F.col("side") == s).select("feature", F.col("region").alias(r), F.col("v").alias(n))
    base = marginals.filter("side = 'all'").select("feature", F.col("v").alias("b"))
    out = edges.join(side("source", "src_region", "l"), "src_region").join(side("target", "tgt_region", "r"), ["feature", "tgt_region"]).join(F.broadcast(base), "feature")
    return out.select("feature", "edge_idx", F.exp(F.col("l") + F.col("r") - F.col("b")).alias("value"))


def null_summary(null: DataFrame, real: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, real, p, z, mean, sd, median): one-sided p with one added above and below, over finite null values."""
    fine = null.filter(F.col("v").isNotNull() & ~F.isnan("v")).join(F.broadcast(real), list(by))
    out = fine.groupBy(*by).agg(F.first("real").alias("real"), ((F.sum((F.col("v") >= F.col("real")).cast("long")) + 1) / (F.count("*") + 1.0)).alias("p"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.percentile("v", 0.5).alias("median"))
    return out.withColumn("z", F.when(F.col("sd") > 0, (F.col("real") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))))


def pseudo_cells(abundance: DataFrame, expression: DataFrame, real: DataFrame) -> DataFrame:
    """(region, cell_type, gene, value): product of abundance and expression, neither below zero, for the pairs of region
    and type that real cells have."""
    rows = abundance.join(F.broadcast(real.select("region", "cell_type").distinct()), ["region", "cell_type"], "left_semi").join(expression, "region")
    return rows.select("region", "cell_type", "gene", (F.greatest("value", F.lit(0.0)) * F.greatest("abundance", F.lit(0.0))).alias("value"))
