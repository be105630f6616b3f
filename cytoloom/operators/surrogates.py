"""Surrogate maps with a map's spatial autocorrelation, sets of them made once each, and null features built from them.

A surrogate's draws are md5 of seed, set, map and region, so neither partitions nor the sets made beside it change it but
for the rounding of sums."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PORTIONS = (10, 20, 30, 40, 50, 60, 70, 80, 90)
CELLS = 4_000_000  # differences of pairs held at a time


class Geometry:
    """What surrogates need of the distances between regions: the pairs under the `reach` quantile with their weight in each
    lag of the variogram, and for each portion (percent of regions) the weights of a region's nearest others."""

    def __init__(self, names: Sequence[str], dist: np.ndarray, lags: int, reach: float, portions: Sequence[int]):
        n = len(names)
        if n < 3 or dist.shape != (n, n) or not np.isfinite(dist).all():
            raise ValueError("surrogates need a finite distance between each two of at least three regions")
        self.names = list(names)
        i, j = np.triu_indices(n, 1)
        far = dist[i, j]
        near = far < np.quantile(far, reach)
        if near.any():
            i, j, far = i[near], j[near], far[near]
        cuts = np.linspace(far.min(), far.max(), lags)
        width = 3 * (cuts[1] - cuts[0]) or 1.0
        weights = np.exp(-((2.68 * np.abs(far - cuts[:, None])) ** 2) / (2 * width * width))
        self.i, self.j, self.weights = i, j, (weights / weights.sum(axis=1, keepdims=True)).T
        others = dist.copy()
        np.fill_diagonal(others, -1.0)
        order = np.argsort(others, axis=1, kind="stable")[:, 1:]
        self.kernels = []
        for portion in portions:
            own = order[:, : max(1, portion * n // 100)]
            d = np.take_along_axis(dist, own, axis=1)
            w = np.exp(-d / np.maximum(d[:, -1:], 1e-12))
            kernel = np.zeros((n, n))
            np.put_along_axis(kernel, own, w / w.sum(axis=1, keepdims=True), axis=1)
            self.kernels.append(kernel.T)

    def variograms(self, x: np.ndarray) -> np.ndarray:
        """A row of smoothed half squared differences by lag for each row of x."""
        step = max(1, CELLS // len(self.i))
        return np.vstack([0.5 * (x[a : a + step, self.i] - x[a : a + step, self.j]) ** 2 @ self.weights for a in range(0, len(x), step)])


def drawn(seed: int, s: int, name: str, regions: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, noise) of set s of a map: the place of a region in md5 order, and a standard normal number from an md5."""
    keys = [hashlib.md5(f"{seed}_{s}_{name}_{r}".encode()).hexdigest() for r in regions]
    places = np.empty(len(regions), dtype=int)
    places[sorted(range(len(regions)), key=lambda i: (keys[i], i))] = np.arange(len(regions))
    digits = [hashlib.md5(f"{seed}_{s}_{name}_{r}_noise".encode()).hexdigest() for r in regions]
    share = lambda d: (int(d, 16) % 1_000_000_000 + 0.5) / 1e9
    noise = np.array([math.sqrt(-2 * math.log(share(d[:15]))) * math.cos(2 * math.pi * share(d[15:30])) for d in digits])
    return places, noise


def surrogates_of(v: np.ndarray, places: np.ndarray, noise: np.ndarray, geometry: Geometry, resample: bool) -> np.ndarray:
    """A surrogate of map v for each row of places and noise."""
    moved, goal = v[places], geometry.variograms(v[None, :])[0]
    best, made = np.full(len(places), np.inf), np.zeros(moved.shape)
    for kernel in geometry.kernels:
        smooth = moved @ kernel
        got = geometry.variograms(smooth)
        off = got - got.mean(axis=1, keepdims=True)
        spread = (off * off).sum(axis=1)
        slope = np.where(spread > 1e-300, off @ (goal - goal.mean()) / np.where(spread > 1e-300, spread, 1.0), 0.0)
        base = goal.mean() - slope * got.mean(axis=1)
        miss = ((goal - base[:, None] - slope[:, None] * got) ** 2).sum(axis=1)
        better = miss < best
        best[better] = miss[better]
        made[better] = (np.sqrt(np.abs(slope))[:, None] * smooth + np.sqrt(np.abs(base))[:, None] * noise)[better]
    if not resample:
        return made - made.mean(axis=1, keepdims=True) + v.mean()
    return np.sort(v)[np.argsort(np.argsort(made, axis=1, kind="stable"), axis=1, kind="stable")]


def surrogate_maps(maps: DataFrame, d: DataFrame, n: int | Sequence[int], seed: int = 0, *, lags: int = 25, reach: float = 0.25, portions: Sequence[int] = PORTIONS, resample: bool = False, block: int = 16, sets: int = 25) -> DataFrame:
    """(map, side, s, region, v): surrogates of each map (map, region, v and, where there are several maps of one draw, side)
    with its spatial autocorrelation; without a side in maps there is none here. n is how many, or which, sets are made.

    Values are permuted and smoothed over the nearest portion of other regions with exponential weights; of the portions
    that is taken whose variogram, after a linear fit, is nearest to the map's, and noise of the fit's intercept is
    added. With resample the map's values are put in the order of the surrogate, else its mean is the map's. All sides
    of a map share draws. d: (src, tgt, d) of every two regions; a map's missing, null or NaN values are the mean of its
    others, repeated ones are averaged, and rows without a map or a region don't count.

    A task works on `block` maps and `sets` sets; the distances reach it as a row a region, by the shuffle, so a task
    holds one table of regions and neither the driver nor a broadcast does."""
    numbers = list(range(n)) if isinstance(n, int) else sorted(set(n))
    sided = "side" in maps.columns
    own = maps.filter(F.col("map").isNotNull() & F.col("region").isNotNull() & F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    own = own.withColumn("side", F.col("side") if sided else F.lit("")).groupBy("map", "side", "region").agg(F.avg(F.col("v").cast("double")).alias("v"))
    blocks = max(1, math.ceil(own.select("map").distinct().count() / block))
    chunks = [numbers[a : a + sets] for a in range(0, len(numbers), sets)] or [[]]
    part = F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1))).alias("chunk")
    rows = own.select(F.pmod(F.xxhash64("map"), F.lit(blocks)).cast("int").alias("block"), part, F.col("map").cast("string").alias("map"), "side", "region", "v")
    lines = d.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("tgt", F.col("d").cast("double").alias("d")))).alias("line"))
    lines = lines.select("src", F.col("line.d").alias("d")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("block", part, "src", "d")

    def work(key: tuple, own: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and chunks[key[1]]:
            lines = lines.sort_values("src")
            if {len(line) for line in lines["d"]} != {len(lines)}:
                raise ValueError("surrogates need a distance between each two regions")
            geometry = Geometry(list(lines["src"]), np.vstack(lines["d"]), lags, reach, portions)
            for name, sides in own.groupby("map", sort=False):
                places, noise = (np.vstack(x) for x in zip(*(drawn(seed, s, name, geometry.names) for s in chunks[key[1]]), strict=True))
                for side, values in sides.groupby("side", sort=False):
                    v = values.set_index("region")["v"].reindex(geometry.names)
                    if v.notna().any():
                        made = surrogates_of(v.fillna(v.mean()).to_numpy(float), places, noise, geometry, resample)
                        out.append((name, side, made.ravel()))
            size = len(chunks[key[1]]) * len(geometry.names)
            sets = np.tile(np.repeat(chunks[key[1]], len(geometry.names)), len(out))
            regions = geometry.names * (len(chunks[key[1]]) * len(out))
            names, sides = ([x[at] for x in out for _ in range(size)] for at in (0, 1))
            if out:
                return pd.DataFrame({"map": names, "side": sides, "s": sets, "region": regions, "v": np.concatenate([x[2] for x in out])})
        return pd.DataFrame()

    keys = ["block", "chunk"]
    found = rows.groupBy(*keys).cogroup(lines.groupBy(*keys)).applyInPandas(work, "map string, side string, s int, region string, v double")
    return found if sided else found.drop("side")


FINISHED = "inputs string, s int"


def inputs_of(maps: DataFrame, d: DataFrame, *settings: object) -> str:
    """A name for maps, distances and settings that changes with any of them, but not with their order or partitions."""
    sums = [df.select(F.xxhash64(*(F.round(c, 9) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes)).cast("decimal(38, 0)").alias("h")).agg(F.count("*"), F.sum("h")).first() for df in (maps, d)]
    return hashlib.md5(repr((*(tuple(map(str, row)) for row in sums), settings)).encode()).hexdigest()


def surrogate_sets(maps: DataFrame, d: DataFrame, wanted: int | Sequence[int], folder: str, seed: int = 0, *, each: int = 50, **options) -> DataFrame:
    """(map, side, region, v, s) of the wanted sets, of maps with sides, in folder/sets, a partition a set. A ledger in
    folder/finished tells the sets that were made from these maps, distances and options; they are not made again. Some
    sets (`each`) are made at a time, their partitions replaced and then entered, so that a run that broke off goes on
    after its last entry, and runs of different sets may follow one another."""
    spark = maps.sparkSession
    numbers = list(range(wanted)) if isinstance(wanted, int) else sorted(set(wanted))
    schema = "map string, side string, region string, v double, s int"
    for name, kind in (("finished", FINISHED), ("sets", schema)):
        spark.createDataFrame([], kind).write.mode("ignore").partitionBy("s").parquet(f"{folder}/{name}")
    inputs = inputs_of(maps, d, seed, sorted(options.items()))
    held = spark.read.schema(FINISHED).parquet(f"{folder}/finished")
    done = {r.s for r in held.filter(F.col("inputs") == inputs).select("s").distinct().collect()}
    todo = [s for s in numbers if s not in done]

    def replace(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("s").parquet(f"{folder}/{name}")

    for a in range(0, len(todo), each):
        own = todo[a : a + each]
        replace(surrogate_maps(maps, d, own, seed, **options).select("map", "side", "region", "v", "s"), "sets")
        replace(spark.createDataFrame([(inputs, s) for s in own], FINISHED), "finished")
    return spark.read.schema(schema).parquet(f"{folder}/sets").filter(F.col("s").isin(numbers))


def null_features(sets: DataFrame, marginals: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, feature, edge_idx, value): exp of a set's source and target maps less the feature's overall mean, for each edge
    (edge_idx, src_region, tgt_region); marginals: (feature, side, region, v), of which side 'all' is used."""
    side = lambda name, r, v: sets.filter(F.col("side") == name).select("s", F.col("map").alias("feature"), F.col("region").alias(r), F.col("v").alias(v))
    base = marginals.filter("side = 'all'").select("feature", F.col("v").alias("b"))
    both = side("source", "src_region", "l").join(base, "feature").join(side("target", "tgt_region", "r"), ["s", "feature"])
    return both.join(edges.select("edge_idx", "src_region", "tgt_region"), ["src_region", "tgt_region"]).select("s", "feature", "edge_idx", F.exp(F.col("l") + F.col("r") - F.col("b")).alias("value"))
