"""Models: boosted trees per held-out region, draws from their parameters, variance partition, orthogonal scores, SHAP.

Tree training is Spark ML's; the numerical kernels are NumPy inside grouped pandas functions, one outcome or fold a
group, whose rows are subjects or edges of one fold."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import hash_key, hash_number

FOLDS_AT_A_TIME = 8


def split_validation(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """rows with is_valid: whether the hash of the key falls in the share kept for early stopping."""
    return rows.withColumn("is_valid", hash_number(hash_key(seed, key)) % 10_000 < int(share * 10_000))


def train_trees(rows: DataFrame, features: Sequence[str], y: str, *, rounds: int = 40, depth: int = 4, rate: float = 0.1, loss: str = "squared", valid: str | None = "is_valid", seed: int = 42):
    """A boosted-tree model of y; rows marked in `valid` stop it early. loss is squared or absolute."""
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    model = GBTRegressor(featuresCol="_x", labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=rate, lossType=loss, seed=seed)
    return (model.setValidationIndicatorCol(valid) if valid else model).fit(data)


def predict(model, rows: DataFrame, features: Sequence[str], out: str = "y_hat") -> DataFrame:
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    return model.transform(data).withColumnRenamed("prediction", out).drop("_x")


def fold_models(rows: DataFrame, features: Sequence[str], folds: Sequence[str], y: str = "y_t", **options) -> list:
    """A model per fold of its train rows, a share of which stops it early; some folds' Spark jobs run at a time."""

    def fit(fold: str):
        own = rows.filter((F.col("fold") == fold) & ~F.col("is_test"))
        return train_trees(split_validation(own, "edge_idx", 0.15, 42), features, y, **options)

    with ThreadPoolExecutor(FOLDS_AT_A_TIME) as pool:
        return list(pool.map(inheritable_thread_target(fit), folds))


def region_folds(rows: DataFrame, features: Sequence[str], folds: Sequence[str], y: str = "y_t", **options) -> tuple[DataFrame, DataFrame]:
    """Train on the other edges and predict those that touch each region: (predictions, gains). rows: fold rows with
    is_test; the driver only loops over folds, whose models are Spark jobs."""
    predictions = gains = None
    for fold, model in zip(folds, fold_models(rows, features, folds, y, **options), strict=True):
        p = predict(model, rows.filter((F.col("fold") == fold) & F.col("is_test")), features)
        g = rows.sparkSession.createDataFrame([(fold, f, float(x)) for f, x in zip(features, model.featureImportances.toArray(), strict=True)], "fold string, feature string, gain double")
        predictions, gains = (p, g) if predictions is None else (predictions.unionByName(p), gains.unionByName(g))
    return predictions, gains


def parameter_draws(n: int, seed: int) -> list[dict]:
    """n reproducible draws from the search space: depth, rate (by its logarithm), rounds."""
    rng = np.random.default_rng(seed)
    return [{"depth": int(rng.integers(2, 6)), "rate": float(np.exp(rng.uniform(np.log(0.03), np.log(0.3)))), "rounds": int(rng.integers(10, 40))} for _ in range(n)]


TRIAL = "trial int, depth int, rate double, rounds int, metric string, micro double, macro double, folds int"


def search_parameters(rows: DataFrame, features: Sequence[str], folds: Sequence[str], journal: str, *, n: int, seed: int, metric: str = "mae", loss: str = "squared", y: str = "y_t", most: int | None = None) -> DataFrame:
    """The journal of a parameter search, a written table of TRIAL: each of n draws is trained and evaluated on every fold,
    and its row appended when it's done. Trials that the journal has already are not run again, so a search that was
    broken off goes on where it stopped; most bounds the trials of this call."""
    from . import validation as val

    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(journal)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    done = {r["trial"] for r in spark.read.schema(TRIAL).parquet(journal).select("trial").collect()} if held else set()
    todo = [(i, draw) for i, draw in enumerate(parameter_draws(n, seed)) if i not in done]
    for i, draw in todo[:most]:
        predictions, _ = region_folds(rows, features, folds, y, loss=loss, **draw)
        per_fold = val.metrics(predictions, ["fold"], y=y)
        found = val.micro_macro(per_fold, metric).first()
        row = (i, draw["depth"], draw["rate"], draw["rounds"], metric, found["micro"], found["macro"], len(folds))
        spark.createDataFrame([row], TRIAL).coalesce(1).write.mode("append").parquet(journal)
    return spark.read.schema(TRIAL).parquet(journal)


def best_trial(journal: DataFrame, by: str = "macro") -> DataFrame:
    """The trial of the journal with the least error, the first of equals."""
    return journal.orderBy(by, "trial").limit(1)


def chosen_regions(regions: DataFrame, n: int, seed: int) -> DataFrame:
    """n regions in hash order, all where there are no more."""
    return regions.select("region").distinct().withColumn("_k", hash_key(seed, "region")).orderBy("_k", "region").limit(n).select("region")


def _ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float, np.ndarray]:
    mx, my = x.mean(axis=0), y.mean()
    xc = x - mx
    if x.shape[1] > x.shape[0]:
        beta = xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(len(x)), y - my)
    else:
        beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - my))
    return beta, my, mx


def held_out_r2(x: np.ndarray, y: np.ndarray, folds: np.ndarray, alphas: Sequence[float]) -> float:
    """Pooled R2 of ridge predictions of held-out folds; the penalty is chosen inside each train part by its own folds."""
    out = np.zeros(len(y))
    for f in np.unique(folds):
        train = folds != f
        inner = np.arange(train.sum()) % 3
        misses = []
        for a in alphas:
            miss = 0.0
            for g in range(3):
                b, my, mx = _ridge(x[train][inner != g], y[train][inner != g], a)
                miss += float((((x[train][inner == g] - mx) @ b + my - y[train][inner == g]) ** 2).sum())
            misses.append(miss)
        b, my, mx = _ridge(x[train], y[train], alphas[int(np.argmin(misses))])
        out[~train] = (x[~train] - mx) @ b + my
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - out) ** 2).sum() / total) if total > 0 else float("nan")


def _folds(n: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(np.arange(n) % k)


def variance_partition(rows: DataFrame, d: Sequence[str], w: Sequence[str], *, folds: int = 5, alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0), seed: int = 7, n_perm: int = 0) -> DataFrame:
    """(outcome, n, r2_full, r2_d, r2_w, unique_d, unique_w, shared, p) of rows (outcome, y, d columns, w columns); the
    three parts add up to r2_full. With n_perm, p compares unique_d with rows of d permuted, one added above and below."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=["y", *d, *w]).sort_values(["y", *d, *w])
        y, dx, wx = own["y"].to_numpy(float), own[list(d)].to_numpy(float), own[list(w)].to_numpy(float)
        scale = lambda m: (m - m.mean(axis=0)) / np.where(m.std(axis=0) > 0, m.std(axis=0), 1)
        dx, wx, at = scale(dx), scale(wx), _folds(len(y), folds, seed)
        full, rd, rw = (held_out_r2(m, y, at, alphas) for m in (np.hstack([dx, wx]), dx, wx))
        p = None
        if n_perm:
            rng = np.random.default_rng(seed + 1)
            null = [held_out_r2(np.hstack([dx[rng.permutation(len(y))], wx]), y, at, alphas) - rw for _ in range(n_perm)]
            p = (1 + sum(x >= full - rw for x in null)) / (1 + n_perm)
        return pd.DataFrame([[key[0], len(y), full, rd, rw, full - rw, full - rd, rd + rw - full, p]], columns=["outcome", "n", "r2_full", "r2_d", "r2_w", "unique_d", "unique_w", "shared", "p"]).astype({"p": float})

    return rows.groupBy("outcome").applyInPandas(work, "outcome string, n long, r2_full double, r2_d double, r2_w double, unique_d double, unique_w double, shared double, p double").withColumn("p", F.nanvl("p", F.lit(None)))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    mx, my = x.mean(axis=0), y.mean()
    xc, r = x - mx, y - my
    beta, norms = np.zeros(x.shape[1]), (xc**2).sum(axis=0)
    for _ in range(rounds):
        before = beta.copy()
        for j in np.flatnonzero(norms > 0):
            rho = xc[:, j] @ r + norms[j] * beta[j]
            new = np.sign(rho) * max(0.0, abs(rho) - penalty * len(y)) / norms[j]
            r += xc[:, j] * (beta[j] - new)
            beta[j] = new
        if np.abs(beta - before).max() < 1e-9:
            break
    return beta, my - mx @ beta


def orthogonal_score(rows: DataFrame, d: str, w: Sequence[str], *, folds: int = 5, n_boot: int = 200, seed: int = 7, penalties: Sequence[float] = (0.001, 0.01, 0.1, 1.0)) -> DataFrame:
    """(outcome, n, theta, lo, hi): effect of d on y after taking w out of both by cross-fitted lasso; the interval comes
    from resampling residual pairs without fitting anew."""

    def residual(x: np.ndarray, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t))
        for f in np.unique(at):
            train = at != f
            half = np.arange(train.sum()) % 2 == 0
            misses = []
            for p in penalties:
                b, c = _lasso(x[train][half], t[train][half], p)
                misses.append(((x[train][~half] @ b + c - t[train][~half]) ** 2).sum())
            b, c = _lasso(x[train], t[train], penalties[int(np.argmin(misses))])
            out[~train] = t[~train] - (x[~train] @ b + c)
        return out

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=["y", d, *w]).sort_values(["y", d, *w])
        x, at = own[list(w)].to_numpy(float), _folds(len(own), folds, seed)
        ry, rd = residual(x, own["y"].to_numpy(float), at), residual(x, own[d].to_numpy(float), at)
        slope = lambda a, b: float(a @ b / (a @ a)) if a @ a > 0 else float("nan")
        rng = np.random.default_rng(seed + 2)
        boots = [slope(rd[i], ry[i]) for i in (rng.integers(0, len(ry), len(ry)) for _ in range(n_boot))]
        return pd.DataFrame([[key[0], len(ry), slope(rd, ry), *np.nanquantile(boots, [0.025, 0.975])]], columns=["outcome", "n", "theta", "lo", "hi"])

    return rows.groupBy("outcome").applyInPandas(work, "outcome string, n long, theta double, lo double, hi double")


def reduced(rows: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """rows with the first k principal components of columns (pc_0 and on): columns without any value are dropped, gaps
    filled with the column's mean."""
    from pyspark.ml.feature import PCA, Imputer
    from pyspark.ml.functions import vector_to_array

    counts = rows.agg(*(F.count(c).alias(c) for c in columns)).first()
    own = [c for c in columns if counts[c]]
    k = min(k, len(own), max(1, rows.count() - 1))
    full = Imputer(inputCols=own, outputCols=[f"_{c}" for c in own], strategy="mean").fit(rows).transform(rows)
    data = VectorAssembler(inputCols=[f"_{c}" for c in own], outputCol="_x").transform(full)
    out = PCA(k=k, inputCol="_x", outputCol="_pc").fit(data).transform(data).withColumn("_pc", vector_to_array("_pc"))
    return out.select(*rows.columns, *(F.col("_pc")[i].alias(f"pc_{i}") for i in range(k)))


def _tree(node) -> dict:
    """A Spark ML tree node as plain data: cover (rows), and value or feature, threshold, left, right."""
    if node.subtreeDepth() == 0:
        return {"n": float(node.impurityStats().count()), "v": float(node.prediction())}
    s = node.split()
    return {"n": float(node.impurityStats().count()), "f": int(s.featureIndex()), "t": float(s.threshold()), "l": _tree(node.leftChild()), "r": _tree(node.rightChild())}


def _leaves(node: dict, path: tuple = ()) -> list[tuple[float, dict]]:
    """(value, {feature: (share of rows, [(threshold, left)])}) of each leaf: of a feature's conditions on the way there,
    the share of rows that took all of them, each counted among the rows that reached it."""
    if "v" in node:
        own: dict[int, tuple[float, list]] = {}
        for f, threshold, left, share in path:
            z, tests = own.get(f, (1.0, []))
            own[f] = (z * share, [*tests, (threshold, left)])
        return [(node["v"], own)]
    step = lambda child, left: _leaves(child, (*path, (node["f"], node["t"], left, child["n"] / node["n"])))
    return step(node["l"], True) + step(node["r"], False)


def shapley_values(tree: dict, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of one tree for the rows of x, path-dependent: what a tree doesn't know is averaged by the rows
    that went either way. A leaf is reached by a set of known features with a probability that is a product over the
    features on its way, so the sum over all sets has a polynomial's coefficients: d^3 steps for d features, for all
    rows at once."""
    from math import factorial

    phi = np.zeros(x.shape)
    for value, own in _leaves(tree):
        features, d = list(own), len(own)
        known = {f: np.all([(x[:, f] <= t) == left for t, left in tests], axis=0).astype(float) for f, (_, tests) in own.items()}
        for f in features:
            sizes = np.zeros((d, len(x)))  # by the size of the set: sum over sets of the other features
            sizes[0] = 1.0
            for g in features:
                if g != f:
                    sizes[1:], sizes[0] = sizes[1:] * own[g][0] + sizes[:-1] * known[g], sizes[0] * own[g][0]
            weights = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
            phi[:, f] += value * (known[f] - own[f][0]) * (weights @ sizes)
    return phi


def tree_shap(model, rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, feature, value, effect): exact Shapley values of a boosted-tree model (see shapley_values)."""
    trees = [(_tree(t._call_java("rootNode")), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    packed = json.dumps(trees)

    def work(batches):
        own = json.loads(packed)
        for pdf in batches:
            x = pdf[list(features)].to_numpy(float)
            phi = sum((w * shapley_values(tree, x) for tree, w in own), np.zeros(x.shape))
            yield pd.concat([pdf[list(keys)].assign(feature=f, value=x[:, j], effect=phi[:, j]) for j, f in enumerate(features)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.select(*keys, *(F.col(f).cast("double") for f in features)).mapInPandas(work, f"{kinds}, feature string, value double, effect double")
