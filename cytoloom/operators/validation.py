"""Leave-one-region-out folds, target transforms, metrics, edge assignment, and paired comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.resample import axis
from ..functions.special import signed_rank_two_sided


def fold_rows(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(fold, edge columns, is_test): an edge is a fold's test row when it touches the fold's region."""
    folds = regions.select(F.col("region").alias("fold")).distinct()
    return edges.join(F.broadcast(folds)).withColumn("is_test", (F.col("src_region") == F.col("fold")) | (F.col("tgt_region") == F.col("fold")))


def usable(y: str, data_type: str, eps: float = 0.0) -> Column:
    """Rows with a usable target: above eps for SC, unlike eps for FC."""
    return F.col(y).isNotNull() & ((F.col(y) > eps) if data_type == "SC" else (F.col(y) != eps))


def transformed(rows: DataFrame, how: str = "none", data_type: str = "FC") -> DataFrame:
    """Fold rows (fold, y, is_test) with y_raw and y_t; folds without train or test rows go.

    log1p of FC first moves a fold's least target, train and test alike, to zero (and returns the moved values as raw);
    ecdf is the share of the fold's train targets that are no greater."""
    by_fold = Window.partitionBy("fold")
    both = (F.count(F.when(F.col("is_test"), 1)).over(by_fold) > 0) & (F.count(F.when(~F.col("is_test"), 1)).over(by_fold) > 0)
    rows = rows.withColumn("_both", both).filter("_both").drop("_both")
    if how == "none":
        return rows.withColumns({"y_raw": F.col("y"), "y_t": F.col("y")})
    if how == "log1p":
        moved = rows.withColumn("y_raw", F.col("y") - F.least(F.lit(0.0), F.min("y").over(by_fold)) if data_type == "FC" else F.col("y"))
        return moved.withColumn("y_t", F.when(F.col("y_raw") >= 0, F.log1p("y_raw")).otherwise(F.raise_error(F.lit("log1p needs targets of zero or more")).cast("double")))
    if how != "ecdf":
        raise ValueError(f"unknown transform {how!r}")
    upto = by_fold.orderBy("y").rangeBetween(Window.unboundedPreceding, 0)
    train = F.count(F.when(~F.col("is_test"), 1))
    return rows.withColumns({"y_raw": F.col("y"), "y_t": train.over(upto) / train.over(by_fold)})


def unique_edges(candidates: DataFrame) -> DataFrame:
    """One row per edge of (fold, edge_idx, src_region, tgt_region, y, y_hat): the fold of its source before that of its
    target before any other; ties go to the first fold by name."""
    rank = F.when(F.col("fold") == F.col("src_region"), 0).when(F.col("fold") == F.col("tgt_region"), 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("edge_idx").orderBy(rank, "fold"))
    return candidates.withColumn("_n", first).filter("_n = 1").drop("_n")


def fold_weights(unique: DataFrame) -> DataFrame:
    return unique.groupBy("fold").agg(F.count("*").alias("edges"))


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """(candidates, edges): how many edges have one, two, three or more."""
    return candidates.groupBy("edge_idx").count().groupBy(F.least(F.lit(3), F.col("count")).cast("int").alias("candidates")).agg(F.count("*").alias("edges"))


def pseudo_huber(y: str, y_hat: str, delta: float = 1.0) -> Column:
    r = (F.col(y) - F.col(y_hat)) / delta
    return delta * delta * (F.sqrt(1 + r * r) - 1)


def metrics(rows: DataFrame, by: Sequence[str] = (), y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """(by, n, rmse, mae, huber, r2, pearson, spearman); r2 is null where the targets are constant."""
    d = F.col(y) - F.col(y_hat)
    ranked = rows.withColumns({"_ry": S.average_rank(y, by), "_rh": S.average_rank(y_hat, by)})
    spread = F.var_pop(y)
    r2 = F.when(spread > 1e-12, 1 - F.avg(d * d) / F.when(spread > 1e-12, spread))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(pseudo_huber(y, y_hat)).alias("huber"), r2.alias("r2"), S.correlation(y, y_hat).alias("pearson"), S.correlation("_ry", "_rh").alias("spearman"))


def micro_macro(per_fold: DataFrame, metric: str) -> DataFrame:
    """(micro, macro): weighted by rows, a root of means for rmse, and plain over folds."""
    m, n = F.col(metric), F.col("n")
    micro = F.sqrt(F.sum(n * m * m) / F.sum(n)) if metric == "rmse" else F.sum(n * m) / F.sum(n)
    return per_fold.agg(micro.alias("micro"), F.avg(m).alias("macro"))


def fold_bootstrap(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """(metric, lo, hi) for rmse and mae of n resamples of whole folds. Sums per fold are taken first, so a resample
    moves one row per fold, not its rows."""
    d = F.col("y") - F.col("y_hat")
    sums = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(d * d).alias("sq"), F.sum(F.abs(d)).alias("ab"))
    at = sums.withColumns({"_i": F.row_number().over(Window.orderBy("fold")) - 1, "_n": F.count("*").over(Window.partitionBy())})
    picks = axis(at.select(F.col("_i").alias("_k"), "_n"), n, "boot").withColumn("_i", (S.hash_number(S.hash_key(seed, "boot", "_k")) % F.col("_n")).cast("int"))
    boots = picks.join(F.broadcast(at.drop("_n")), "_i").groupBy("boot").agg(F.sqrt(F.sum("sq") / F.sum("n")).alias("rmse"), (F.sum("ab") / F.sum("n")).alias("mae"))
    long = boots.unpivot(["boot"], ["rmse", "mae"], "metric", "v")
    return long.groupBy("metric").agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))


def signed_ranks(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, w_plus, w_minus): sums of average ranks of absolute differences; zero and missing differences are dropped,
    and under three leave nulls."""
    d = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.round(F.col(a) - F.col(b), 12)).filter("_d <> 0").withColumn("_a", F.abs("_d"))
    ranked = d.withColumn("_r", S.average_rank("_a", by))
    enough = F.count("*") >= 3
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(enough, F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0))).alias("w_plus"), F.when(enough, F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0))).alias("w_minus"))


def signed_rank_test(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """signed_ranks with the two-sided p of the exact or normal null."""

    def work(batches):
        for pdf in batches:
            pdf["p"] = [None if w != w or w is None else signed_rank_two_sided(float(w), int(n)) for w, n in zip(pdf["w_plus"], pdf["n"], strict=True)]
            yield pdf.astype({"p": float})

    found = signed_ranks(pairs, by, a, b)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInPandas(work, kinds + ", p double").withColumn("p", F.nanvl("p", F.lit(None)))


def paired_runs(rows: DataFrame, key: str = "region", run: str = "subset", value: str = "value") -> DataFrame:
    """(key, run_a, run_b, a, b) of every pair of runs with a common key."""
    x = rows.select(key, F.col(run).alias("run_a"), F.col(value).alias("a"))
    y = rows.select(key, F.col(run).alias("run_b"), F.col(value).alias("b"))
    return x.join(y, key).filter("run_a < run_b")


def relative_to(rows: DataFrame, reference: str, key: str = "region", run: str = "subset", value: str = "value") -> DataFrame:
    """Each run's value over the reference run's at the same key; null where that is zero."""
    base = rows.filter(F.col(run) == reference).select(key, F.col(value).alias("_base"))
    return rows.filter(F.col(run) != reference).join(base, key).select(key, run, F.expr(f"try_divide({value}, _base)").alias("relative"))


def pareto_front(trials: DataFrame, first: str = "micro", second: str = "macro") -> DataFrame:
    """Trials that none beats in one objective without losing in the other, by one ordered pass instead of a self-join."""
    before = Window.orderBy(first, second).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(first, second)
    seen = trials.withColumn("_best", F.min(second).over(before)).withColumn("_tie", F.min(F.when(F.col("_best").isNull() | (F.col(second) < F.col("_best")), 0).otherwise(1)).over(same))
    return seen.filter("_tie = 0").drop("_best", "_tie")
