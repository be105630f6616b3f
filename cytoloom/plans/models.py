"""Queries over models and incremental runs. They have no SQL form; tests hold them against properties and brute force."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import models
from ..operators import validation as val
from ..sources import domain
from ..sources.work import cut
from ..streaming.incremental import process_new
from .prediction import edges, regions
from .registry import query

FEATURES = ("ka", "kb", "gap", "product")
#: The most rounds of boosting; the validation rows stop a fold's model before.
ROUNDS = 2000


def fold_rows(spark, sf_dir):
    own = edges(spark, sf_dir).select("edge_idx", "src_region", "tgt_region", "y")
    k = F.col("edge_idx") % 25, F.floor(F.col("edge_idx") / 25)
    own = own.withColumns({"ka": k[0].cast("double"), "kb": k[1].cast("double")}).withColumns({"gap": F.abs(F.col("ka") - F.col("kb")), "product": F.col("ka") * F.col("kb")})
    return cut(val.transformed(val.fold_rows(own, regions(spark, sf_dir))))


def all_folds(rows):
    return [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]


@query("lobo_trees")
def lobo_trees(spark, sf_dir):
    rows = fold_rows(spark, sf_dir)
    predictions, _ = models.region_folds(rows, FEATURES, all_folds(rows), rounds=ROUNDS)
    return val.metrics(predictions.withColumn("y", F.col("y_t")), ["fold"]).select("fold", "n", r6("rmse").alias("rmse"), r6("mae").alias("mae"))


@query("tree_shap_directions")
def tree_shap_directions(spark, sf_dir):
    from ..operators.importance import directionality

    rows = fold_rows(spark, sf_dir)
    folds, effects = all_folds(rows), None
    for fold, model in zip(folds, models.fold_models(rows, FEATURES, folds, rounds=ROUNDS), strict=True):
        found = models.tree_shap(model, rows.filter((F.col("fold") == fold) & F.col("is_test")), FEATURES, ["fold", "edge_idx"])
        effects = found if effects is None else effects.unionByName(found)
    return directionality(effects).select("feature", r6("mean_abs").alias("mean_abs"), r6("r").alias("r"), "direction")


@query("parameter_search")
def parameter_search(spark, sf_dir):
    """Four trials over five regions, as the reference searches over a subset of its regions; then the best."""
    from ..sources.work import shared_folder

    some = [r["region"] for r in models.chosen_regions(regions(spark, sf_dir).select("region"), 5, 42).collect()]
    rows = fold_rows(spark, sf_dir).filter(F.col("fold").isin(some))
    journal = models.search_parameters(rows, FEATURES, some, f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}", n=4, seed=42)
    return models.best_trial(journal).select("trial", "depth", r6("rate").alias("rate"), "rounds", "metric", r6("micro").alias("micro"), r6("macro").alias("macro"), "folds")


def _subjects(spark, sf_dir):
    own = domain.table(spark, sf_dir, "customer").join(F.broadcast(domain.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    own = own.groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("y"), F.count("*").cast("double").alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return own.select(F.col("c_mktsegment").alias("outcome"), "y", "n", "lo", "hi", F.col("c_nationkey").cast("double").alias("k"))


@query("variance_partition")
def variance_partition(spark, sf_dir):
    out = models.variance_partition(_subjects(spark, sf_dir), ["lo", "hi"], ["n", "k"], n_perm=1000)
    return out.select("outcome", "n", *(r6(c).alias(c) for c in ("r2_full", "r2_d", "r2_w", "unique_d", "unique_w", "shared", "p")))


@query("orthogonal_score")
def orthogonal_score(spark, sf_dir):
    return models.orthogonal_score(_subjects(spark, sf_dir), "hi", ["n", "k", "lo"], n_boot=1000).select("outcome", "n", *(r6(c).alias(c) for c in ("theta", "lo", "hi")))


@query("pca_reduced")
def pca_reduced(spark, sf_dir):
    out = models.reduced(_subjects(spark, sf_dir), ["n", "lo", "hi", "k"], 2)
    return out.groupBy("outcome").agg(r6(F.stddev_pop("pc_0")).alias("sd_0"), r6(F.stddev_pop("pc_1")).alias("sd_1"))


@query("incremental_subjects", "SELECT n_name AS subject, count(*) AS cells, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def incremental_subjects(spark, sf_dir):
    from ..sources.work import shared_folder

    base = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    cells = domain.cells(spark, sf_dir).select("subject", "cell_id", "balance")
    step = lambda df: df.groupBy("subject").agg(F.count("*").alias("cells"), F.sum("balance").alias("balance"))
    for part in (cells.filter("subject < 'NATION_2'"), cells.filter("subject >= 'NATION_2'")):
        part.write.mode("append").parquet(f"{base}/in")
        process_new(spark, f"{base}/in", "subject string, cell_id long, balance double", f"{base}/out", f"{base}/done", step, "subject")
    return spark.read.parquet(f"{base}/out").select(F.col("subject").cast("string").alias("subject"), "cells", F.round("balance", 2).alias("balance"))
