"""Registered queries do the whole job: the reference's draws, every row of their tables."""

import os

import pytest

from cytoloom import plans
from cytoloom.operators import biology, characterize, graph, importance, infer, models, surrogates, validation

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


class Called(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "module", "operator", "at", "draws"),
    [
        ("perm_pvalue", infer, "permutation_pvalues", 4, 100),
        ("net_bh", infer, "permutation_pvalues", 4, 100),
        ("top_celltypes", characterize, "label_permutation_test", 3, 1000),
        ("top_regions", characterize, "label_permutation_test", 3, 1000),
        ("bootstrap_ci", characterize, "bootstrap_interval", 4, 1000),
        ("gsea_permuted", biology, "ranked_enrichment", 2, 1000),
        ("hub_permutation", graph, "hub_class_test", 1, 1000),
        ("fold_bootstrap", validation, "fold_bootstrap", 1, 1000),
        ("diff_pct_ci", importance, "difference_interval", 2, 5000),
        ("variance_partition", models, "variance_partition", "n_perm", 1000),
        ("orthogonal_score", models, "orthogonal_score", "n_boot", 1000),
        ("variogram_surrogates", surrogates, "surrogate_maps", 2, 100),
        ("feature_null_alignment", surrogates, "surrogate_sets", 2, 100),
    ],
)
def test_draws_are_the_references(spark, monkeypatch, name, module, operator, at, draws):
    def stop(*args, **named):
        raise Called(named[at] if isinstance(at, str) else args[at])

    monkeypatch.setattr(module, operator, stop)
    with pytest.raises(Called) as e:
        plans.QUERIES[name](spark, DATA)
    assert e.value.args == (draws,)


@pytest.mark.parametrize("name", ["lobo_trees", "tree_shap_directions"])
def test_trees_hold_out_every_region(spark, monkeypatch, name):
    def stop(rows, features, folds, y="y_t", **options):
        raise Called(sorted(folds), options)

    monkeypatch.setattr(models, "fold_models", stop)
    with pytest.raises(Called) as e:
        plans.QUERIES[name](spark, DATA)
    regions = [r["n_name"] for r in spark.read.parquet(f"{DATA}/nation.parquet").select("n_name").collect()]
    assert e.value.args == (sorted(regions), {"rounds": 2000})


@pytest.mark.parametrize(
    ("name", "column", "table", "key"),
    [
        ("log1p_shift", "fold", "nation", "n_name"),
        ("ecdf", "fold", "nation", "n_name"),
        ("lr_fold_matrix", None, "nation", "n_name"),
        ("merge_runs", "datasets", "region", "lower(r_name)"),
        ("gene_ranking", "gene", "part", "p_type"),
    ],
)
def test_nothing_is_left_out(spark, name, column, table, key):
    out = plans.QUERIES[name](spark, DATA)
    got = {r[0] for r in out.select(column).distinct().collect()} if column else set(out.columns) - {"lr_name"}
    assert got == {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").selectExpr(key).distinct().collect()}


def test_every_segment_is_a_run(spark):
    segments = {r[0] for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_mktsegment").distinct().collect()}
    pairs = {(r.run_a, r.run_b) for r in plans.QUERIES["wilcoxon_p"](spark, DATA).collect()}
    assert pairs == {(a, b) for a in segments for b in segments if a < b}
    assert {r.subset for r in plans.QUERIES["relative_metric"](spark, DATA).collect()} == segments - {"BUILDING"}
