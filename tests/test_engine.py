"""Hand-checkable cases, brute-force twins and properties of the engine's operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoloom.functions import resample, special
from cytoloom.functions import stats as S
from cytoloom.operators import association, biology, characterize, features, graph, heterogeneity, importance, infer, models, spatial, validation
from cytoloom.operators import preprocess as pre
from cytoloom.sources import domain, readers

ONE = [("R", ["a"], [1], [1.0], ["b"], [1], [1.0])]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def scores(spark, values, rule):
    grouped = frame(spark, [("n", g, float(v)) for g, v in values.items()], "node string, gene string, value double")
    return {r.side: r.score for r in infer.side_scores(grouped, domain.rule_table(spark, [rule])).collect()}


def test_tri_quartile(spark):
    df = frame(spark, [(x,) for x in (0.3, 1.7, 2.2, 5.9, 8.1, 9.0)], "v double")
    assert abs(df.agg(S.tri_quartile("v").alias("m")).first().m - 4.36875) < 1e-12


@pytest.mark.parametrize(
    ("values", "rule", "want"),
    [
        ({"a": 4, "b": 1, "c": 1}, ("R", ["a", "b"], [1, 2], [2.0, 1.0], ["c"], [1], [1.0]), (4 * 4 * 1) ** (1 / 3)),
        ({"a": 0, "b": 5, "c": 1}, ("R", ["a", "b"], [1, 2], [1.0, 1.0], ["c"], [1], [1.0]), 0.0),
        ({"b": 4, "c": 1}, ("R", ["a", "b"], [1, 2], [1.0, 1.0], ["c"], [1], [1.0]), 2.0),
        ({"a": 4, "b": 9, "c": 1}, ("R", ["a", "b"], [1, 2], [1.9, 0.0], ["c"], [1], [1.0]), 4.0),
        ({"a": 2, "b": 4, "c": 1}, ("R", ["a", "b"], [1, 1], [1.0], ["c"], [1], [1.0]), 3.0),
    ],
)
def test_stoichiometric_scores(spark, values, rule, want):
    assert abs(scores(spark, values, rule)["lig"] - want) < 1e-9


def test_methods(spark):
    one = spark.range(1)
    value = lambda m, a, b: one.select(infer.combine(F.lit(a), F.lit(b), m, 0.5).alias("v")).first().v
    assert value("minmean", 2.0, 0.0) == 0 and value("minmean", 2.0, 1.0) == 1.5 and abs(value("hill", 0.5, 0.5) - 0.25) < 1e-12 and value("default", 2.0, 3.0) == 6


def test_rules_are_validated(spark):
    rules = domain.rule_table(spark, ONE)
    assert infer.add_rule(rules, "S", ["x", "y"], ["z"]).count() == 2
    for args in (("R", ["x"], ["y"]), ("T", ["x"], ["y"], {"ligand_group": [1, 2]}), ("T", ["x"], ["y"], {"ligand_coeff": [1.0, 2.0]})):
        with pytest.raises(ValueError):
            infer.add_rule(rules, *args[:3], **(args[3] if len(args) > 3 else {}))
    with pytest.raises(ValueError):
        infer.side_scores(frame(spark, [], "node string, gene string, value double"), rules, "other")


def test_zero_aware_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    dense = {(c, g): float(v) for c in range(60) for g in "ab" if (v := rng.choice([0, 0, 1, 2.5, 7]))}
    expr = frame(spark, [(c, g, v) for (c, g), v in dense.items()], "cell_id long, gene string, value double")
    labels = frame(spark, [(c, f"n{c % 3}") for c in range(60)] + [(99, "empty")], "cell_id long, node string")
    got = {(r.node, r.gene): r.value for r in infer.group_expression(expr, labels).collect()}
    for n in range(3):
        for g in "ab":
            v = np.quantile([dense.get((c, g), 0.0) for c in range(60) if c % 3 == n], [0.25, 0.5, 0.75])
            assert abs(got[f"n{n}", g] - v @ [0.25, 0.5, 0.25]) < 1e-9
    assert got["empty", "a"] == 0


def test_scaling_leaves_the_network_unchanged(spark):
    expr = frame(spark, [(c, g, float(c % 4 + 1)) for c in range(12) for g in "ab"], "cell_id long, gene string, value double")
    rules = domain.rule_table(spark, ONE)
    labels = frame(spark, [(c, f"n{c % 2}") for c in range(12)], "cell_id long, node string")
    net = lambda e: {(r.sender, r.receiver): round(r.prob, 9) for r in infer.observed_network(infer.side_scores(infer.group_expression(infer.signalling(e, rules), labels), rules)).collect()}
    assert net(expr) == net(expr.withColumn("value", F.col("value") * 8).repartition(5))
    assert infer.signalling(expr.withColumn("value", F.lit(0.0)), rules).agg(F.max("value")).first()[0] == 0


def test_filter_is_place_by_place(spark):
    rows = [("R", "a", c, 1.0, p) for c, p in zip("xyz", (0.02, 0.03, 0.04), strict=True)]
    got = {r.receiver: r.net for r in infer.filtered_network(frame(spark, rows, "lr_name string, sender string, receiver string, prob double, pvalue double")).collect()}
    assert got == {"x": 0, "y": 1, "z": 1}
    none = frame(spark, [("R", "a", "x", 0.5, None)], "lr_name string, sender string, receiver string, prob double, pvalue double")
    assert infer.filtered_network(none).first().net == 0.5


def test_permutation_pvalues_are_shares(spark):
    expr = frame(spark, [(c, g, float((c * 7 + len(g)) % 5 + 1)) for c in range(40) for g in "ab"], "cell_id long, gene string, value double")
    labels = frame(spark, [(c, f"n{c % 2}") for c in range(40)], "cell_id long, node string")
    rules = domain.rule_table(spark, ONE)
    seen = infer.observed_network(infer.side_scores(infer.group_expression(expr, labels), rules))
    p = infer.permutation_pvalues(expr, labels, rules, seen, 5, 1)
    assert {round(r.pvalue * 5, 9) for r in p.collect()} <= set(range(6))
    assert infer.permutation_pvalues(expr, labels, rules, seen, 0, 1).filter("pvalue IS NOT NULL").count() == 0


def test_adjusted_values(spark):
    df = frame(spark, list(enumerate((0.01, 0.04, 0.03, 0.5))) + [(9, None)], "i long, p double")
    got = {r.i: r.q for r in S.bh_adjusted(df, "p", [], "q", ["i"]).collect()}
    assert np.allclose([got[i] for i in range(4)], [0.04, 0.16 / 3, 0.16 / 3, 0.5]) and got[9] is None


def test_average_rank_and_constant_correlation(spark):
    df = frame(spark, [(1, x) for x in (1.0, 2.0, 2.0, 3.0)], "g long, v double")
    assert sorted(r.r for r in df.select(S.average_rank("v", ["g"]).alias("r")).collect()) == [1, 2.5, 2.5, 4]
    assert df.withColumn("c", F.lit(1.0)).agg(S.correlation("v", "c").alias("r")).first().r is None


def test_hash_ranks_match_a_sort(spark):
    df = frame(spark, [(i, f"{i * 7919 % 1000:03x}") for i in range(500)], "id long, k string").repartition(6)
    got = sorted((r.k, r.id, r.n) for r in resample.hash_ranked(df, [], "k", ["id"], "n").collect())
    assert [n for *_, n in got] == list(range(1, 501))


def test_shuffles_keep_label_counts(spark):
    df = frame(spark, [(i, "ab"[i % 3 == 0]) for i in range(60)], "u long, l string")
    got = resample.shuffled_labels(df, "u", "l", 3, 9).groupBy("perm", "l").count().collect()
    assert {(r.perm, r.l): r["count"] for r in got} == {(p, x): n for p in range(3) for x, n in (("b", 20), ("a", 40))}


def test_subset_draws(spark):
    got = resample.subset_draws(frame(spark, [(x,) for x in "abcdefgh"], "x string"), "x", 3, 4, 1).groupBy("draw").agg(F.countDistinct("x").alias("n")).collect()
    assert [(r.draw, r.n) for r in sorted(got)] == [(i, 3) for i in range(4)]


def test_partial_spearman_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 4)).round(1)
    m[:, 1] += m[:, 2]
    rows = frame(spark, [("g", *map(float, r)) for r in m] + [("small", 1.0, 2.0, 3.0, 4.0), ("flat", *[1.0] * 4)] * 12, "g string, x double, y double, c double, d double")
    ranks = pd.DataFrame(m).rank().to_numpy()

    def direct(k):
        z = np.column_stack([np.ones(40), ranks[:, 2 : 2 + k]])
        e = ranks[:, :2] - z @ np.linalg.lstsq(z, ranks[:, :2], rcond=None)[0]
        return np.corrcoef(e.T)[0, 1]

    many = {r.g: r for r in association.partial_spearman(rows, ["g"], ["c", "d"]).collect()}
    one = {r.g: r for r in association.partial_spearman_one(rows, ["g"]).collect()}
    assert abs(many["g"].rho - direct(2)) < 1e-9 and abs(one["g"].rho - direct(1)) < 1e-9
    assert many["flat"].rho is None and one["flat"].rho is None and many["flat"].p is None
    assert association.spearman(rows.filter("g = 'small'").limit(4), ["g"]).first().rho is None
    df = 38  # n - 2
    assert abs(many["g"].p - special.t_two_sided(many["g"].rho * math.sqrt(df / (1 - many["g"].rho ** 2)), df)) < 1e-9
    more = rows.withColumns({"e": F.col("c") * 3 + 1, "f": F.lit(7.0), "h": F.col("d") + F.when(F.col("x") > 0, 1.5).otherwise(0.0)})
    got = {tuple(c): association.partial_spearman(more.filter("g = 'g'"), ["g"], c).first() for c in (["c", "d", "e", "f"], ["c", "d", "h"], ["c", "x"], [])}
    assert abs(got["c", "d", "e", "f"].rho - direct(2)) < 1e-9  # a covariate that others explain, and a constant one
    assert got["c", "x"].rho is None and abs(got[()].rho - direct(0)) < 1e-9
    h = pd.Series(m[:, 3] + np.where(m[:, 0] > 0, 1.5, 0.0)).rank().to_numpy()
    z = np.column_stack([np.ones(40), ranks[:, 2:4], h])
    e = ranks[:, :2] - z @ np.linalg.lstsq(z, ranks[:, :2], rcond=None)[0]
    assert abs(got["c", "d", "h"].rho - np.corrcoef(e.T)[0, 1]) < 1e-9
    holes = more.withColumn("c", F.when(F.col("x") > 1, F.lit(float("nan"))).when(F.col("x") < -1, None).otherwise(F.col("c"))).filter("g = 'g'")
    assert association.partial_spearman(holes, ["g"], ["c"]).first().n == int((np.abs(m[:, 0]) <= 1).sum())


@pytest.mark.parametrize("seed", [1, 2])
def test_first_component_agrees_with_svd(spark, seed):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((9, 30)) < 0.4, 0.0, rng.random((9, 30)) * 3) + np.outer(np.arange(9) % 3, rng.random(30))
    m[:, 7] = 2.0  # constant, hence left out
    rows = frame(spark, [(f"u{i}", f"g{j:02}", float(m[i, j])) for i in range(9) for j in range(30) if m[i, j]], "region string, gene string, value double")
    got = {r.region: r.score for r in association.first_component(rows).collect()}
    z = np.delete(m, 7, axis=1)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    want = u[:, 0] * s[0] * (1 if u[0, 0] >= 0 else -1)
    assert all(abs(got[f"u{i}"] - want[i]) < 1e-6 for i in range(9))
    assert association.first_component(rows.filter("gene = 'g07'")).isEmpty()


def test_special_functions():
    assert abs(special.t_two_sided(2.0, 10) - 0.0733880) < 1e-6 and abs(special.chi2_upper(3.841459, 1) - 0.05) < 1e-6
    assert abs(special.hypergeometric_upper(1, 10, 3, 2) - (1 - 7 * 6 / 90)) < 1e-12
    assert abs(special.fisher_two_sided(3, 1, 1, 3) - 0.4857143) < 1e-6
    assert abs(special.signed_rank_two_sided(0, 5) - 2 / 32) < 1e-12 and math.isnan(special.signed_rank_two_sided(0, 0))
    total = sum(math.comb(8, k) * math.comb(12, 6 - k) for k in range(3, 7)) / math.comb(20, 6)
    assert abs(special.hypergeometric_upper(3, 20, 8, 6) - total) < 1e-12


def test_labels_and_edges(spark):
    one = frame(spark, [("A::B::c",), ("x",), ("A::b",)], "l string")
    got = [tuple(r) for r in one.select(features.region_of("l"), features.type_of("l"), *features.strict_pair("l")).collect()]
    assert got == [("A", "B::c", "A::B::c", "A::B::c"), ("x", "", "x", "x"), ("A", "b", "A", "b")]
    edges = {r.edge_idx: (r.src_region, r.tgt_region) for r in features.edge_table(frame(spark, [("c",), ("a",), ("b",)], "region string")).collect()}
    assert len(edges) == 9 and edges[5] == ("c", "b")


def test_unique_edges_and_folds(spark):
    regions = frame(spark, [(x,) for x in "abc"], "region string")
    rows = validation.fold_rows(features.edge_table(regions), regions).filter("is_test").withColumns({"y": F.lit(1.0), "y_hat": F.lit(2.0)})
    unique = {(r.src_region, r.tgt_region): r.fold for r in validation.unique_edges(rows).collect()}
    assert unique == {(s, t): s for s in "abc" for t in "abc"}
    counts = {r.candidates: r.edges for r in validation.candidate_counts(rows).collect()}
    assert counts == {1: 3, 2: 6}
    assert sum(r.edges for r in validation.fold_weights(validation.unique_edges(rows)).collect()) == 9


def test_micro_macro_and_metrics(spark):
    per = frame(spark, [(1, 2.0), (3, 0.0)], "n long, rmse double")
    got = validation.micro_macro(per, "rmse").first()
    assert got.micro == 1 and got.macro == 1
    rows = frame(spark, [(1.0, 1.5), (2.0, 1.0), (4.0, 4.0)], "y double, y_hat double")
    m = validation.metrics(rows).first()
    assert abs(m.rmse - math.sqrt(1.25 / 3)) < 1e-12 and abs(m.mae - 0.5) < 1e-12 and m.n == 3
    assert validation.metrics(rows.withColumn("y", F.lit(1.0))).first().r2 is None


def test_transforms(spark):
    rows = frame(spark, [("f", -1.0, True), ("f", 0.0, False), ("f", 3.0, False), ("lone", 1.0, True)], "fold string, y double, is_test boolean")
    log = {r.y: r.y_t for r in validation.transformed(rows, "log1p").collect()}
    assert log == {-1.0: 0.0, 0.0: math.log1p(1), 3.0: math.log1p(4)}
    assert {r.y: r.y_t for r in validation.transformed(rows, "ecdf").collect()} == {-1.0: 0.0, 0.0: 0.5, 3.0: 1.0}


def test_signed_ranks(spark):
    rows = frame(spark, [(1, float(a), float(b)) for a, b in ((1, 2), (3, 1), (5, 5), (9, 2), (2, 3))], "g long, a double, b double")
    got = validation.signed_rank_test(rows, ["g"]).first()
    assert (got.n, got.w_plus, got.w_minus) == (4, 7.0, 3.0) and abs(got.p - special.signed_rank_two_sided(7, 4)) < 1e-12
    assert validation.signed_ranks(rows.limit(2), ["g"]).first().w_plus is None


def test_pareto_front_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for i in range(60)]
    beaten = lambda t: any(o[1] <= t[1] and o[2] <= t[2] and (o[1] < t[1] or o[2] < t[2]) for o in rows)
    got = {r.i for r in validation.pareto_front(frame(spark, rows, "i long, micro double, macro double")).collect()}
    assert got == {t[0] for t in rows if not beaten(t)}


def test_importances(spark):
    gains = frame(spark, [("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 0.0), ("b", "y", 0.0)], "fold string, feature string, gain double")
    weights = frame(spark, [("a", 1), ("b", 3)], "fold string, edges long")
    got = {r.feature: (r.importance_abs, r.importance_rel) for r in importance.aggregated(gains, weights).collect()}
    assert got == {"x": (0.75, 0.1875), "y": (0.25, 0.0625)}
    table = lambda rows: frame(spark, rows, "group_name string, importance_rel double")
    cat = {r.group_name: r.category for r in importance.categorised(table([("p", 1.3), ("q", 1.0), ("r", 1.1)]), table([("p", 1.0), ("q", 1.3), ("r", 1.0), ("s", 0.5)])).collect()}
    assert cat == {"p": "SC-biased", "q": "FC-biased", "r": "Balanced", "s": "FC-biased"}
    with pytest.raises(ValueError):
        importance.matched_draws(frame(spark, [("a", 1.0), ("b", 2.0)], "lr_name string, importance double"), 1, 5, 1, 99.0, 0.1, 10)


def test_gini_and_entropy(spark):
    sizes = frame(spark, [("r", 4), ("s", 1)], "region string, size long")
    values = frame(spark, [("r", "g", 4.0), ("s", "g", 4.0)], "region string, gene string, value double")
    got = {r.region: r.gini for r in heterogeneity.gini(values, sizes, ["region", "gene"], ["region"]).collect()}
    assert got == {"r": 0.75, "s": None}
    means = frame(spark, [("g", "a", 1.0), ("g", "b", 1.0), ("g", "c", 0.0), ("h", "a", 0.0)], "gene string, cell_type string, value double")
    assert {r.gene: r.entropy for r in heterogeneity.type_entropy(means, ["gene"]).collect()} == {"g": 1.0, "h": None}


def test_projection_and_unique_nodes(spark):
    bridge = frame(spark, [("r", "a"), ("r", "b"), ("q", "b"), ("q", "a"), ("s", "a")], "region string, area string")
    sizes = frame(spark, [("a", 1.0), ("b", 3.0)], "area string, voxels double")
    conn = frame(spark, [("a", "b", 4.0), ("b", "a", 4.0)], "src string, tgt string, v double")
    p = spatial.shares(bridge, sizes)
    assert {(r.src, r.tgt): r.v for r in spatial.projected(conn, p).collect()}["r", "r"] == 1.5
    flat = frame(spark, [(a, b, 7.0) for a in "ab" for b in "ab"], "src string, tgt string, v double")
    assert all(abs(r.v - 7) < 1e-12 for r in spatial.projected(flat, p).collect())
    groups = {r.region: r.group_id for r in spatial.unique_nodes(bridge).collect()}
    assert groups["q"] == groups["r"] == 0 and groups["s"] == 1


def test_distance_faults(spark):
    d = frame(spark, [("a", "a", 0.0), ("a", "b", 2.0), ("b", "a", 3.0), ("b", "b", 0.5)], "src string, tgt string, d double")
    assert tuple(spatial.distance_faults(d, 2).first()) == (0, 0, 1, 2, 0)


def test_graph_measures(spark):
    edges = frame(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "d", 1.0)], "sender string, receiver string, weight double")
    assert {r.node: r.betweenness for r in graph.betweenness(edges).collect()} == {"a": 0, "b": 2 / 6, "c": 2 / 6, "d": 0}
    ranks = {r.node: r.rank for r in graph.page_rank(edges, 1e-9).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["d"] > ranks["a"]
    two = frame(spark, [(x, y, 1.0) for g in ("abc", "xyz") for x in g for y in g if x < y] + [("a", "x", 0.01)], "sender string, receiver string, weight double")
    own = {r.node: r.community for r in graph.communities(two).collect()}
    assert own["a"] == own["b"] == own["c"] != own["x"] == own["y"] == own["z"]
    assert graph.clustering(two.filter("weight = 1")).first().clustering == 1


def test_contingency(spark):
    f = lambda rows: frame(spark, [(x,) for x in rows], "k string")
    table = graph.contingency(f("aaab"), f("abbb"), "k")
    got = graph.contingency_test(table)
    assert got["dof"] == 1 and abs(got["p_fisher"] - special.fisher_two_sided(3, 1, 1, 3)) < 1e-12 and abs(got["chi2"] - 0.5) < 1e-9


def test_enrichment(spark):
    ranking = frame(spark, [(f"g{i}", float(20 - i)) for i in range(20)], "gene string, score double")
    sets = frame(spark, [("top", f"g{i}") for i in range(4)] + [("spread", f"g{i}") for i in (0, 9, 19)], "set_name string, gene string")
    es = {r.set_name: r.es for r in biology.running_enrichment(ranking, sets).collect()}
    assert abs(es["top"] - 1) < 1e-9 and es["spread"] < 1
    hits = frame(spark, [(f"g{i}",) for i in range(5)], "gene string")
    p = {r.set_name: r.p for r in biology.over_representation(hits, ranking.select("gene"), sets).collect()}
    assert abs(p["top"] - special.hypergeometric_upper(4, 20, 4, 5)) < 1e-12
    assert biology.over_representation(hits.limit(2), ranking.select("gene"), sets).count() == 0


def test_taxonomy_and_counts(spark):
    terms = frame(spark, [("x", "m", "L_CLUS", "x"), ("m", None, "L_SUPC", "top"), ("o", "gone", "L_CLUS", "o")], "label string, parent string, set_label string, name string")
    assert {r.label: r.name for r in pre.nearest_marked(terms).collect()} == {"x": "top", "m": "top", "o": ""}
    raw = frame(spark, [(1, "a", 30.0), (2, "a", 2.0)], "cell_id long, gene string, value double")
    assert pre.raw_count_check(raw).first().raw and not pre.raw_count_check(raw.withColumn("value", F.col("value") / 7)).first().raw
    assert abs(pre.log_normalise(raw).filter("cell_id = 1").first().value - math.log1p(1e4)) < 1e-12


def test_variance_parts_add_up(spark):
    rng = np.random.default_rng(8)
    rows = frame(spark, [("o", float(a * 2 + b), float(a), float(b)) for a, b in rng.normal(size=(60, 2))], "outcome string, y double, d double, w double")
    got = models.variance_partition(rows, ["d"], ["w"], n_perm=9).first()
    assert abs(got.unique_d + got.unique_w + got.shared - got.r2_full) < 1e-9 and got.r2_full > 0.9 and got.p == 0.1
    theta = models.orthogonal_score(rows, "d", ["w"], n_boot=30).first()
    assert abs(theta.theta - 2) < 0.3 and theta.lo <= theta.theta <= theta.hi


def test_shap_adds_up_to_the_prediction(spark):
    rows = frame(spark, [(i, float(i % 5), float(i % 7), float((i % 5) * 2 - (i % 7))) for i in range(70)], "id long, a double, b double, y double")
    model = models.train_trees(rows, ["a", "b"], "y", rounds=4, depth=3, valid=None)
    effects = models.tree_shap(model, rows, ["a", "b"], ["id"]).groupBy("id").agg(F.sum("effect").alias("e"))
    both = models.predict(model, rows, ["a", "b"]).join(effects, "id").select((F.col("y_hat") - F.col("e")).alias("base")).collect()
    assert np.ptp([r.base for r in both]) < 1e-6


def test_shap_is_the_sum_over_all_sets(spark):
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(4)
    names = list("abcdef")
    rows = frame(spark, [(i, *map(float, x), float(x[0] * x[1] + np.sin(3 * x[2]) + x[3] * (x[4] > 0))) for i, x in enumerate(rng.normal(size=(300, 6)))], "id long, " + ", ".join(f"{c} double" for c in names) + ", y double")
    model = models.train_trees(rows, names, "y", rounds=3, depth=5, valid=None)
    got = {(r.id, r.feature): r.effect for r in models.tree_shap(model, rows.limit(20), names, ["id"]).collect()}

    def expected(node, x, known):
        if "v" in node:
            return node["v"]
        if node["f"] in known:
            return expected(node["l"] if x[node["f"]] <= node["t"] else node["r"], x, known)
        return sum(c["n"] * expected(c, x, known) for c in (node["l"], node["r"])) / node["n"]

    trees = [(models._tree(t._call_java("rootNode")), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    for r in rows.limit(20).collect():
        x = [r[c] for c in names]
        for f, name in enumerate(names):
            others = [g for g in range(6) if g != f]
            want = sum(w * factorial(len(s)) * factorial(5 - len(s)) / factorial(6) * (expected(t, x, {*s, f}) - expected(t, x, set(s))) for t, w in trees for n in range(6) for s in combinations(others, n))
            assert abs(got[r.id, name] - want) < 1e-9


def test_search_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rows = [(f"r{i % 3}", i, float(i % 7), float(i % 5), float(i % 7 + i % 5), i % 9 < 3) for i in range(90)]
    rows = frame(spark, rows, "fold string, edge_idx long, a double, b double, y_t double, is_test boolean")
    search = lambda most=None: models.search_parameters(rows, ["a", "b"], ["r0", "r1", "r2"], f"file://{tmp_path}/trials", n=3, seed=5, most=most)
    assert [r.trial for r in search(1).collect()] == [0]
    ran = []
    kept = models.region_folds
    monkeypatch.setattr(models, "region_folds", lambda *a, **o: ran.append(o["depth"]) or kept(*a, **o))
    found = {r.trial: r for r in search().collect()}
    draws = models.parameter_draws(3, 5)
    assert sorted(found) == [0, 1, 2] and ran == [d["depth"] for d in draws[1:]] and all(found[i].rounds == d["rounds"] for i, d in enumerate(draws))
    assert search().count() == 3 and len(ran) == 2
    assert models.best_trial(search()).first().trial == min(found, key=lambda i: (found[i].macro, i))


def test_restricted_shuffles_trade_within_their_sets(spark):
    nodes = {c: "abcd"[c % 4] for c in range(80)}
    labels = frame(spark, list(nodes.items()), "cell_id long, node string")
    got = {(r.perm, r.cell_id): r.node for r in infer.permuted_labels(labels, 3, 9, senders=["a", "b"], receivers=["b", "c"]).collect()}
    assert len(got) == 240
    for p in range(3):
        assert all(got[p, c] == "d" for c, n in nodes.items() if n == "d")
        assert sorted(got[p, c] for c, n in nodes.items() if n in "bc") == sorted(n for n in nodes.values() if n in "bc")
        assert {got[p, c] for c, n in nodes.items() if n == "a"} <= {"a", "b"}
        assert any(got[p, c] != n for c, n in nodes.items())


def test_alignment_of_sets(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=12)
    real = [("f", u, float(y[u])) for u in range(12)] + [("g", u, float(-y[u])) for u in range(12)] + [("flat", u, 1.0) for u in range(12)]
    other = [(s, f, u, float(v)) for s in range(19) for f in "fg" for u, v in enumerate(rng.normal(size=12))]
    out = association.null_alignment(frame(spark, real, "feature string, unit long, x double"), frame(spark, other, "s long, feature string, unit long, x double"), frame(spark, [(u, float(v)) for u, v in enumerate(y)], "unit long, y double"), "unit").first()
    assert abs(out.real - 1) < 1e-9 and out.features == 2 and out.p == 0.05 and out.surrogates == 19 and 0 < out.mean < 1 and out.z > 2


def test_readers(spark, tmp_path):
    rules = infer.add_rule(domain.rule_table(spark), "A_first", ["x"], ["y"])
    (tmp_path / "db.json").write_text(readers.rules_to_json(rules))
    back = readers.read_rules(spark, f"file://{tmp_path}/db.json")
    assert [(r.lr_name, r.lr_index) for r in back.orderBy("lr_index").limit(2).collect()] == [("A_first", 0), ("R1_single", 1)] and back.count() == 9
    (tmp_path / "map.csv").write_text("# a\n# b\n# c\ncell,name\nc1,Glia\nc2,Neuron\n")
    assert [tuple(r) for r in readers.read_after_preamble(spark, f"file://{tmp_path}/map.csv", "cell string, name string", 4).collect()] == [("c1", "Glia"), ("c2", "Neuron")]
    (tmp_path / "labels.txt").write_text("1 left cortex\n\n22\tright one \n")
    assert [tuple(r) for r in readers.read_labels(spark, f"file://{tmp_path}/labels.txt").collect()] == [(1, "left cortex"), (22, "right one")]
    (tmp_path / "m.csv").write_text(",a,b\na,0,1\nb,2,0\n")
    assert {(r.src, r.tgt): r.v for r in readers.read_matrix(spark, f"file://{tmp_path}/m.csv").collect()} == {("a", "a"): 0, ("a", "b"): 1, ("b", "a"): 2, ("b", "b"): 0}
    assert readers.index_list("0,2..4,7-8") == [0, 2, 3, 4, 7, 8]
    (tmp_path / "c.yaml").write_text("a: ${ROOT}/x\nb: [1, '${ROOT}']\n")
    assert readers.load_config(str(tmp_path / "c.yaml"), {"ROOT": "/r"}) == {"a": "/r/x", "b": [1, "/r"]}
    with pytest.raises(KeyError):
        readers.expand("${NOT_THERE_AT_ALL}", {})
    old, new = frame(spark, [(1, "a"), (2, "b")], "k long, v string"), frame(spark, [(2, "c")], "k long, v string")
    assert sorted(tuple(r) for r in readers.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace as Space

    from cytoloom.sources.work import shared_folder

    unset = Space(getCheckpointDir=lambda: Space(isDefined=lambda: False))
    session = Space(sparkContext=Space(_jsc=Space(sc=lambda: unset), master="spark://host:7077"), conf=Space(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_names_get_their_classes(spark):
    """Hand-checked: the first class in order whose test a name meets."""
    rules = {"NRXN1_NLGN1": ("Neurexin", "Neurexin-Neuroligin"), "GABA-A_x": ("GABA-A", "Other"), "NRG1_ERBB4": ("Neuregulin-ErbB", "Neuregulin-ERBB"), "NRG3_x": ("Other", "Neuregulin-ERBB"), "Glu-GRIA1": ("Glutamate", "Glutamate_Signaling"), "SEMA3A_NRP1": ("Semaphorin-Plexin", "Semaphorin-Plexin"), "SLIT2_ROBO1": ("Slit-Robo", "Slit-Robo"), "COL1A1_CD44": ("Collagen", "Laminin-Integrin"), "ITGA1_ITGB1": ("Integrin", "Laminin-Integrin"), "WNT5A_x": ("Wnt", "Other"), "FGF2_x": ("FGF", "Other"), "BMP4_x": ("BMP/GDF", "Other"), "abc": ("Other", "Other")}
    got = frame(spark, [(n,) for n in rules], "n string").select("n", biology.rule_class("n"), biology.pathway("n")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == rules
    types = {"Astrocyte": ("Glia", "Glia"), "MGE interneuron": ("Inhibitory", "Inhibitory"), "Amygdala excitatory": ("Excitatory", "Excitatory"), "Vascular": ("Other", "Other"), "L5 excitatory": ("Other", "Excitatory"), "Oligodendrocyte precursor": ("Glia", "Glia")}
    got = frame(spark, [(n,) for n in types], "n string").select("n", biology.type_class("n"), characterize.keyword_class("n")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == types
    lists = frame(spark, [("A + B+ ",), ("",), ("C",), (None,)], "s string").select(biology.plus_list("s").alias("g")).collect()
    assert [r.g for r in lists] == [["A", "B"], [], ["C"], []]
