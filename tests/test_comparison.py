"""The importance test against a plain version and its odd inputs; two networks' nodes side by side."""

import hashlib
import math

import pandas as pd
import pytest

from cytoloom.operators import graph, heterogeneity, importance

SCHEMA = "lr_name string, importance double, entropy double, gini double"


def plain(rows, n, seed):
    df = pd.DataFrame(rows, columns=["lr_name", "x", "e", "g"]).dropna().set_index("lr_name")
    ranks = pd.DataFrame({"x": df["x"].rank(), "e": (-df["e"]).rank(), "g": df["g"].rank()})
    order = lambda s: sorted(ranks.index, key=lambda r: (hashlib.md5(f"{seed}_{s}_{r}".encode()).hexdigest(), r))
    labels, out = [ranks["x"][r] for r in order(-1)], {}
    for c in "eg":
        real = (ranks["x"] * ranks[c]).sum()
        reached = sum(sum(x * ranks[c][r] for x, r in zip(labels, order(s), strict=True)) >= real for s in range(n))
        out[c] = ranks["x"].corr(ranks[c]), (1 + reached) / (1 + n)
    return out


def test_importance_test_matches_a_plain_version(spark):
    rows = [(f"lr{i}", float((i * 7) % 5), 1.0 + (i * 3) % 4, i / 3 + (i * 5) % 7) for i in range(14)]
    want = plain(rows, 60, 5)
    odd = [("null", None, 1.0, 1.0), ("nan", 1.0, float("nan"), 1.0), ("gini", 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS perm", "'x' AS sum_gini")
    got = heterogeneity.importance_test(frame, 60, 5).first()
    assert got.rules == 14
    assert (got.rho_entropy, got.p_entropy) == pytest.approx(want["e"]) and (got.rho_gini, got.p_gini) == pytest.approx(want["g"])


def test_importance_test_of_few_or_flat_rules(spark):
    few = heterogeneity.importance_test(spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 2.0, 1.0, 4.0)], SCHEMA), 5).first()
    assert tuple(few) == (2, None, None, None, None)
    assert tuple(heterogeneity.importance_test(spark.createDataFrame([], SCHEMA), 5).first()) == (0, None, None, None, None)
    flat = heterogeneity.importance_test(spark.createDataFrame([(f"r{i}", float(i), 1.0, float(i)) for i in range(12)], SCHEMA), 19).first()
    assert flat.rho_entropy is None and flat.p_entropy is None and flat.rho_gini == pytest.approx(1) and flat.p_gini == 0.05


def test_compared_nodes(spark):
    schema = "node string, total_strength double, rank double, in_degree int"
    a = spark.createDataFrame([("x", 4.0, 0.5, 1), ("y", 1.0, 0.5, 1)], schema)
    b = spark.createDataFrame([("x", 1.0, 0.25, 1), ("z", 2.0, 0.75, 1)], schema)
    got = {r.node: r for r in graph.compared_nodes(a, b).collect()}
    assert set(got) == {"x", "y", "z"} and got["x"].log2_strength == pytest.approx(2) and got["x"].log2_rank == pytest.approx(1)
    assert (got["y"].strength_fc, got["y"].rank_fc) == (0, 0) and got["z"].log2_rank == pytest.approx(math.log2(1e-10 / (0.75 + 1e-10)))


def test_matched_draws_go_on_until_enough_are_accepted(spark):
    own = {f"r{i:02}": float(i) for i in range(12)}
    own["r00"] = None
    rules = spark.createDataFrame(list(own.items()), "lr_name string, importance double")

    def subset(draw):
        return sorted(own, key=lambda r: (hashlib.md5(f"9_{draw}_{r}".encode()).hexdigest(), r))[:4]

    fits = [i for i in range(2000) if abs(sum(own[r] or 0.0 for r in subset(i)) - 30.0) / 30.0 <= 0.05][:6]
    assert len(fits) == 6 and fits[-1] >= 7  # more than the first round proposes
    got = {}
    for r in importance.matched_draws(rules, 4, 6, 9, 30.0, 0.05, 3).collect():
        got.setdefault(r.draw, []).append(r.lr_name)
    assert {d: sorted(names) for d, names in got.items()} == {d: sorted(subset(d)) for d in fits}
    with pytest.raises(ValueError, match="of 5 draws"):
        importance.matched_draws(rules, 4, 6, 9, 30.0, 0.05, 3, most=5)
    with pytest.raises(ValueError, match="positive"):
        importance.matched_draws(rules, 13, 1, 9, 30.0, 0.05, 3)
