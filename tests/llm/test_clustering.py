"""Centroid clustering: held against plain Lloyd rounds on Python integers, and the tree's own promises."""

import hashlib

import numpy as np
import pytest

from cytoloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string, ids string, vectors int"


def table(spark, rows):
    """embeddings with further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "d", "i", 3) for i, v in rows], SCHEMA)


def lloyd(rows, k=8, rounds=10, seed=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) sorted, by the contract, on Python integers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min(range(len(at)), key=lambda c: (apart(v, at[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        at = [[sum(x) // len(x) for x in zip(*[v for (_, v), o in zip(kept, own, strict=True) if o == c], strict=True)] if c in own else at[c] for c in range(len(at))]
    found = [(i, c := near(v), apart(v, at[c])) for i, v in kept]
    inertia = [sum(d for _, o, d in found if o == c) for c in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for i, c, d in found), key=str)


def got(spark, rows, **options):
    return sorted(map(tuple, clustering.clustered(table(spark, rows), **options).collect()), key=str)


def vectors(n, seed, spread=0.05, groups=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, 64))
    return [(i, (middles[i % groups] + rng.normal(size=64) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_agrees_with_plain_rounds(spark, spread):
    rows = vectors(700, 1, spread)
    assert got(spark, rows) == lloyd(rows)


def test_bad_rows_go_and_odd_ones_stay(spark):
    nan, inf = float("nan"), float("inf")
    base = vectors(40, 2, 0.5)
    rows = base + [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [0.0] * 63), (105, [nan] * 64), (106, [-inf] + [0.0] * 63), (None, [0.5] * 64), (None, [0.25] * 64), (3, base[3][1]), (3, [-0.7] * 64), (107, [-0.0] * 64)]
    out = got(spark, rows)
    assert len(out) == 45 and out == lloyd(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, n):
    rows = vectors(n, 3)
    assert got(spark, rows) == lloyd(rows)


def test_equal_first_vectors_leave_empty_clusters(spark):
    rows = [(i, [0.5] * 64) for i in range(30)] + [(99, [0.25] * 64)]
    out = got(spark, rows)
    assert out == lloyd(rows) and len({r[1] for r in out}) <= 2


def test_result_does_not_depend_on_blocks(spark):
    rows = clustering.integer_vectors(table(spark, vectors(900, 4, 0.8)))
    start = clustering.first_centroids(rows)
    steps = [clustering._step(clustering.trees(rows.repartition(parts), block, leaf), start) for parts, block, leaf in ((1, 512, 16), (5, 7, 1), (3, 100, 100))]
    assert steps[0] == steps[1] == steps[2]


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="would not fit"):
        clustering.clustered(table(spark, [(1, [1e6] * 64)])).collect()


@pytest.mark.parametrize("leaf", [1, 8])
def test_tree_holds_counts_sums_and_boxes_and_assigns_whole_nodes(leaf):
    rng = np.random.default_rng(5)
    own = np.concatenate([rng.integers(-5, 5, (200, 64)) + c for c in (-4000, 0, 4000)])
    order, tree = clustering.build(own, leaf)
    assert sorted(order.tolist()) == list(range(600)) and (tree.vectors == own[order]).all()
    for node in range(len(tree.first)):
        part = tree.vectors[tree.first[node] : tree.first[node] + tree.size[node]]
        assert (tree.low[node] == part.min(0)).all() and (tree.high[node] == part.max(0)).all() and (tree.total[node] == part.sum(0)).all()
        if tree.child[node]:
            assert tree.size[tree.child[node]] + tree.size[tree.child[node] + 1] == tree.size[node]
    centres = np.array([[-4000] * 64, [0] * 64, [0] * 64, [4000] * 64])
    labels, counts, sums = clustering.filtered(tree, centres)
    assert counts.tolist() == [200, 200, 0, 200] and (labels == clustering.nearest(tree.vectors, centres)).all()
    assert (sums.sum(0) == own.sum(0)).all()
    # far groups are settled at inner nodes; only leaves that lie across two groups, one a border at most, look at vectors
    whole = clustering.Tree(np.zeros_like(tree.vectors), tree.first, tree.size, tree.child, tree.low, tree.high, tree.total)
    assert np.abs(clustering.filtered(whole, centres[[0, 1, 3]])[1] - 200).sum() <= 4 * (leaf - 1)
