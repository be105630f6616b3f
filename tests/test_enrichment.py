"""Enrichment by members' places against the running sum over all genes, and label tests against whole networks."""

import random

import pytest

from cytoloom.operators import biology, characterize


def running(ranking, members):
    """The greatest deviation of the running sum, gene by gene."""
    order = sorted(ranking, key=lambda r: (-r[1], r[0]))
    total, k, n = sum(abs(x) for g, x in order if g in members), sum(g in members for g, _ in order), len(order)
    run, seen = 0.0, []
    for g, x in order:
        run += (abs(x) / total if total else 1 / k) if g in members else -1 / (n - k)
        seen.append(run)
    return max(seen) if max(seen) >= -min(seen) else min(seen)


def test_members_places_are_enough(spark):
    rng = random.Random(1)
    ranking = [(f"g{i:02}", float(rng.choice([-3, -1, 0, 0, 2, 2, 5]))) for i in range(40)]
    order = [g for g, _ in sorted(ranking, key=lambda r: (-r[1], r[0]))]
    sets = {f"r{s}": set(rng.sample(order, rng.randrange(1, 30))) for s in range(12)}
    sets |= {"all": set(order), "first": set(order[:1]), "last": set(order[-1:]), "ends": {order[0], order[-1]}, "zeros": {g for g, x in ranking if x == 0}, "but one": set(order[1:])}
    rows = [(s, g) for s, own in sets.items() for g in own] + [("all", order[0]), ("r1", "not ranked")]
    got = {r.set_name: (r.size, r.es) for r in biology.running_enrichment(spark.createDataFrame(ranking, "gene string, score double"), spark.createDataFrame(rows, "set_name string, gene string")).collect()}
    assert got.keys() == sets.keys()
    for s, own in sets.items():
        assert got[s][0] == len(own) and abs(got[s][1] - running(ranking, own)) < 1e-9


def test_permutations_find_what_is_planted(spark):
    ranking = spark.createDataFrame([(f"g{i:03}", float(100 - i)) for i in range(200)], "gene string, score double")
    sets = [("top", f"g{i:03}") for i in range(15)] + [("even", f"g{i:03}") for i in range(0, 200, 8)] + [("small", "g001")] + [("large", f"g{i:03}") for i in range(120)]
    got = {r.set_name: r for r in biology.ranked_enrichment(ranking, spark.createDataFrame(sets, "set_name string, gene string"), 200, 3, 10, 100).collect()}
    assert got.keys() == {"top", "even"} and got["top"].size == 15
    assert got["top"].p < 0.02 and got["top"].nes > 2 and got["even"].p > 0.1 and got["top"].q <= got["even"].q


@pytest.mark.parametrize("label", ["kind"])
def test_node_sums_give_the_means_of_all_pairs(spark, label):
    rng = random.Random(2)
    net = [(f"n{a}", f"n{b}", rng.choice([-1.0, 0.0, 0.5, 2.0, 3.5])) for a in range(8) for b in range(8)] + [("n9", "n1", 0.0)]
    kinds = [(f"n{i}", "ab"[i % 2]) for i in range(8)] + [("n9", "c"), ("n10", "d")]
    got = {r.kind: (r.out_mean, r.in_mean) for r in characterize.directed_means(spark.createDataFrame(net, "sender string, receiver string, weight double"), spark.createDataFrame(kinds, "node string, kind string"), label).collect()}
    of = dict(kinds)
    for k in "abc":
        for at, end in ((0, 0), (1, 1)):
            own = [w for *ends, w in net if of[ends[end]] == k and w > 0]
            assert abs(got[k][at] - (sum(own) / len(own) if own else 0.0)) < 1e-12
    assert got.keys() == {"a", "b", "c"}
