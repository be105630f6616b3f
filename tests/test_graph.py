"""Shortest ways and communities against plain single-machine versions."""

import heapq
import random
from collections import defaultdict

import pytest

from cytoloom.operators import graph

EDGES = "sender string, receiver string, weight double"


def brandes(rows):
    """Betweenness by one search a source, dependencies added up from the far end."""
    out = defaultdict(list)
    for s, t, w in rows:
        out[s].append((t, w))
    nodes = sorted({x for s, t, _ in rows for x in (s, t)})
    score = dict.fromkeys(nodes, 0.0)
    for source in nodes:
        ways, near, before, order, heap = {source: 1}, {source: 0.0}, defaultdict(list), [], [(0.0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in order:
                continue
            order.append(v)
            for t, w in out[v]:
                if t not in near or d + w < near[t] - 1e-9:
                    near[t], ways[t], before[t] = d + w, ways[v], [v]
                    heapq.heappush(heap, (d + w, t))
                elif t not in order and abs(d + w - near[t]) <= 1e-9:
                    ways[t] += ways[v]
                    before[t].append(v)
        owed = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                owed[u] += ways[u] / ways[v] * (1 + owed[v])
            if v != source:
                score[v] += owed[v]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in score.items()}


@pytest.mark.parametrize(("seed", "n", "m", "lengths"), [(1, 9, 30, (1, 2, 3)), (2, 14, 34, (0.25, 1.5, 0.1, 7.0)), (3, 10, 25, (1,))])
def test_betweenness(spark, seed, n, m, lengths):
    rng = random.Random(seed)
    rows = list({(a, b): (f"n{a}", f"n{b}", float(rng.choice(lengths))) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m))}.values())
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(rows, EDGES)).collect()}
    want = brandes(rows)
    assert got.keys() == want.keys() and max(want.values()) > 0 and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_lengths_must_be_above_zero(spark):
    with pytest.raises(ValueError, match="above zero"):
        graph.betweenness(spark.createDataFrame([("a", "b", 0.0)], EDGES))
    assert graph.betweenness(spark.createDataFrame([], EDGES)).isEmpty()


def one_level(rows):
    """Greedy moves of single nodes in name order, from every node by itself."""
    w = defaultdict(lambda: defaultdict(float))
    for s, t, x in rows:
        w[s][t] += x
        w[t][s] += x
    degree = {v: sum(w[v].values()) for v in sorted(w)}
    total, own, moved = sum(degree.values()), {v: v for v in w}, True
    held = dict(degree)
    while moved:
        moved = False
        for v in degree:
            held[own[v]] -= degree[v]
            to = defaultdict(float)
            for t, x in w[v].items():
                if t != v:
                    to[own[t]] += x
            gain = {c: to[c] - degree[v] * held[c] / total for c in {*to, own[v]}}
            best = max(sorted(gain), key=gain.get)
            if gain[best] > gain[own[v]] + 1e-12:
                own[v], moved = best, True
            held[own[v]] += degree[v]
    return own, quality(rows, own)


def quality(rows, own):
    total = 2 * sum(x for *_, x in rows)
    held, inside = defaultdict(float), 0.0
    for s, t, x in rows:
        held[own[s]] += x
        held[own[t]] += x
        inside += 2 * x * (own[s] == own[t])
    return inside / total - sum(h * h for h in held.values()) / total**2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_communities_are_no_worse_than_single_moves(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{a:02}", f"n{b:02}", rng.choice([0.5, 1.0, 2.0])) for a in range(36) for b in range(36) if a != b and rng.random() < (0.3 if a % 4 == b % 4 else 0.03)]
    edges = spark.createDataFrame(rows, EDGES)
    found = graph.communities(edges)
    own = {r.node: r.community for r in found.collect()}
    assert own.keys() == {x for s, t, _ in rows for x in (s, t)} and all(own[c] == c == min(v for v in own if own[v] == c) for c in set(own.values()))
    assert abs(graph.modularity(edges, found) - quality(rows, own)) < 1e-9
    assert quality(rows, own) >= one_level(rows)[1] - 1e-9


def test_levels_merge_what_single_moves_leave(spark):
    """A ring of 16 triangles: pairs of triangles score higher than triangles, but no single node gains by moving."""
    rows = [(f"t{i:02}{a}", f"t{i:02}{b}", 1.0) for i in range(16) for a, b in ("ab", "bc", "ac")] + [(f"t{i:02}a", f"t{(i + 1) % 16:02}b", 1.0) for i in range(16)]
    found = graph.communities(spark.createDataFrame(rows, EDGES))
    own = {r.node: r.community for r in found.collect()}
    assert all(own[f"t{i:02}a"] == own[f"t{i:02}b"] == own[f"t{i:02}c"] for i in range(16))
    assert len(set(own.values())) < 16 and quality(rows, own) > one_level(rows)[1] + 0.01


def test_page_rank_runs_until_it_settles(spark):
    rng = random.Random(5)
    rows = [(f"n{a}", f"n{b}", rng.random()) for a in range(12) for b in range(14) if a != b and rng.random() < 0.3]
    got = {r.node: r.rank for r in graph.page_rank(spark.createDataFrame(rows, EDGES), 1e-8).collect()}
    out = defaultdict(float)
    for s, _, w in rows:
        out[s] += w
    rank = dict.fromkeys(got, 1 / len(got))
    for _ in range(300):
        loose = sum(x for v, x in rank.items() if v not in out)
        new = dict.fromkeys(got, 0.15 / len(got) + 0.85 * loose / len(got))
        for s, t, w in rows:
            new[t] += 0.85 * rank[s] * w / out[s]
        rank = new
    assert all(abs(got[v] - rank[v]) < 1e-6 for v in rank)
    with pytest.raises(RuntimeError, match="settle"):
        graph.page_rank(spark.createDataFrame(rows, EDGES), 1e-12, rounds=2)
