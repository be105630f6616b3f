"""Centroid clustering of integer vectors by kd-tree filtering.

The vectors are cut into blocks where they are read, and each block becomes a kd-tree: a node splits its vectors at the
median of its widest component and holds their count, their componentwise integer sum and their bounding box. The trees
are written once to the shared folder, one row a tree, and every round reads them there, so a lost executor costs a
re-read. A round walks each tree from the root with the set of centroids that can still be the nearest to some point of
a node's box. Of a box's candidates the one nearest to its middle is the rival; a candidate that is strictly farther than
the rival from every point of the box is dropped (the greatest difference of two squared distances over a box is linear in
each component, so it is found exactly). A node with one candidate left is assigned whole, by its count and sum; a leaf
with several is resolved vector by vector, ties to the smaller number. All arithmetic is on integers, so a round's
sums are the same whatever the blocks were.

What reaches the driver in a round is a count and a sum for each cluster and component."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: Vectors a tree and vectors a leaf, at most.
BLOCK, LEAF = 512, 16
#: Components' absolute values must be below this, so that squared distances fit in 64 bits.
LIMIT = 1 << 26

TREE = "ids array<long>, vectors binary, first binary, size binary, child binary, low binary, high binary, total binary"


@dataclass
class Tree:
    """vectors in tree order; for each node, parents before children: its first vector and how many, its left child (the
    right one is next to it; 0 for a leaf), its box and its sum."""

    vectors: np.ndarray
    first: np.ndarray
    size: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The order that the tree brings its vectors (n x d integers, n > 0) into, and the tree."""
    order = np.arange(len(vectors))
    spans, child = [(0, len(vectors))], []
    for at, end in spans:  # grows while it is walked
        own = vectors[order[at:end]]
        wide = own.max(axis=0) - own.min(axis=0)
        if end - at <= leaf or not wide.any():
            child.append(0)
            continue
        half = (end - at) // 2
        order[at:end] = order[at:end][np.argpartition(own[:, wide.argmax()], half)]
        child.append(len(spans))
        spans += [(at, at + half), (at + half, end)]
    placed = vectors[order]
    boxes = [(x.min(axis=0), x.max(axis=0), x.sum(axis=0)) for x in (placed[a:b] for a, b in spans)]
    low, high, total = (np.array(x, np.int64) for x in zip(*boxes, strict=True))
    first, size = np.array(spans, np.int64).T
    return order, Tree(placed, first, size - first, np.array(child, np.int64), low, high, total)


def nearest(vectors: np.ndarray, centroids: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """The number of the nearest centroid of each vector, the smaller one of ties; live (n x k) says which may be."""
    apart = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    if live is not None:
        apart[~live] = np.iinfo(np.int64).max
    return apart.argmin(axis=1)


def filtered(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels of the tree's vectors, counts by cluster, sums by cluster) of the nearest centroids."""
    k = len(centroids)
    labels, counts, sums = np.zeros(len(tree.vectors), np.int32), np.zeros(k, np.int64), np.zeros((k, centroids.shape[1]), np.int64)
    norm = (centroids**2).sum(axis=1)
    nodes, live = np.zeros(1, np.int64), np.ones((1, k), bool)
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        rival = nearest(low + high, 2 * centroids, live)
        ahead = centroids[None] - centroids[rival][:, None]
        most = 2 * np.where(ahead > 0, high[:, None] * ahead, low[:, None] * ahead).sum(axis=2) + norm[rival][:, None] - norm[None]
        live &= most >= 0
        settled = live.sum(axis=1) == 1
        for node, to in zip(nodes[settled].tolist(), rival[settled].tolist(), strict=True):
            labels[tree.first[node] : tree.first[node] + tree.size[node]] = to
            counts[to] += tree.size[node]
            sums[to] += tree.total[node]
        left = tree.child[nodes]
        ends = ~settled & (left == 0)
        for node, may in zip(nodes[ends].tolist(), live[ends], strict=True):
            at = slice(tree.first[node], tree.first[node] + tree.size[node])
            among = np.flatnonzero(may)
            own = among[nearest(tree.vectors[at], centroids[among])]
            labels[at] = own
            counts += np.bincount(own, minlength=k)
            np.add.at(sums, own, tree.vectors[at])
        down = ~settled & (left > 0)
        nodes, live = np.concatenate([left[down], left[down] + 1]), np.concatenate([live[down], live[down]])
    return labels, counts, sums


def integer_vectors(rows: DataFrame, size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, vector array<long>): floor(scale * x) of each component of the embeddings that have exactly `size`
    components, none of them null, NaN or infinite; others, null ones included, go. Only vec_id and embedding are read."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = (F.size("e") == size) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("e").isNotNull() & fine).select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("vector"))


def first_centroids(vectors: DataFrame, k: int = 8, seed: int = 3) -> list[list[int]]:
    """The k vectors of the least lowercase-hex SHA-256 of `seed:vec_id`, in that order; all where there are fewer. Rows that
    share an id go by their vectors; those without one come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["vector"] for r in vectors.select("vector", key.alias("key")).orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()]


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([x.astype(kind).tobytes()], pa.binary())


def trees(vectors: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """One row (TREE) for each block of vectors, written to the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def planted() -> pa.RecordBatch:
            ids, own = pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held])
            order, tree = build(own, leaf)
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
            columns = [ids, _packed(tree.vectors, "<i4"), *(_packed(x, "<i4") for x in (tree.first, tree.size, tree.child, tree.low, tree.high)), _packed(tree.total, "<i8")]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TREE.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own = batch.column(0), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            if own.min() <= -LIMIT or own.max() >= LIMIT:
                raise ValueError(f"a scaled component is {LIMIT} or more; squared distances would not fit in 64 bits")
            at = 0
            while at < batch.num_rows:
                part = slice(at, at + block - sum(len(v) for _, v in held))
                held.append((ids[part], own[part]))
                at = part.stop
                if sum(len(v) for _, v in held) == block:
                    yield planted()
                    held.clear()
        if held:
            yield planted()

    return materialize(map_arrow(vectors.select("vec_id", "vector"), work, TREE), "kd-trees")


def _read(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = [batch.column(c)[i].as_py() for c in range(1, 8)]
            vectors, low, high, total = (np.frombuffer(raw[c], kind).astype(np.int64).reshape(-1, d) for c, kind in ((0, "<i4"), (4, "<i4"), (5, "<i4"), (6, "<i8")))
            first, size, child = (np.frombuffer(raw[c], "<i4").astype(np.int64) for c in (1, 2, 3))
            yield batch.column(0)[i].values, Tree(vectors, first, size, child, low, high, total)


def _step(planted: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; a cluster without vectors keeps its own."""
    at = np.array(centroids, np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(at), np.int64), np.zeros(at.shape, np.int64)
        for _, tree in _read(batches, at.shape[1]):
            _, n, s = filtered(tree, at)
            counts += n
            sums += s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at)), pa.int32()), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    rows = map_arrow(planted, work, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    new = [list(c) for c in centroids]
    for r in rows.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():
        if r["n"]:
            new[r["cluster"]][r["at"]] = int(r["s"]) // r["n"]
    return new


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) for each row of vectors (vec_id, vector), final centroids).

    Each round assigns every vector to the nearest centroid and moves each centroid to the floor of its vectors' mean; then
    they are assigned once more. Rounds after one that moved nothing would move nothing either and are left out. Fewer
    than k vectors make fewer clusters; equal ones among the first leave the later ones empty. Repeated rows count as
    often as they stand; rows without an id take part and keep null. An empty table gives no rows and no centroids."""
    start = first_centroids(vectors, k, seed)
    if not start:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    planted, now = trees(vectors), start
    for _ in range(rounds):
        before, now = now, _step(planted, now)
        if now == before:
            break
    at = np.array(now, np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _read(batches, at.shape[1]):
            labels, _, _ = filtered(tree, at)
            apart = ((tree.vectors - at[labels]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(labels, pa.int32()), pa.array(apart, pa.int64())], names=["vec_id", "cluster", "distance"])

    return materialize(map_arrow(planted, work, "vec_id long, cluster int, distance long"), "clusters"), now


def clustered(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """One row for each embedding kept by integer_vectors: vec_id, cluster, distance (squared, to its centroid),
    cluster_inertia and inertia (distances summed over the cluster and over all), centroid_sha256 (of the final centroid's
    components in decimal, joined by commas). Nulls, repeats and empty tables as in integer_vectors and cluster."""
    assigned, centroids = cluster(integer_vectors(rows), k, rounds, seed)
    own = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows at most
    total = sum(int(r["d"]) for r in own)
    about = [(r["cluster"], int(r["d"]), total, sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in own]
    about = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
