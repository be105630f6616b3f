"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

Fingerprints within 3 bits of each other are linked. Every distinct fingerprint emits all variants within half the
radius (1 bit, rounding down) and variants are shuffled: two fingerprints within 2 bits have a common variant. For the
odd third bit the balls are drawn in three projections, each of which leaves out one third of the 64 bits: of three
differing bits at least one falls in some third, and with that third left out at most two remain, so the balls of that
projection meet. That makes 3 + 2 * 64 = 131 variants a fingerprint, in place of the 2,081 of a ball of radius 2.

Fingerprints that meet are then compared in full. Groups that met are deduplicated by their members, and each is
reduced to a spanning set of its verified links, so a group of n gives fewer than n links. A group of more than
`group_limit` fingerprints is never compared pairwise: its members emit their full balls of radius 1 and 2, and all
members within 2 bits of a variant that is within 1 bit of another member hang on that member, exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_one, lookup, map_arrow, map_pandas, materialize
from .components import components

BLOCKS = ((0, 22), (22, 43), (43, 64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text, unsigned: A-Z lower-cased, words between ASCII white space, shingles of `shingle` words
    with repeats (the whole sequence where there are fewer words). No words: 0."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return int.from_bytes(xxh64_digest(joined, seed), "big")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = [0, *ends[: n - 1].tolist()], (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        raw = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts[at : at + 16384], ends[at : at + 16384], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, fp) for each row of docs, with the SHA-256 of its text as digest where it is asked for; a null text is
    empty and has fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            fps, shas = [], []
            for i in range(len(column)):
                text = column[i].as_py() or b""
                fps.append(_signed(fingerprint(text)))
                if digests:
                    shas.append(sha256(text).digest())
            more = [pa.array(shas, pa.binary())] if digests else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *more], names=["doc_id", "fp", "digest"][: 2 + len(more)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, work, "doc_id long, fp long" + ", digest binary" * digests)


def _masks() -> list[tuple[int, int]]:
    """(bits kept, bits flipped) of each variant; which projection it is stands in the bits left out."""
    out = []
    for number, (lo, hi) in enumerate(BLOCKS, 1):
        keep = ~(((1 << hi - lo) - 1) << lo) & (1 << 64) - 1
        out += [(keep, flip | number << lo) for flip in [0, *(1 << b for b in range(64) if not lo <= b < hi)]]
    return out


def variants(fps: DataFrame) -> DataFrame:
    masks = F.array(*[F.struct(F.lit(_signed(k)).alias("keep"), F.lit(_signed(x)).alias("flip")) for k, x in _masks()])
    return fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("key"))


def _span(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Verified links of each group of fingerprints, reduced to a spanning forest of the group."""
    for batch in batches:
        us, vs = [], []
        pairs = [m for m in batch["members"] if len(m) == 2]
        if pairs:
            both = np.array(pairs, np.int64).view(np.uint64)
            near = np.bitwise_count(both[:, 0] ^ both[:, 1]) <= radius
            us.append(both[near, 0])
            vs.append(both[near, 1])
        for m in batch["members"]:
            if len(m) == 2:
                continue
            fp = np.asarray(m, np.int64).view(np.uint64)
            near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
            left = np.ones(len(fp), bool)
            while left.any():
                edge = [int(np.argmax(left))]
                left[edge[0]] = False
                while edge:
                    i = edge.pop()
                    new = np.flatnonzero(near[i] & left)
                    left[new] = False
                    edge += new.tolist()
                    us.append(np.full(len(new), fp[i], np.uint64))
                    vs.append(fp[new])
        yield pd.DataFrame({"u": np.concatenate(us).view(np.int64) if us else np.zeros(0, np.int64), "v": np.concatenate(vs).view(np.int64) if vs else np.zeros(0, np.int64)})


def _full_balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([np.zeros(1, np.uint64), bits, bits[i] | bits[j]])
    near = np.arange(len(flips)) <= 64
    for batch in batches:
        for at in range(0, len(batch), 256):
            fp = batch["fp"].to_numpy()[at : at + 256].view(np.uint64)
            yield pd.DataFrame({"fp": np.repeat(fp, len(flips)).view(np.int64), "key": (fp[:, None] ^ flips).ravel().view(np.int64), "near": np.tile(near, len(fp))})


def near_links(fps: DataFrame, radius: int = 3, group_limit: int = 256) -> DataFrame:
    """Links (u, v) that span the graph of fingerprints (fp, each once) within 3 bits of each other."""
    if radius != 3:
        raise ValueError("the projections are laid out for a radius of 3")
    # many rows: written by as many tasks as they are shuffled to
    met = variants(fps).repartition("key").withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    met = materialize(met, "variants")
    groups = met.filter(F.col("n") <= group_limit).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("members")).select("members").distinct()
    links = map_pandas(groups, lambda b: _span(b, radius), "u long, v long").distinct()
    large = met.filter(F.col("n") > group_limit).select("fp").distinct()
    if not large.isEmpty():
        balls = map_pandas(large, _full_balls, "fp long, key long, near boolean")
        centre = balls.groupBy("key").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("c"), F.count("*").alias("n")).filter("c IS NOT NULL AND n > 1")
        links = links.union(balls.join(centre, "key").filter("fp <> c").select("fp", "c").distinct())
    return links


def _classes(docs: DataFrame, group_limit: int, digests: bool = False) -> tuple[DataFrame, int]:
    """(doc_id, fp, root, component_id) of each row of docs, with digest where it is asked for, and the number of rows;
    root is the fingerprint that names the class."""
    rows = materialize(fingerprints(docs, digests), "fingerprints")
    total = rows.count()
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fingerprints", rows=total)
    rooted = components(near_links(fps.select("fp"), group_limit=group_limit)).withColumnRenamed("node", "fp")
    labelled = fps.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("fps"))
    labelled = materialize(lookup(labelled, least, ["root"], "fps").select("fp", "n", "root", "component_id"), "classes", rows=total)
    return lookup(rows, labelled, ["fp"], "n"), total


def near_duplicate_classes(docs: DataFrame, group_limit: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable
    over links of 3 or fewer differing bits, itself included).

    Null and wordless texts have fingerprint zero and are linked like any other. A null doc_id is never a
    component_id unless nothing in its component has an id. Repeated rows each get a row. Only doc_id and text are
    read; an empty table gives an empty result."""
    found, _ = _classes(docs, group_limit)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, group_limit: int = 256) -> DataFrame:
    """docs with exactly one row of each near-duplicate class, all columns as they were: that with the least doc_id. A row
    without an id stays only where its class has no row with one. Where several rows of a class have that id, or none
    has any, the one whose text has the least SHA-256 stays, and of rows that repeat an id and a text any one. Rows
    of other classes stay, whatever ids they share."""
    found, total = _classes(docs, group_limit, digests=True)
    return keep_one(docs, found.withColumn("candidate", F.col("doc_id").eqNullSafe(F.col("component_id"))), "root", total)
