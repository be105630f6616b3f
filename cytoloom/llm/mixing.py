"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's text is cut into blocks: runs of at most `block_words` words of one document. Its blocks are put in a
random order, pass after pass, and the source's quota is the number of blocks, from the front, whose words come
nearest to its target. The tree then decides how many of each source's blocks every output shard holds: a node that
covers a range of shards owns a vector of exact quotas; a multivariate-hypergeometric draw takes as many blocks as the
left half of the range has room for, the right half gets the rest, and so on down to single shards. So the shards are
of equal size, each is a fair draw from the whole mix, and the quotas add up exactly. Along a source's order the
shards take consecutive, hence disjoint, runs of blocks, and each shard is shuffled within itself.

The shards are written, each in its shuffled order, and what a document gives to the mix is counted from them.

At scale: a node's draw is seeded by its range of shards alone, so the tree's lower levels are grown by executors,
each from the node it was dealt; a node knows how many of each source's blocks lie before it, so its leaves are runs of
positions. Positions in a source's order come from sums over buckets of the order's hash, and those from sums over
ranges of buckets, so a source that holds most of the rows is ordered in as many tasks as it has ranges. Runs meet
blocks by cells of 2 ** CELL positions. Only per-source numbers reach the driver, of MAX_SOURCES sources at most. All draws
are functions of the seed and the rows, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_digest

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: numpy draws hypergeometric numbers below this total; beyond, they are found by rejection (see `hypergeometric`).
EXACT_DRAW = 900_000_000
#: Sources are known to the driver and broadcast, some 100 bytes each; more of them are refused.
MAX_SOURCES = 1_000_000
#: Bits of the buckets in a range of buckets, and of the positions in a cell.
RANGE, CELL = 10, 10


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def target_sizes(sizes: Sequence[int], weights: Sequence[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """Share all of the sizes by weight; none gets over max_repeats times its size, and what is over goes to the others
    by weight until none is above."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if weights[i] > 0]
    while free:
        shared = sum(weights[i] for i in free)
        want = {i: total * weights[i] / shared for i in free}
        over = [i for i in free if want[i] > max_repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = want[i]
            break
        for i in over:
            out[i] = float(max_repeats * sizes[i])
            total -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many good ones are among n of good + bad. Beyond numpy's range: of two binomial numbers with one probability,
    the first, given that they sum to n, has just this distribution; so pairs are drawn until one does."""
    if not good or not n:
        return 0
    if not bad or n == good + bad:
        return n - bad if bad else n
    if good + bad < EXACT_DRAW:
        return int(rng.hypergeometric(good, bad, n))
    p = n / (good + bad)
    while True:
        a, b = rng.binomial(good, p, 1 << 16), rng.binomial(bad, p, 1 << 16)
        hits = np.flatnonzero(a + b == n)
        if len(hits):
            return int(a[hits[0]])


def draw(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n of the blocks counted in quotas, without replacement, by source."""
    left, rest, out = int(quotas.sum()), int(n), np.zeros_like(quotas)
    if left < EXACT_DRAW:
        return rng.multivariate_hypergeometric(quotas, rest, method="marginals")
    for i, q in enumerate(map(int, quotas)):
        out[i] = hypergeometric(q, left - q, rest, rng)
        left, rest = left - q, rest - int(out[i])
    return out


def split(quotas: np.ndarray, lo: int, hi: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotas of the halves of the node that covers the shards lo to hi - 1 of `shards`."""
    total, mid = int(quotas.sum()), (lo + hi) // 2
    rng = np.random.default_rng([seed, shards, lo, hi])
    left = draw(quotas, total * (mid - lo) // (hi - lo), rng)
    return left, quotas - left


def grow(quotas: np.ndarray, lo: int, hi: int, shards: int, seed: int, stop: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """The nodes below (lo, hi) that cover `stop` shards or fewer, from left to right."""
    todo = [(lo, hi, quotas)]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo <= stop:
            yield lo, hi, q
        else:
            left, right = split(q, lo, hi, shards, seed)
            todo += [((lo + hi) // 2, hi, right), (lo, (lo + hi) // 2, left)]


def shard_runs(spark, quotas: Sequence[int], shards: int, seed: int, stop: int = 512) -> DataFrame:
    """(shard, sidx, first, quota) of every shard and source that it takes from: the shard takes the blocks at positions
    first to first + quota - 1 of the source's order. The driver grows the tree down to nodes of `stop` shards; the
    executors grow the rest."""
    nodes, before = [], np.zeros(len(quotas), np.int64)
    for lo, hi, q in grow(np.asarray(quotas, np.int64), 0, shards, shards, seed, stop):
        nodes.append((lo, hi, q.tolist(), before.tolist()))
        before = before + q

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node in batch.itertuples():
                first = np.asarray(node.before, np.int64)
                for lo, _, q in grow(np.asarray(node.q, np.int64), int(node.lo), int(node.hi), shards, seed):
                    some = np.flatnonzero(q)
                    yield pd.DataFrame({"shard": lo, "sidx": some, "first": first[some], "quota": q[some]})
                    first = first + q

    return spark.createDataFrame(nodes, "lo long, hi long, q array<long>, before array<long>").repartition(max(1, min(len(nodes), 64))).mapInPandas(leaves, "shard long, sidx int, first long, quota long")


class Mix:
    """docs: (rid, doc_id, source, size, digest, sidx, source_size, target), a row for each document; draws: (rid, doc_id,
    sidx, epoch, block, n_words, shard, slot), a row for each block drawn, as written to the shards; sources: what the
    driver knows of each source."""

    def __init__(self, docs: DataFrame, draws: DataFrame, sources: pd.DataFrame, shards: int):
        self.docs, self.draws, self.sources, self.shards = docs, draws, sources, shards


def _sources(sized: DataFrame, blocks_of: Column, weights: Sequence[float], max_repeats: int, bucket_blocks: int) -> pd.DataFrame:
    """A row for each source, in order: size, blocks, sidx, target, epochs (passes over it) and bits of its buckets."""
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.sum(blocks_of).alias("blocks")).limit(MAX_SOURCES + 1).toPandas()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per = per.sort_values("source", na_position="last", key=lambda s: s.map(lambda v: v.encode() if isinstance(v, str) else v)).reset_index(drop=True)
    per["sidx"] = np.arange(len(per), dtype=np.int32)
    per["target"] = target_sizes(per["size"].tolist(), [weights[i % len(weights)] for i in range(len(per))], max_repeats)
    per["epochs"] = [math.ceil(t / s) if s else 0 for t, s in zip(per["target"], per["size"], strict=True)]
    per["bits"] = [max(0, math.ceil(math.log2(max(1.0, b / bucket_blocks)))) for b in per["blocks"].fillna(0)]
    return per


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, *, block_words: int = 256, shard_blocks: int = 1 << 14, least_shards: int = 8, bucket_blocks: int = 2_000, seed: int = 7, max_repeats: int = MAX_REPEATS) -> Mix:
    """Plan a mix of docs (doc_id, source, text) and write its shards. Sources take the weights in turn by code point, null
    last.

    block_words: most words of a block (0: a document is one block); shard_blocks: most blocks of an output shard;
    least_shards: shards that are written even if fewer could hold the mix; bucket_blocks: blocks that one task orders. A
    null text has no words and is never drawn; a null source is a source; rows that repeat each other are drawn as separate
    documents. An empty table gives an empty plan. More than MAX_SOURCES sources are refused."""
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"))
    sized = materialize(sized.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    blocks_of = F.ceil(F.col("size") / block_words) if block_words else F.when(F.col("size") > 0, 1).otherwise(0)
    per = _sources(sized, blocks_of, weights, max_repeats, bucket_blocks)
    rows = [(r.source if isinstance(r.source, str) else None, int(r.sidx), int(r.size), float(r.target), int(r.epochs), int(r.bits)) for r in per.itertuples()]
    known = spark.createDataFrame(rows, "src string, sidx int, source_size long, target double, epochs int, bits int")
    placed = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("src")), "left").drop("src")  # MAX_SOURCES rows at most

    n_blocks = blocks_of.cast("int")
    unit = placed.filter("size > 0 AND epochs > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), n_blocks.alias("n_blocks"))
    unit = unit.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    words = F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words) if block_words else F.col("size")
    order = F.xxhash64(F.lit(seed), "epoch", "block", "doc_id", "size", "source", "digest")
    unit = unit.withColumns({"n_words": words, "order": order}).withColumn("rank", F.expr("order ^ (-9223372036854775807L - 1)"))  # order as an unsigned number
    within_epoch = F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(order, 64 - bits)")).otherwise(F.lit(0)).cast("long")
    unit = unit.withColumn("bucket", F.expr("shiftleft(CAST(epoch AS BIGINT), bits)") + within_epoch)  # along all passes
    unit = unit.select("rid", "doc_id", "sidx", "target", "epoch", "bucket", "rank", "block", "n_words")

    n_buckets = int(sum(e << b for e, b in zip(per["epochs"], per["bits"], strict=True)))
    sums = unit.groupBy("sidx", "bucket").agg(F.count("*").alias("blocks"), F.sum("n_words").alias("words"))
    sums = materialize(sums.withColumn("range", F.shiftright("bucket", RANGE)), "mix-buckets", rows=n_buckets)
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    ranges = sums.groupBy("sidx", "range").agg(F.sum("blocks").alias("rb"), F.sum("words").alias("rw"))
    ranges = ranges.select("sidx", "range", ahead("rb", upto("sidx", "range")).alias("rb"), ahead("rw", upto("sidx", "range")).alias("rw"))
    sums = sums.join(ranges, ["sidx", "range"])
    sums = sums.select("sidx", "bucket", (F.col("rb") + ahead("blocks", upto("sidx", "range", "bucket"))).alias("off"), (F.col("rw") + ahead("words", upto("sidx", "range", "bucket"))).alias("wb"))
    within = Window.partitionBy("sidx", "bucket").orderBy("rank", "rid", "block")
    ranked = unit.withColumns({"nth": F.row_number().over(within) - 1, "sofar": F.sum("n_words").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_words")})
    kept = ranked.join(sums, ["sidx", "bucket"]).filter(F.col("wb") + F.col("sofar") + F.col("n_words") / F.lit(2.0) <= F.col("target"))
    most = MAX_REPEATS * int(per["blocks"].fillna(0).sum())
    kept = materialize(kept.select("rid", "doc_id", "sidx", "epoch", "block", "n_words", (F.col("off") + F.col("nth")).alias("pos")), "mix-taken", rows=most)

    counts = {r["sidx"]: r["n"] for r in kept.groupBy("sidx").agg(F.count("*").alias("n")).collect()}
    per["quota"] = [int(counts.get(i, 0)) for i in range(len(per))]
    total = int(per["quota"].sum())
    shards = max(1, math.ceil(total / shard_blocks), min(least_shards, total))
    runs = shard_runs(spark, per["quota"].tolist() or [0], shards, seed).withColumn("end", F.col("first") + F.col("quota"))
    cells = runs.select("sidx", "shard", "end", F.explode(F.sequence(F.shiftright("first", CELL), F.shiftright(F.col("end") - 1, CELL))).alias("cell"))
    cells = cells.groupBy("sidx", "cell").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("runs"))  # 2 ** CELL runs at most
    drawn = kept.withColumn("cell", F.shiftright("pos", CELL)).join(cells, ["sidx", "cell"])
    drawn = drawn.withColumn("shard", F.expr("filter(runs, r -> pos < r.end)[0].shard"))
    inside = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "sidx", "pos"), "sidx", "pos")
    drawn = drawn.withColumn("slot", F.row_number().over(inside) - 1)
    drawn = materialize(drawn.select("rid", "doc_id", "sidx", "epoch", "block", "n_words", "shard", "slot"), "mix-shards", rows=most)
    return Mix(placed.select("rid", "doc_id", "source", "size", "digest", "sidx", "source_size", "target"), drawn, per, shards)


def mixed_words(plan: Mix) -> DataFrame:
    """Per document, counted from the written shards: doc_id, size, source_size, target, taken (words the mix takes,
    repeats counted), source, first_shard and last_shard (the least and the largest shard that holds words of it)."""
    taken = plan.draws.groupBy("rid").agg(F.sum("n_words").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    out = plan.docs.join(taken, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "first_shard", "last_shard")


_KEYS = ("doc_id", "source", "size", "digest")


def _drawn_keys(plan: Mix) -> DataFrame:
    """The draws with what their document's row is known by, as __cytoloom_0 and so on."""
    known = plan.docs.select("rid", *(F.col(k).alias(f"__cytoloom_{i}") for i, k in enumerate(_KEYS)))
    return plan.draws.drop("doc_id").join(known, "rid")


def _meet(plan: Mix, docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """Rows of docs joined to drawn by id, source, size and digest. Of rows that repeat each other, which were drawn as
    such, any one gives the text."""
    own = (F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")), text_digest(F.col("text")))
    held = docs.withColumns({f"__own_{i}": c for i, c in enumerate(own)})
    if not plan.docs.groupBy(*_KEYS).count().filter("count > 1").isEmpty():
        held = held.dropDuplicates([f"__own_{i}" for i in range(4)])
    same = F.col("__own_0").eqNullSafe(F.col("__cytoloom_0"))
    for i in range(1, 4):
        same = same & F.col(f"__own_{i}").eqNullSafe(F.col(f"__cytoloom_{i}"))
    return held.join(drawn, same)


def mixed_documents(plan: Mix, docs: DataFrame) -> DataFrame:
    """The mix of whole documents (plan made with block_words=0): the rows of docs, each as often as it was drawn, shard by
    shard and in the order of the slots, with mix_shard, mix_slot and mix_epoch (in place of columns so named)."""
    columns = [c for c in docs.columns if c not in ("mix_shard", "mix_slot", "mix_epoch")]
    drawn = _drawn_keys(plan).withColumnsRenamed({"shard": "mix_shard", "slot": "mix_slot", "epoch": "mix_epoch"})
    out = _meet(plan, docs.select(*columns), drawn.drop("rid", "sidx", "block", "n_words")).select(*columns, "mix_shard", "mix_slot", "mix_epoch")
    parts = min(plan.shards, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = (F.col("mix_shard") * parts / F.lit(plan.shards)).cast("int")
    return out.withColumn("__cytoloom_part", part).repartitionById(parts, "__cytoloom_part").drop("__cytoloom_part").sortWithinPartitions("mix_shard", "mix_slot")


def mixed_texts(plan: Mix, docs: DataFrame, block_words: int = 256) -> DataFrame:
    """(shard, slot, doc_id, epoch, block, text): every drawn block with its words, single-spaced."""
    if not block_words:
        whole = mixed_documents(plan, docs.select("doc_id", "source", "text"))
        return whole.select(F.col("mix_shard").alias("shard"), F.col("mix_slot").alias("slot"), "doc_id", F.col("mix_epoch").alias("epoch"), F.lit(0).alias("block"), "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.col("block") * block_words + 1, block_words)
    return _meet(plan, docs.select("doc_id", "source", "text"), _drawn_keys(plan)).select("shard", "slot", "doc_id", "epoch", "block", F.array_join(words, " ").alias("text"))
