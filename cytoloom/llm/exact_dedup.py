"""Exact deduplication by an extendible-hash index kept in shared files. DataFrame functions only.

The index. A text's key is a 64-bit hash of its normalised form; keys are ordered as unsigned numbers, so a bucket,
which covers all keys with one prefix, is a range of keys. The directory starts with one bucket. While a bucket holds
more keys than it may, it splits in two by its next bit, and where it already uses as many bits as the directory,
the directory doubles first. A bucket that still overflows with all directory bits used keeps its overflow: it is
processed all the same. The directory is worked out from a histogram of key prefixes that has 2 ** bits cells whatever
the input's size.

The work. A first pass writes each row's key and counts the rows of each. A second deals the texts to the owners of
their buckets: an owner is one task and holds a range of buckets, cut so that owners hold about as many rows each. A key
with many rows would swamp its owner, so the rows of such keys are combined where they are read, byte by byte, and
leave each task once. Owners chain the texts of each key: equal bytes become one entry with its count and largest
doc_id, texts that differ are told apart, and the entries of every bucket go to the shared folder. Rows read their verdict
from the entry of their key; where a chain has several entries, from the one with their text's SHA-256; and should two
texts ever share both, from the one with their text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_one, lookup, materialize, text_digest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of keys with this many copies are combined before they are dealt. The copies needed rise with the input so that
#: at most MAX_HEAVY keys (8 bytes each) are broadcast for it.
HEAVY_COPIES, MAX_HEAVY = 8, 400_000


def normalised(text):
    """A-Z lower-cased, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def grow_directory(cells: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """Buckets as (first cell, end cell, local depth, keys), in key order, from keys per prefix cell.

    Splitting starts from one bucket at depth 0 and stops at `capacity` keys or when all `bits` are used."""
    prefix = [0]
    for c in range(1 << bits):
        prefix.append(prefix[-1] + cells.get(c, 0))
    done, todo = [], [(0, 1 << bits, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        held = prefix[hi] - prefix[lo]
        if held > capacity and depth < bits:
            mid = (lo + hi) // 2
            todo += [(mid, hi, depth + 1), (lo, mid, depth + 1)]
        else:
            done.append((lo, hi, depth, held))
    return done


class ExtendibleIndex:
    """entries: one row per distinct text (bucket, owner, hash, chain, chain_length, same_digest, sha, keep_id, group_size),
    written by owner tasks; rows: one row per document (doc_id, hash, and digest where asked for); directory: the
    buckets; total: the number of documents."""

    def __init__(self, rows: DataFrame, entries: DataFrame, directory: list[tuple[int, int, int, int]], bits: int, total: int):
        self.rows, self.entries, self.directory, self.bits, self.total = rows, entries, directory, bits, total

    @property
    def global_depth(self) -> int:
        return max(d for _, _, d, _ in self.directory)


def _keyed(docs: DataFrame, hash_bits: int) -> DataFrame:
    """(doc_id, text, norm, hash) of each row."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), normalised(text).alias("norm"))
    return rows.withColumn("hash", F.xxhash64("norm") if hash_bits == 64 else F.xxhash64("norm").bitwiseAND((1 << hash_bits) - 1))


def build_index(docs: DataFrame, *, bits: int = 16, capacity: int = 512, owners: int | None = None, hash_bits: int = 64, digests: bool = False) -> ExtendibleIndex:
    """Index docs (doc_id, text; other columns are not read).

    bits bounds the directory at 2 ** bits cells (the histogram and the broadcast directory have no more rows);
    capacity is the number of keys that a bucket holds before it splits; hash_bits below 64 weakens the hash, for tests of
    chains."""
    spark = docs.sparkSession
    keyed = _keyed(docs, hash_bits)
    rows = materialize(keyed.select("doc_id", "hash", *([text_digest(F.col("text")).alias("digest")] if digests else [])), "exact-rows")
    total = rows.count()
    keys = materialize(rows.groupBy("hash").agg(F.count("*").alias("n")), "exact-keys", rows=total)
    cell = F.shiftrightunsigned("hash", 64 - bits)
    copies = max(HEAVY_COPIES, math.ceil(total / MAX_HEAVY))
    load = F.sum(F.when(F.col("n") < copies, F.col("n")).otherwise(1))  # combined keys are dealt about once
    held = {r["cell"]: (r["keys"], r["load"]) for r in keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("keys"), load.alias("load")).collect()}  # 2 ** bits rows at most
    directory = grow_directory({c: n for c, (n, _) in held.items()}, bits, capacity)
    owners = owners or max(1, min(len(directory), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    share, places, before = max(1, sum(n for _, n in held.values())) / owners, [], 0
    for number, (lo, hi, _, _) in enumerate(directory):
        own = [c for c in range(lo, hi) if c in held]
        rows_in = sum(held[c][1] for c in own)
        places += [(c, number, min(owners - 1, int((before + rows_in / 2) / share))) for c in own]
        before += rows_in
    by_cell = F.broadcast(spark.createDataFrame(places, "cell long, bucket int, owner int"))

    heavy = F.broadcast(keys.filter(F.col("n") >= copies).select("hash"))
    texts = keyed.select("hash", "norm", F.col("doc_id").alias("keep_id"))
    dealt = texts.join(heavy, "hash", "left_anti").withColumn("group_size", F.lit(1).cast("long"))
    many = texts.join(heavy, "hash", "left_semi").groupBy("hash", "norm").agg(F.max("keep_id").alias("keep_id"), F.count("*").alias("group_size"))
    dealt = dealt.unionByName(many).withColumn("cell", cell).join(by_cell, "cell").drop("cell").repartitionById(owners, "owner")
    # an owner holds all texts of its keys, so the rest happens in its task
    entries = dealt.groupBy("owner", "bucket", "hash", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = entries.withColumn("sha", F.unhex(F.sha2("norm", 256))).drop("norm")
    chain = Window.partitionBy("owner", "hash")
    entries = entries.withColumns({"chain": F.row_number().over(chain.orderBy("sha", "keep_id")).cast("int"), "chain_length": F.count("*").over(chain), "same_digest": F.count("*").over(Window.partitionBy("owner", "hash", "sha"))})
    return ExtendibleIndex(rows, materialize(entries, "exact-index"), directory, bits, total)


def _verdicts(docs: DataFrame, index: ExtendibleIndex, hash_bits: int) -> DataFrame:
    """The rows of the index with keep_id, group_size and sha of their entry."""
    entry = ["keep_id", "group_size", "sha"]
    found = lookup(index.rows, index.entries.filter("chain_length = 1").select("hash", *entry), ["hash"], "group_size")
    chained = index.entries.filter("chain_length > 1")
    if chained.isEmpty():
        return found
    again = _keyed(docs, hash_bits).join(chained.select("hash").distinct(), "hash", "left_semi")
    again = again.withColumns({"sha": F.unhex(F.sha2("norm", 256)), "digest": text_digest(F.col("text"))})
    by_sha = lookup(again.drop("norm"), chained.filter("same_digest = 1").select("hash", *entry), ["hash", "sha"], "group_size").filter("group_size IS NOT NULL")
    out = found.filter("group_size IS NOT NULL").unionByName(by_sha.select(*found.columns))
    alike = chained.filter("same_digest > 1").select("hash", "sha").distinct()
    if not alike.isEmpty():  # two texts with one hash and one SHA-256: told apart by their bytes
        rest = again.join(alike, ["hash", "sha"], "left_semi")
        groups = rest.groupBy("hash", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(rest.join(groups, ["hash", "norm"]).select(*found.columns))
    return out


def exact_duplicates(docs: DataFrame, *, hash_bits: int = 64, **options) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (largest doc_id with an equal text), group_size, kept, text_sha256 (of
    the normalised text).

    Texts are equal when identical after lower-casing A-Z; a null text equals an empty one. A null doc_id sorts below
    every other and keeps its text only if all its copies lack an id. Rows that repeat a doc_id and its text are one
    document: each counts in group_size and each carries the document's verdict. Other columns, whatever their names,
    are ignored; an empty table gives an empty result."""
    found = _verdicts(docs, build_index(docs, hash_bits=hash_bits, **options), hash_bits)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, *, hash_bits: int = 64, **options) -> DataFrame:
    """docs with exactly one row of each group of equal texts, all columns as they were: that with the largest doc_id. Where
    several rows of a group have that id, or none has any, the one whose text as it stands has the least SHA-256 stays,
    and of rows that repeat an id and a text any one."""
    index = build_index(docs, hash_bits=hash_bits, digests=True, **options)
    found = _verdicts(docs, index, hash_bits).withColumn("candidate", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return keep_one(docs, found, "sha", index.total)
