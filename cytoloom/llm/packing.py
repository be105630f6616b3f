"""Packing documents into sequences of a fixed length by sums of squares.

A document's ids, closed by an end id, are cut into pieces only where they are longer than a sequence: the first piece
takes what is left over, the others fill a sequence each. The rest are placed longest first. N(g) being the number of
open sequences with gap g, a piece of length s goes where the sum of all N(g)^2 becomes smallest: of the gaps g >= s it
takes the one whose loss and whose new gap g - s change the sum least, a full sequence being no longer open, and of
equals the smallest gap. A new sequence is opened only where no open one has room: the rule may open one earlier, to keep
gaps even for pieces still to come, but longest first there is little to come that needs it, and it costs sequences
(README).

At scale: pieces that fill a sequence need no placing. The others are dealt by a hash of their row number into groups of
GROUP pieces or so, each placed by one task over counts and stacks by gap, with no texts or ids. A group's last sequences
stay open, some tens among some ten thousand, so the loss by groups doesn't grow with the data's share of it. Row numbers
are fixed by writing the pieces to the shared folder, so repeated documents spread like others and reruns of a task give
the same places."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import map_arrow, materialize, release

CAPACITY, END = 1024, 2
#: Pieces that one task places.
GROUP = 100_000


def _ranks(model: dict) -> dict[bytes, int]:
    """The ranks of a byte-level BPE model; none unless its vocabulary is the bytes followed by the merges in order."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    ordered = all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(merges)) and len(vocab) == 256 + len(merges)
    return {bytes(back[c] for c in piece): i for piece, i in vocab.items()} if plain and ordered else {}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids as the tokenizer file at `path` gives them, without special tokens added.

    A plain byte-level BPE whose merges stand in rank order is run by tiktoken from the same file: the ids are the same, at
    a quarter of the time. Any other tokenizer runs by the tokenizers library itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    cut = held.get("pre_tokenizer") or {}
    added = held.get("added_tokens") or []
    simple = held["model"].get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    simple = simple and not any(held.get(x) for x in ("normalizer", "post_processor", "truncation", "padding")) and not any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip", "normalized"))
    ranks = _ranks(held["model"]) if simple else {}
    if ranks:
        # the byte-level pre-tokenizer's pattern is the one of the rank files
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
        return lambda text: own.encode_to_numpy(text, allowed_special="all")
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n > 0 ids: only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, at + capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """(row_id, doc_id, piece, start, length, ids): every piece of every row of docs, ids as little-endian unsigned 32-bit
    integers, written to the shared folder. A null or empty text is the end id alone. Rows keep their number and repeat
    as they did, a null doc_id stays null; row_id tells pieces apart. Texts of any length are encoded whole. Only doc_id and
    text are read; an empty table gives no pieces. The tokenizer file is read where workers run."""
    where = path or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(where), np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for i in range(at, min(at + 64, batch.num_rows)):
                    ids = encode(batch.column(1)[i].as_py()).astype("<u4", copy=False).tobytes() + close
                    doc = batch.column(0)[i].as_py()
                    rows += [(doc, n, a, b - a, ids[4 * a : 4 * b]) for n, (a, b) in enumerate(cuts(len(ids) // 4, capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = map_arrow(rows, work, "doc_id long, piece int, start long, length long, ids binary")
    return materialize(out.select(F.monotonically_increasing_id().alias("row_id"), *names), "pieces")


def place(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """(sequence, offset) of pieces shorter than capacity, in the order given; sequences are numbered from 0."""
    count = np.zeros(capacity, np.int64)  # open sequences by gap; a full one has none
    stacks: list[list[int]] = [[] for _ in range(capacity)]
    sequences, offsets, opened = [], [], 0
    for s in lengths:
        own = count[s:]
        change = np.where(own > 0, 2 * (count[: capacity - s] - own + 1), 4 * len(lengths) + 4)  # what the squares' sum grows by
        if own[0]:
            change[0] = 1 - 2 * own[0]  # the sequence is full and no longer open
        gap = s + int(change.argmin())
        if count[gap]:
            count[gap] -= 1
            sequence = stacks[gap].pop()
        else:
            gap, sequence, opened = capacity, opened, opened + 1
        if gap > s:
            count[gap - s] += 1
            stacks[gap - s].append(sequence)
        sequences.append(sequence)
        offsets.append(capacity - gap)
    return sequences, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """cut (row_id, length, ...) with sequence_id and offset: where each piece lies. Offsets of a sequence run from 0
    without gaps. Hand in narrow columns only: all are shuffled."""
    names = [*cut.columns, "sequence_id", "offset"]
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row_id"), "offset": F.lit(0).cast("long")})
    rest = cut.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*cut.schema]) + ", sequence_id long, offset long"

    def placed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row_id"], ascending=[False, True])
        sequences, offsets = place(rows["length"].tolist(), capacity)
        out = rows.drop(columns="_group").assign(sequence_id=np.array(sequences, np.int64) + (int(key[0]) << 32), offset=np.array(offsets, np.int64))
        release()
        return out

    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("row_id"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(placed, schema).unionByName(full).select(*names)


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): each packed sequence's ids in order, and for each piece in it doc_id, piece, offset and
    length, in the order of their offsets."""
    held = placed.select("row_id", "sequence_id", "offset").join(cut, "row_id")
    whole = held.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda done, x: F.concat(done, x["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("documents"))


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Nulls, repeats and empty tables as
    in pieces."""
    cut = pieces(docs, capacity, end, path)
    narrow = cut.select("row_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
