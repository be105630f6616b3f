"""Byte-level BPE encoding and decoding through a sentencepiece model that is written directly from the vocabulary.

Every vocabulary entry, a string of bytes, becomes a piece whose characters stand for its bytes one for one; its score
is its negative rank, so the model's merges, highest score first and leftmost among equals, are those of the ranks.
The model normalises nothing: no prefix, no white-space escape, no character map. A text is cut into pre-tokens by the
vocabulary's pattern and each distinct pre-token is encoded by itself; ids are ranks. Decoding maps each id back to
its piece's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Pieces in front of the vocabulary: the model format wants one for unknown input.
OFFSET = 1
#: Pre-tokens whose ids a worker remembers before it starts over; a bound on memory, not on results.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """A printable, unreserved character for each byte: itself where it is one, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol-buffer message: varint, 32-bit float, or length and bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model: ModelProto of pieces (1), trainer_spec (2) and normalizer_spec (3)."""
    chars = byte_characters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[b] for b in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind))
    pieces = [piece("<unk>", 0.0, 2), *(piece("".join(chars[x] for x in b), -rank, 1) for rank, b in enumerate(by_rank))]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(24, 0) + _field(35, 0) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """encode and decode one text at a time; `pattern` cuts it into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        chars = byte_characters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(chars)})
        self.pieces = [b""] * len(ranks)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> None:
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for t in tokens]
        for token, text, ids in zip(tokens, mapped, self.model.encode(mapped, num_threads=1), strict=True):
            if len(ids) and min(ids) < OFFSET:
                raise ValueError(f"the vocabulary cannot spell {text!r}")
            self.known[token] = (np.asarray(ids, "<u4") - np.uint32(OFFSET)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        tokens = self.pattern.findall(text)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if new := list(set(tokens).difference(self.known)):
            self._learn(new)
        return b"".join(map(self.known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, text_bytes) of every row of docs; a null text is empty and has no ids. Rows keep their
    number and repeat as they did; other columns are not read. The vocabulary file is read where workers run."""
    where, cut = (path or default_vocabulary()[0]), (pattern or default_vocabulary()[1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(where, cut)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])
        own.known.clear()

    return map_arrow(_rows(docs), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): encode's ids back to text."""
    where, cut = (path or default_vocabulary()[0]), default_vocabulary()[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(where, cut)
        for batch in batches:
            texts = [own.decode(np.asarray(ids or [], "<u4").tobytes()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode every row in one pass: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded bytes). Nulls and repeats as in encode."""
    where, cut = (path or default_vocabulary()[0]), (pattern or default_vocabulary()[1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(where, cut)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for i in range(batch.num_rows):
                ids = own.encode(batch.column(1)[i].as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.known.clear()

    return map_arrow(_rows(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
