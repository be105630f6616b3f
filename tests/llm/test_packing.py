"""Packing: ids held against the tokenizers library, places against a slow reading of the rule, sequences against their bound."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cytoloom.llm import packing

from .helpers import EDGE, LONG, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def slow_places(lengths, capacity):
    """The rule read literally: of the open sequences that have room, any of the gap that makes the sum of squares least."""
    gaps, out = [], []
    squares = lambda g: sum(n * n for n in Counter(x for x in g if x).values())
    for s in lengths:
        best = min(({g for g in gaps if g >= s}), key=lambda g: (squares([*_without(gaps, g), g - s]), g), default=None)
        if best is None:
            gaps.append(capacity - s)
            out.append(capacity)
        else:
            gaps[gaps.index(best)] -= s
            out.append(best)
    return out, len(gaps)


def _without(gaps, g):
    rest = list(gaps)
    rest.remove(g)
    return rest


@pytest.mark.parametrize("seed", range(6))
def test_places_follow_the_rule(seed):
    rng = np.random.default_rng(seed)
    capacity = 20
    lengths = rng.integers(1, capacity, 150).tolist()
    lengths = sorted(lengths, reverse=True) if seed % 2 else lengths
    sequences, offsets = packing.place(lengths, capacity)
    wanted, n = slow_places(lengths, capacity)
    assert [capacity - o for o in offsets] == wanted and max(sequences) + 1 == n


def test_encoder_gives_the_librarys_ids(tokenizer):
    encode = packing.encoder(PATH)
    texts = [t or "" for _, t in EDGE] + ["x<|endoftext|>y <|endoftext|>", "<|endof<|endoftext|>text|>", "don't  we're\r\n\t x 　y 12३४ ½ é", "a" * 50_000, " " * 5_000 + "b", "\u0085᠎​﻿ x"]
    step = 0x40
    texts += ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}  {chr(c)}'{chr(c)}" for c in range(lo, lo + step) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x30000, step)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == want.ids


def test_other_tokenizers_run_by_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.encoder(path)("Some  words, HERE").tolist() == Tokenizer.from_file(path).encode("Some  words, HERE", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 5, 6, 7, 12, 13, 30])
def test_only_the_first_piece_may_be_shorter(n):
    cut = packing.cuts(n, 6)
    assert cut[0][0] == 0 and cut[-1][1] == n and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    assert all(b - a == 6 for a, b in cut[1:]) and 1 <= cut[0][1] <= 6


def check(rows, texts, tokenizer, capacity=1024):
    """Every piece of every row, whole; sequences without gaps or overlaps; and not many of them."""
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or min(capacity, len(ids))
        spans = [(0, first)] + [(a, a + capacity) for a in range(first, len(ids), capacity)]
        want.update((i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(spans))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(r.length for r in rows) // capacity)


def test_edge_rows(spark, tokenizer):
    rows = packing.packed_pieces(docs(spark, EDGE)).collect()
    used, least = check(rows, EDGE, tokenizer)
    assert used <= least + 1  # three equal left-overs of more than half a sequence
    assert [r for r in rows if r.doc_id == 1][0][1:4] == (0, 0, 1)


def test_empty_table(spark):
    out = packing.packed_pieces(docs(spark, []))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.isEmpty()


def test_copies_and_groups(spark, tokenizer):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(0, 2500, 300))] + [(7, "one and the same text")] * 150
    cut = packing.pieces(docs(spark, texts)).withColumn("ids_crc32", packing.F.crc32("ids"))
    one = packing.pack(cut.drop("ids")).collect()
    used, least = check(one, texts, tokenizer)
    assert used <= least + 2
    several = packing.pack(cut.drop("ids"), group=60).collect()
    used, least = check(several, texts, tokenizer)
    assert len({r.sequence_id >> 32 for r in several if r.sequence_id >= 0}) > 4 and used <= least * 1.15


def test_sequences_hold_the_ids_in_order(spark, tokenizer):
    texts = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate([3, 700, 100, 100, 2000, 0])] + [(6, LONG[:20_000])]
    cut = packing.pieces(docs(spark, texts))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts}
    found = {i: {} for i in ids}
    for row in packing.sequences(cut, packing.pack(cut.drop("ids"))).collect():
        own = np.frombuffer(row.ids, "<u4").tolist()
        assert len(own) <= 1024 and sum(d.length for d in row.documents) == len(own)
        for d in row.documents:
            found[d.doc_id][d.piece] = own[d.offset : d.offset + d.length]
    assert {i: sum((p[n] for n in sorted(p)), []) for i, p in found.items()} == ids
