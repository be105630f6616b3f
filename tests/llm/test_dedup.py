import hashlib
import random
import re

import pytest
import xxhash

from cytoloom.llm import common, components, exact_dedup, simhash

from .helpers import DOCS, EDGE, docs


def lowered(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_directory_doubles_until_buckets_fit():
    found = exact_dedup.grow_directory({0: 10, 1: 1, 7: 3}, 3, 4)
    assert [x[:3] for x in found] == [(0, 1, 3), (1, 2, 3), (2, 4, 2), (4, 8, 1)]
    assert sum(x[3] for x in found) == 14  # the overfull bucket at full depth is kept as it is
    assert exact_dedup.grow_directory({}, 4, 1) == [(0, 16, 0, 0)]


@pytest.mark.parametrize("hash_bits", [64, 2])
def test_exact_groups_match_brute_force(spark, hash_bits):
    rows = EDGE + [(100 + i, random.Random(i).choice(["a", "A", "b c", "B c", "d"])) for i in range(60)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs(spark, rows), bits=6, capacity=2, hash_bits=hash_bits).collect()}
    want = set()
    for i, t in rows:
        same = [j for j, u in rows if lowered(u) == lowered(t)]
        keep = max((j for j in same if j is not None), default=None)
        want.add((i, keep, len(same), i == keep))
    assert got == want


def test_index_buckets_are_disjoint_ranges(spark):
    index = exact_dedup.build_index(docs(spark, [(i, f"t{i}") for i in range(300)]), bits=8, capacity=16, owners=3)
    entries = index.entries.collect()
    assert len(entries) == 300 and len(index.directory) > 8 and index.global_depth <= 8
    by_bucket = {}
    for e in entries:
        by_bucket.setdefault(e.bucket, []).append(e.hash % (1 << 64))
    spans = sorted((min(v), max(v), b) for b, v in by_bucket.items())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert [b for *_, b in spans] == sorted(by_bucket)


def test_owners_tell_texts_of_one_key_apart(spark):
    rows = docs(spark, [(i, f"t{i % 40}") for i in range(400)])
    index = exact_dedup.build_index(rows, bits=6, capacity=2, owners=3, hash_bits=2)
    entries = index.entries.collect()
    assert len(entries) == 40 and all(e.group_size == 10 for e in entries) and max(e.chain_length for e in entries) > 4
    by_hash = {}
    for e in entries:
        by_hash.setdefault(e.hash, []).append(e)
    assert all({e.owner for e in own} == {own[0].owner} and sorted(e.chain for e in own) == list(range(1, len(own) + 1)) for own in by_hash.values())


def test_owners_share_the_rows(spark):
    rows = docs(spark, [(i, f"t{i}") for i in range(600)] + [(1000 + i, "again and again") for i in range(300)])
    index = exact_dedup.build_index(rows, bits=8, capacity=16, owners=4)
    held = [r["count"] for r in index.entries.groupBy("owner").count().collect()]
    assert len(held) == 4 and max(held) <= 200  # the 300 copies leave their tasks combined


MIXED = EDGE + [(3, "alpha beta gamma"), (5, "alpha beta gamma"), (5, "quite another text"), (1, "alpha BETA gamma"), (None, "ALPHA beta gamma"), (None, "no id at all"), (None, "no id at ALL"), (None, "lone"), (7, "lone id 7"), (40, "Same"), (40, "same"), (40, "same"), (40, "other")]


def survivors(rows, groups, best):
    """Indexes of one row a group: the best id, then the least SHA-256 of the text, then any of equal rows."""
    out = []
    for own in groups:
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        may = [i for i in own if rows[i][0] == (best(ids) if ids else None)]
        out.append(min(may, key=lambda i: hashlib.sha256((rows[i][1] or "").encode()).digest()))
    return sorted(((str(rows[i][0]), rows[i][1] or "") for i in out))


@pytest.mark.parametrize("hash_bits", [64, 2])
def test_exact_deduplicated_keeps_one_row_of_each_group(spark, hash_bits):
    df = docs(spark, MIXED)
    groups = {}
    for i, (_, t) in enumerate(MIXED):
        groups.setdefault(lowered(t), []).append(i)
    out = exact_dedup.deduplicated(df, hash_bits=hash_bits)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == survivors(MIXED, groups.values(), max)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_near_deduplicated_keeps_one_row_of_each_class(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "MAX_DROPPED", limit)
    df = docs(spark, MIXED)
    own, groups = classes([slow_fingerprint(t) for _, t in MIXED]), {}
    for i, c in enumerate(own):
        groups.setdefault(c, []).append(i)
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == survivors(MIXED, groups.values(), min)
    assert simhash.deduplicated(spark.createDataFrame([], DOCS)).count() == 0 == exact_dedup.deduplicated(spark.createDataFrame([], DOCS)).count()


def test_whole_near_duplicate_result_matches_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        text = [rng.choice(words) for _ in range(300)]
        for j in range(6):
            changed = list(text)
            for _ in range(j):
                changed[rng.randrange(300)] = rng.choice(words)
            rows.append((rng.choice([None, 100 * i + j, 7]), " ".join(changed)))
    fps = [slow_fingerprint(t) for _, t in rows]
    own = classes(fps)
    assert len(set(own)) < len(set(fps))
    least = {c: min((r[0] for r, d in zip(rows, own, strict=True) if d == c and r[0] is not None), default=None) for c in set(own)}
    want = sorted((str(i), f"{f:016x}", str(least[c])) for (i, _), f, c in zip(rows, fps, own, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicate_classes(docs(spark, rows)).collect()) == want


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Jvm:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return Jvm

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        common.work_dir(Session)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert simhash.near_duplicate_classes(none).count() == 0


def slow_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Component of each position by brute force."""
    own = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and own[i] != own[j]:
                a, b = own[i], own[j]
                own = [b if x == a else x for x in own]
    return own


def test_fingerprints_match_brute_force(spark):
    got = simhash.near_duplicate_classes(docs(spark, EDGE)).collect()
    want = sorted((str(i), f"{slow_fingerprint(t):016x}") for i, t in EDGE)
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == want
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[4] == comp[5] == 4 and comp[None] == 4 and comp[7] == 6


@pytest.mark.parametrize("limit", [256, 3])
def test_links_span_the_graph(spark, limit):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for centre in fps[:6]:
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5])):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    links = simhash.near_links(table, group_limit=limit)
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 3 for r in links.collect())
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(links).collect()}
    want = classes(fps)
    groups = {}
    for x, c in zip(fps, want, strict=True):
        groups.setdefault(c, set()).add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[1000 + i] for i in range(50)} == {1000}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
