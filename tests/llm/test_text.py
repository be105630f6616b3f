import base64
import collections
import hashlib
import math
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from cytoloom.llm import bpe, mixing, pu, quality_classifier, quality_rules, toxicity

from .helpers import DOCS, EDGE, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_bpe_is_tiktoken(spark):
    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = EDGE[:6] + [(20, "<|endoftext|> it's I'LL  \n\n x\t"), (21, "\x00\x01½²Ⅷ" * 50), (22, "a" * 3000)]
    got = {r.doc_id: r for r in bpe.digests(docs(spark, rows)).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs(spark, rows)).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs(spark, rows))).collect()}
    for i, t in rows:
        want = own.encode_ordinary(t or "")
        assert ids[i] == want and back[i] == (t or "") and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.asarray(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(spark.createDataFrame([], DOCS)).count() == 0


def test_bpe_model_wants_all_ranks():
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0, b"b": 2})


def base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_base_rules_match_brute_force(spark):
    rows = EDGE + [(30, "a b c a b c x\n\nx\nx\n #$ <p>"), (31, "same " * 200), (32, "a b c d\n" * 3 + " ".join(map(str, range(90))))]
    got = quality_rules.quality_verdicts(docs(spark, rows)).collect()
    seen = sorted((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
    assert seen == sorted((str(i), base(t)) for i, t in rows)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.quality_verdicts(spark.createDataFrame([], DOCS)).count() == 0


def test_outliers_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    good = [(i, " ".join(word() for _ in range(120)), "en", "s0") for i in range(90)]
    bad = [(1000 + i, " ".join(word() + "***" for _ in range(120)), "en", "s0") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs(spark, good + bad)).collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in bad)


def slow_mcd(own, hashes, starts=4):
    """Centre and covariance of one group's integer vectors, by the definition; hashes: of each row for each start."""
    q, floor = quality_rules, np.diag((np.array(quality_rules.FLOORS) * quality_rules.SCALE) ** 2)
    estimate = lambda x, factor: (x.mean(axis=0), (x.T @ x / len(x) - np.outer(x.mean(axis=0), x.mean(axis=0))) * factor + floor)
    distance = lambda x, e: np.einsum("ij,jk,ik->i", x - e[0], np.linalg.inv(e[1]), x - e[0])
    logdet = lambda e: np.linalg.slogdet(e[1])[1] / 2
    one_in = max(1, len(own) // 12)
    now = {k: estimate(own[chosen], 1.0) for k in range(starts) if (chosen := (hashes[k] % one_in == 0) | (k == 0)).any()}
    yield min(map(logdet, now.values()))
    while True:
        after = {}
        for k, e in now.items():
            bins = np.clip(np.floor(np.log2(distance(own, e) + 1e-9) * q.BINS_PER_OCTAVE), q.LOW_BIN, q.HIGH_BIN)
            before = np.array([(bins < v).sum() for v in bins])
            after[k] = estimate(own[before < len(own) * q.HALF], q.consistency(q.HALF, 4))
        now = after
        best = min(sorted(now), key=lambda k: (logdet(now[k]), k))
        inner = own[distance(own, now[best]) <= q.chi2_quantile(0.975, 4)]
        yield logdet(now[best]), estimate(inner, q.consistency(0.975, 4))


def slow_verdicts(spark, df):
    """(doc_id, kept, distance) of rows with unique ids; groups settle together, as in the operator."""
    q = quality_rules
    rows = [r.asDict() for r in q.statistic_vectors(q.base_statistics(df)).collect()]
    vectors = spark.createDataFrame([(r["doc_id"], *(r[s] for s in q.STATS)) for r in rows], "uid long, x0 long, x1 long, x2 long, x3 long")
    hashed = {r.uid: [r[f"h{k}"] for k in range(4)] for r in vectors.select("uid", *(F.xxhash64("uid", F.lit(k), *q.STATS).alias(f"h{k}") for k in range(4))).collect()}
    fine = [r for r in rows if not r["base_failed"]]
    groups = {}
    for r in fine:
        for key in (r["g0"], r["g1"], r["g2"]):
            groups.setdefault(key, []).append(r)
    x = {g: np.array([[r[s] for s in q.STATS] for r in own], float) for g, own in groups.items()}
    runs = {g: slow_mcd(x[g], np.array([hashed[r["doc_id"]] for r in own]).T) for g, own in groups.items()}
    was = {g: next(run) for g, run in runs.items()}
    while True:
        step = {g: next(run) for g, run in runs.items()}
        fallen = max(was[g] - step[g][0] for g in step)
        was = {g: v[0] for g, v in step.items()}
        if fallen <= q.SETTLED:
            break
    out = {r["doc_id"]: (False, None) for r in rows}
    for r in fine:
        m, c = step[r["g0"]][1]
        c = c * (1 + q.SHRINK / len(x[r["g0"]]))
        for g in (r["g1"], r["g2"]):
            n, (own_m, own_c) = len(x[g]), step[g][1]
            m, c = (n * own_m + q.SHRINK * m) / (n + q.SHRINK), (n * own_c + q.SHRINK * c) / (n + q.SHRINK)
        z = np.array([r[s] for s in q.STATS], float) - m
        d = float(z @ np.linalg.inv(c) @ z)
        out[r["doc_id"]] = (d <= q.chi2_quantile(q.CUT, 4), d)
    return out


def test_verdicts_match_a_slow_estimate(spark):
    rng = np.random.default_rng(7)
    word = lambda k: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 5 + k)))
    rows = []
    for i in range(160):
        lang, source = ["en", "de", None][i % 3], ["a", "b", None, "rare"][(i // 3) % 3 if i < 150 else 3]
        text = " ".join(word(4 + i % 3) + ("#*" if i % 17 == 5 else "*" * int(rng.random() < 0.02)) for _ in range(int(rng.integers(40, 160))))
        rows.append((i, text + "\nagain\nagain" * (i % 11 == 3), lang, source))
    df = docs(spark, rows)
    want = slow_verdicts(spark, df)
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(df).collect()}
    assert {i: r.kept for i, r in got.items()} == {i: kept for i, (kept, _) in want.items()}
    assert 100 < sum(r.kept for r in got.values()) < sum(not r.base_failed for r in got.values())
    assert all((got[i].distance is None) == (d is None) and (d is None or math.isclose(got[i].distance, d, rel_tol=1e-6)) for i, (_, d) in want.items())


def test_few_rows_are_never_outliers(spark):
    rows = [(i, " ".join(f"w{i}x{j}" * (1 + i) for j in range(60)), "en", f"s{i}") for i in range(4)]
    assert all(r.kept for r in quality_rules.quality_verdicts(docs(spark, rows)).collect())


def test_base_statistics_can_be_filtered_at_once(spark):
    rows = quality_rules.statistic_vectors(quality_rules.base_statistics(docs(spark, [(i, f"word{i} " * 300, "en", "s") for i in range(200)])))
    assert rows.filter("base_failed").groupBy("g2").count().first()["count"] == 200


def test_mcd_estimate_is_near_the_clean_part(spark):
    rng = np.random.default_rng(2)
    clean = rng.multivariate_normal([1000, 500, 300, 800], np.diag([90, 150, 140, 180]) ** 2.0, 3000)
    x = np.vstack([clean, rng.normal(5000, 50, (600, 4))]).round().astype(int)
    fit = spark.createDataFrame([(1, i, *map(int, r)) for i, r in enumerate(x)], "gid long, uid long, x0 long, x1 long, x2 long, x3 long")
    e = quality_rules.mcd(fit).first()
    assert np.allclose([e.m0, e.m1, e.m2, e.m3], clean.mean(axis=0), atol=15) and e.rows == 3600
    floor = np.array(quality_rules.FLOORS) * quality_rules.SCALE
    assert np.allclose(e.c00, clean[:, 0].var() + floor[0] ** 2, rtol=0.2)


def test_chi_square_and_consistency():
    assert abs(quality_rules.chi2_quantile(0.95, 4) - 9.4877) < 1e-3
    assert abs(quality_rules.consistency(1 - 1e-12, 4) - 1) < 1e-3


def test_targets():
    assert mixing.target_sizes([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    got = mixing.target_sizes([1, 100, 100], [5, 2, 1])
    assert got[0] == 3 and abs(sum(got) - 201) < 1e-9 and got[1] == 2 * got[2]
    assert mixing.target_sizes([0, 10], [5, 2]) == [0, 10] and mixing.target_sizes([], []) == []


def test_tree_splits_exactly():
    quotas = np.array([500, 0, 33, 7])
    leaves = list(mixing.grow(quotas, 0, 11, 11, 3))
    assert sum(q for *_, q in leaves).tolist() == quotas.tolist() and [lo for lo, *_ in leaves] == list(range(11))
    assert max(q.sum() for *_, q in leaves) - min(q.sum() for *_, q in leaves) <= 4
    top = list(mixing.grow(quotas, 0, 11, 11, 3, stop=4))
    again = [x for lo, hi, q in top for x in mixing.grow(q, lo, hi, 11, 3)]
    assert [(lo, q.tolist()) for lo, _, q in leaves] == [(lo, q.tolist()) for lo, _, q in again]
    big = mixing.draw(np.array([2 * 10**9, 10**9]), 10**9, np.random.default_rng(1))
    assert big.sum() == 10**9 and abs(big[0] / 10**9 - 2 / 3) < 1e-3


def test_large_draws_are_hypergeometric(monkeypatch):
    monkeypatch.setattr(mixing, "EXACT_DRAW", 0)
    rng = np.random.default_rng(9)
    got = np.bincount([mixing.hypergeometric(12, 8, 7, rng) for _ in range(4000)], minlength=8) / 4000
    want = [math.comb(12, k) * math.comb(8, 7 - k) / math.comb(20, 7) for k in range(8)]
    assert np.abs(got - want).max() < 0.03
    assert [mixing.hypergeometric(*x, rng) for x in ((0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10))] == [0, 3, 0, 5]
    assert sum(mixing.draw(np.array([5, 0, 9, 3]), 11, rng)) == 11


def slow_mix(rows, block_words, seed, spark):
    """Words taken of each row: by source, blocks pass after pass in the order of their hash, while the target's nearer."""
    keyed = docs(spark, rows).select("doc_id", "source", "text", mixing.word_count(F.col("text")).alias("size"), mixing.text_digest(F.col("text")).alias("digest"))
    size = sum(r["size"] for r in keyed.collect())
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    own = {s: sum(len(WORD.findall(t or "")) for _, t, _, x in rows if x == s) for s in names}
    target = dict(zip(names, mixing.target_sizes([own[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    assert abs(sum(target.values()) - min(size, 3 * size)) < 1e-6
    n = F.ceil(F.col("size") / block_words).cast("int")
    units = keyed.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch"), n.alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    units = units.select("doc_id", "source", "size", "epoch", "block", F.xxhash64(F.lit(seed), "epoch", "block", "doc_id", "size", "source", "digest").alias("order")).collect()
    taken = collections.Counter()
    for s in names:
        sofar = 0
        for u in sorted((u for u in units if u.source == s), key=lambda u: (u.epoch, u.order % (1 << 64))):
            words = min(block_words, u["size"] - u.block * block_words)
            if sofar + words / 2 <= target[s]:
                taken[u.doc_id] += words
            sofar += words
    return taken


def test_mix_matches_a_slow_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), "en", [None, "b", "a", "c", "é"][int(rng.integers(0, 5)) if i % 3 else 1]) for i in range(250)] + [(900, None, "en", "a")]
    want = slow_mix(rows, 64, 7, spark)
    got = mixing.mixed_words(mixing.mix(docs(spark, rows), block_words=64, shard_blocks=50, bucket_blocks=10)).collect()
    assert {r.doc_id: r.taken for r in got} == {i: want[i] for i, *_ in rows}


def test_the_tree_decides_the_shards(spark, monkeypatch):
    rows = [(i, "w " * 50, "en", "abc"[i % 3]) for i in range(300)]
    plan = mixing.mix(docs(spark, rows), shard_blocks=20)
    mine = {(d.rid, d.epoch, d.block): d.shard for d in plan.draws.collect()}
    held = collections.Counter((d.shard, d.sidx) for d in plan.draws.collect())
    leaves = {lo: q for lo, _, q in mixing.grow(plan.sources["quota"].to_numpy(), 0, plan.shards, plan.shards, 7)}
    assert all(held[k, j] == q for k, own in leaves.items() for j, q in enumerate(own.tolist()))
    slots = {}
    for d in plan.draws.collect():
        slots.setdefault(d.shard, []).append(d.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    other = mixing.mix(docs(spark, rows), shard_blocks=20, seed=8)
    assert mine != {(d.rid, d.epoch, d.block): d.shard for d in other.draws.collect()}


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 400))), "en", [None, "b", "a", "c"][i % 4]) for i in range(400)] + [(900, None, "en", "a"), (901, "", "en", "z"), (5, "twice", "en", "b"), (5, "twice", "en", "b")]
    plan = mixing.mix(docs(spark, rows), block_words=64, shard_blocks=100, bucket_blocks=50)
    got = mixing.mixed_words(plan).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    per = {}
    for r in got:
        per.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - want) <= 64 for t, want in per.values())
    draws = plan.draws.collect()
    assert len({(d.rid, d.epoch, d.block) for d in draws}) == len(draws)
    shards = collections.Counter(d.shard for d in draws)
    assert len(shards) == plan.shards > 3 and max(shards.values()) <= 101 and len({(d.shard, d.slot) for d in draws}) == len(draws)
    again = mixing.mixed_words(mixing.mix(docs(spark, rows).repartition(7), block_words=64, shard_blocks=100, bucket_blocks=50)).collect()
    key = lambda r: (str(r.doc_id), r.source or "", r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    words = sum(len(r.text.split()) for r in mixing.mixed_texts(plan, docs(spark, rows), 64).collect())
    assert words == sum(d.n_words for d in draws)


def test_mixed_documents_are_whole(spark):
    rows = [(i, f"text {i} " * (i + 1), "en", "ab"[i % 2]) for i in range(40)]
    df = docs(spark, rows)
    plan = mixing.mix(df, block_words=0)
    out = mixing.mixed_documents(plan, df).collect()
    assert {(r.doc_id, r.text) for r in out} <= {(i, t) for i, t, *_ in rows} and len(out) == plan.draws.count()
    assert [(r.mix_shard, r.mix_slot) for r in out] == sorted((d.shard, d.slot) for d in plan.draws.collect()) and plan.shards == 8
    draws = collections.Counter((d.doc_id, d.epoch, d.shard, d.slot) for d in plan.draws.collect())
    assert draws == collections.Counter((r.doc_id, r.mix_epoch, r.mix_shard, r.mix_slot) for r in out)
    alike = docs(spark, [(None, "same words", "en", None)] * 3 + [(None, "other words", "en", None), (1, "same words", "en", "a")])
    plan = mixing.mix(alike, block_words=0)
    texts = collections.Counter((r.doc_id, r.text) for r in mixing.mixed_documents(plan, alike).collect())
    assert sum(texts.values()) == plan.draws.count() and set(texts) <= {(None, "same words"), (None, "other words"), (1, "same words")}
    assert mixing.mixed_words(mixing.mix(spark.createDataFrame([], DOCS))).count() == 0


def labelled(spark, n=500):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, 60))
        toxic, poor = i % 7 == 0, i % 5 == 1
        if toxic:
            w[10], w[30] = "zzvile" + "ab"[i % 2], "zzvilex"
        rows.append((i, " ".join((x.upper() + "!!") if poor else x for x in w)))
        labels.append((i, int(not poor), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    df = docs(spark, rows)
    tox = toxicity.score(df, toxicity.train(df, labels)).collect()
    good = quality_classifier.score(df, quality_classifier.train(df, labels)).collect()
    truth = {r.doc_id: r for r in labels.collect()}
    held = [r for r in tox if r.held_out]
    assert held and sum(r.predicted == truth[r.doc_id].toxic for r in held) / len(held) > 0.95
    held = [r for r in good if r.held_out]
    assert sum(r.predicted == truth[r.doc_id].quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in tox + good)
    assert sum(r.predicted for r in good) == quality_classifier.accepted(df, quality_classifier.train(df, labels)).count()


def slow_toxicity(model, text):
    """The logit by trying every feature on the text."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    total = model.bias
    for name, weight in zip(model.names, model.weights, strict=True):
        plain = name.removesuffix("+")
        n = sum(len(w) > len(plain) - 1 and w.startswith(plain[:-1]) for w in words) if plain.endswith("-") else words.count(plain)
        total += weight * (n >= (2 if name.endswith("+") else 1))
    return total


def slow_quality(model, text):
    """The logit by counting byte by byte, word by word."""
    raw = (text or "").encode()
    words, n = raw.split(), len(raw.split())
    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:'\"()-?"]
    counts = [0] * 10
    for b in raw:
        kind = next((k for k, chars in enumerate(kinds) if b in chars), 6)
        counts[7 if b == ord("!") else 8 if 128 <= b < 192 else 9 if b >= 192 else kind] += 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = {tuple(words[i : i + 3]) for i in range(n - 2)}
    x = [c / max(1, len(raw)) for c in counts]
    x += [len(triples) / (n - 2) if n > 2 else 1.0, len(set(words)) / n * max(1, n) ** 0.5 / 10 if n else 0.1, sum(words[i] == words[i + 1] for i in range(n - 1)) / n if n else 0.0]
    x += [len(set(lines)) / len(lines) if lines else 1.0, len(raw) / max(1, n), math.log1p(n), max(map(len, words), default=0) / 50]
    return model.bias + sum(weights[sum(value >= c for c in cuts)] for value, cuts, weights in zip(x, model.cuts, model.weights, strict=True))


def test_scores_match_slow_scorers(spark):
    rows, labels = labelled(spark, 300)
    df = docs(spark, rows)
    t, q = toxicity.train(df, labels), quality_classifier.train(df, labels)
    assert t.names and len(q.cuts) == quality_classifier.MEASURES
    rows = rows[::9] + EDGE + [(500, "zzvilea " * 20_000), (501, "ZZVILEA zzvileb\n\nzzvileb!"), (502, "!" * 100_000)]
    edge = docs(spark, rows)
    for model, module, slow, cut in ((t, toxicity, slow_toxicity, 0.5), (q, quality_classifier, slow_quality, 0.3)):
        got = sorted(((str(r.doc_id), r.score, r.predicted) for r in module.score(edge, model).collect()), key=lambda r: (r[0], r[1]))
        want = sorted(((str(i), 1 / (1 + math.exp(-slow(model, x)))) for i, x in rows), key=lambda r: (r[0], r[1]))
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(math.isclose(g[1], w[1], rel_tol=1e-6, abs_tol=1e-9) and g[2] == int(w[1] >= cut) for g, w in zip(got, want, strict=True))


def test_scores_at_the_threshold_count(spark):
    one = docs(spark, [(1, "any"), (2, None)])
    assert {r.predicted for r in toxicity.score(one, toxicity.Model([], np.zeros(0), 0.0, 0.5)).collect()} == {1}
    cuts = np.zeros((quality_classifier.MEASURES, 1))
    model = quality_classifier.Model(cuts, np.zeros((quality_classifier.MEASURES, 2)), math.log(0.3 / 0.7) + 1e-12, 0.5)
    assert {r.predicted for r in quality_classifier.score(one, model).collect()} == {1}


def test_fit_descends_the_non_negative_risk():
    rng = np.random.default_rng(2)
    xp, xu, prior = rng.normal(1, 1, (200, 3)), np.vstack([rng.normal(1, 1, (90, 3)), rng.normal(-1, 1, (210, 3))]), 0.3

    def risk(w):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        loss = lambda z, y: sum(math.log1p(math.exp(-y * v)) for v in z) / len(z)
        return prior * loss(zp, 1) + max(0.0, loss(zu, -1) - prior * loss(zp, -1)) + 5e-5 * float(w[:-1] @ w[:-1])

    w = pu.fit(xp, xu, prior, steps=2000)
    best = risk(w)
    assert best < 0.5 * risk(np.zeros(4))
    assert all(risk(w + 0.3 * d) >= best - 1e-6 for d in rng.normal(size=(40, 4)))


def test_scorers_on_edge_cases(spark):
    rows, labels = labelled(spark, 120)
    df = docs(spark, rows)
    t, q = toxicity.train(df, labels), quality_classifier.train(df, labels)
    edge = docs(spark, EDGE)
    assert toxicity.score(edge, t).count() == len(EDGE) == quality_classifier.score(edge, q).count()
    assert quality_classifier.accepted(edge, q).columns == edge.columns
    none = spark.createDataFrame([], DOCS)
    assert toxicity.score(none, t).count() == 0 == quality_classifier.score(none, q).count()
    empty = labels.limit(0)
    assert toxicity.train(df, empty).names == [] and quality_classifier.train(df, empty).bias == 0
    assert {r.predicted for r in toxicity.score(edge, toxicity.train(df, empty)).collect()} == {0}


def test_prior_is_estimated():
    rng = np.random.default_rng(6)
    p, u = rng.normal(3, 1, 4000), np.concatenate([rng.normal(3, 1, 1200), rng.normal(-3, 1, 2800)])
    assert abs(pu.estimate_prior(p, u) - 0.3) < 0.03


def test_held_out_fold_is_crc32(spark):
    import zlib

    got = [r.h for r in spark.range(50).select(pu.held_out(F.col("id")).alias("h")).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]


def test_vocabulary_is_read():
    ranks = bpe.read_ranks(bpe.default_vocabulary()[0])
    assert len(ranks) == 50256 and base64.b64encode(next(iter(ranks)))
