"""Surrogate maps against a plain version, the ledger of finished sets, and features rebuilt from sets."""

import hashlib
import math

import numpy as np
import pytest

from cytoloom.operators import spatial, surrogates

REGIONS = [f"r{i:02}" for i in range(16)]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def distances(spark, regions=REGIONS):
    return spatial.distances(table(spark, [(r, float(i % 4), 1.3 * (i // 4) + 0.01 * i, 0.0) for i, r in enumerate(regions)], "region string, x double, y double, z double"))


def plain(v, d, seed, s, name, portions=surrogates.PORTIONS, lags=25, reach=0.25):
    """One surrogate with loops over regions, pairs and lags."""
    names, n = sorted(v), len(v)
    key = lambda r, end="": hashlib.md5(f"{seed}_{s}_{name}_{r}{end}".encode()).hexdigest()
    moved = dict(zip(sorted(names, key=key), (v[r] for r in names), strict=True))
    share = lambda h: (int(h, 16) % 10**9 + 0.5) / 1e9
    noise = {r: math.sqrt(-2 * math.log(share(key(r, "_noise")[:15]))) * math.cos(2 * math.pi * share(key(r, "_noise")[15:30])) for r in names}
    pairs = [(a, b) for a in names for b in names if a < b]
    top = np.quantile([d[p] for p in pairs], reach)
    pairs = [p for p in pairs if d[p] < top] or pairs
    lo, hi = min(d[p] for p in pairs), max(d[p] for p in pairs)
    cuts, width = [lo + (hi - lo) * k / (lags - 1) for k in range(lags)], 3 * (hi - lo) / (lags - 1) or 1.0

    def variogram(x):
        out = []
        for c in cuts:
            w = [math.exp(-((2.68 * (d[p] - c)) ** 2) / (2 * width * width)) for p in pairs]
            out.append(sum(a * 0.5 * (x[i] - x[j]) ** 2 for a, (i, j) in zip(w, pairs, strict=True)) / sum(w))
        return np.array(out)

    goal, best = variogram(v), None
    for portion in portions:
        smooth = {}
        for r in names:
            near = sorted((o for o in names if o != r), key=lambda o: (d[r, o], o))[: max(1, portion * n // 100)]
            w = [math.exp(-d[r, o] / d[r, near[-1]]) for o in near]
            smooth[r] = sum(a * moved[o] for a, o in zip(w, near, strict=True)) / sum(w)
        got = variogram(smooth)
        slope, base = np.polyfit(got, goal, 1)
        miss = ((goal - base - slope * got) ** 2).sum()
        if best is None or miss < best[0]:
            best = miss, {r: math.sqrt(abs(slope)) * smooth[r] + math.sqrt(abs(base)) * noise[r] for r in names}
    return best[1]


@pytest.mark.parametrize("resample", [False, True])
def test_surrogates_match_a_plain_version(spark, resample):
    d = distances(spark)
    far = {(r.src, r.tgt): r.d for r in d.collect()}
    maps = {("m", "source"): {r: math.sin(i) + 0.2 * i for i, r in enumerate(REGIONS)}, ("m", "target"): {r: float(i % 5) for i, r in enumerate(REGIONS)}, ("größe", "source"): {r: 1.0 / (i + 1) for i, r in enumerate(REGIONS)}}
    rows = table(spark, [(*k, r, v) for k, own in maps.items() for r, v in own.items()], "map string, side string, region string, v double")
    got = {(r.map, r.side, r.s, r.region): r.v for r in surrogates.surrogate_maps(rows, d, 3, 7, resample=resample, block=1, sets=2).collect()}
    assert len(got) == 3 * 3 * 16
    for (name, side), own in maps.items():
        for s in range(3):
            want = plain(own, far, 7, s, name)
            if resample:
                order = sorted(REGIONS, key=lambda r: (want[r], r))  # noqa: B023
                want = dict(zip(order, sorted(own.values()), strict=True))
            else:
                shift = np.mean(list(own.values())) - np.mean(list(want.values()))
                want = {r: v + shift for r, v in want.items()}
            assert np.allclose([got[name, side, s, r] for r in REGIONS], [want[r] for r in REGIONS], atol=1e-9)


def test_a_set_does_not_depend_on_the_others(spark):
    d, rows = distances(spark), table(spark, [("m", r, float(i)) for i, r in enumerate(REGIONS)], "map string, region string, v double")
    alone = surrogates.surrogate_maps(rows, d, [4], 7).collect()
    among = surrogates.surrogate_maps(rows.repartition(5), d, 6, 7, sets=4).filter("s = 4").collect()
    assert [r.region for r in sorted(alone)] == [r.region for r in sorted(among)] and [r.v for r in sorted(alone)] == pytest.approx([r.v for r in sorted(among)])
    assert set(alone[0].asDict()) == {"map", "s", "region", "v"}


def test_surrogates_of_odd_maps(spark):
    d = distances(spark)
    rows = [("gap", REGIONS[0], 1.0), ("gap", REGIONS[1], 3.0), ("gap", REGIONS[1], 5.0), ("gap", REGIONS[2], None), ("gap", REGIONS[3], float("nan")), ("gap", None, 9.0), (None, REGIONS[0], 9.0), ("flat", REGIONS[0], 2.0), ("void", REGIONS[0], None)]
    maps = table(spark, rows, "map string, region string, v double").selectExpr("*", "1 AS s", "'x' AS chunk", "0 AS block")
    got = surrogates.surrogate_maps(maps, d, 2, 1, resample=True).collect()
    assert {r.map for r in got} == {"gap", "flat"} and len(got) == 2 * 2 * 16
    assert sorted(r.v for r in got if r.map == "gap" and r.s == 0) == [1.0] + [2.5] * 14 + [4.0]  # the mean stands in
    assert {r.v for r in got if r.map == "flat"} == {2.0}
    assert surrogates.surrogate_maps(maps.limit(0), d, 2).count() == 0 and surrogates.surrogate_maps(maps, d, []).count() == 0
    with pytest.raises(Exception, match="each two regions"):
        surrogates.surrogate_maps(maps, d.filter("src <> 'r00' OR tgt <> 'r01'"), 1).collect()


def test_finished_sets_are_not_made_again(spark, tmp_path, monkeypatch):
    d = distances(spark)
    maps = table(spark, [("m", side, r, i + k / 3) for k, side in enumerate(("source", "target")) for i, r in enumerate(REGIONS)], "map string, side string, region string, v double")
    made, real = [], surrogates.surrogate_maps

    def counted(maps, d, n, *args, **named):
        if n == [4, 5]:
            raise RuntimeError("lost")
        made.append(n)
        return real(maps, d, n, *args, **named)

    monkeypatch.setattr(surrogates, "surrogate_maps", counted)
    run = lambda wanted, seed=3: surrogates.surrogate_sets(maps, d, wanted, str(tmp_path), seed, each=2)
    with pytest.raises(RuntimeError):
        run(6)
    assert made == [[0, 1], [2, 3]]
    assert run(range(3, 5)).select("s").distinct().count() == 2 and made[2:] == [[4]]  # 3 is there
    done = sorted(run(5).collect())
    assert len(done) == 5 * 2 * 16 and made[3:] == []
    by_key = lambda rows: {(r.map, r.side, r.region, r.s): r.v for r in rows}
    assert by_key(done) == pytest.approx(by_key(real(maps, d, 5, 3).collect()))
    run([1], 4)  # another seed: made anew, and only that set
    assert made[3:] == [[1]]
    assert run(2).count() == 2 * 2 * 16 and made[4:] == [[1]]


def test_null_features(spark):
    sets = table(spark, [(0, "f", side, r, v) for side, own in (("source", (1.0, 2.0)), ("target", (0.5, 0.25))) for r, v in zip("ab", own, strict=True)], "s int, map string, side string, region string, v double")
    marginals = table(spark, [("f", "all", None, 0.75), ("f", "source", "a", 9.0)], "feature string, side string, region string, v double")
    edges = table(spark, [(1, "a", "b"), (2, "b", "a")], "edge_idx int, src_region string, tgt_region string")
    got = {r.edge_idx: r.value for r in surrogates.null_features(sets, marginals, edges).collect()}
    assert got == pytest.approx({1: math.exp(1 + 0.25 - 0.75), 2: math.exp(2 + 0.5 - 0.75)})
