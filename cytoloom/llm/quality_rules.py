"""Quality rules: fixed base limits, then robust multivariate outliers. DataFrame functions only.

Every text gives a vector of four transformed statistics. For each language and source the minimum-covariance-
determinant estimate of centre and covariance is found by concentration steps: measure every row's Mahalanobis
distance, keep the half-sample with the least distances, re-estimate, repeat. Several starts run side by side and the
one whose covariance has the least determinant wins; one reweighting step follows. Rows beyond a chi-square quantile
of the final distances are rejected.

Small groups. Estimates are made of all rows, of each language, and of each language and source, and each is drawn to the
one above it as if that stood for SHRINK rows of its own; the topmost is widened as if it had as much more spread to show.
So a group of ten rows is judged nearly as its language is, one of ten thousand nearly by itself, a single row is never
an outlier, and no number of rows is treated unlike its neighbours.

Each concentration step is one aggregation over a narrow table: rows are put in fixed bins of their distance, and
counts and sums of products are kept per group, start and bin, so the half-sample's quantile and its moments come out
of the same pass. Statistics are whole thousandths and their sums are integers: any order of rows gives the same sums,
and reruns agree to the bit. Groups stay a DataFrame throughout; a group of any size is aggregated where its rows are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
STATS = ("x0", "x1", "x2", "x3")
SCALE = 1000
#: Least standard deviation of each statistic, in its own units: what the rules regard as no difference at all.
FLOORS = (0.08, 0.12, 0.12, 0.15)
HALF = 0.75
CUT = 0.9999
SHRINK = 40
#: Concentration stops when no group's least log-determinant falls by more than this.
SETTLED = 0.02
#: Estimates are broadcast up to this many rows (of about 200 bytes); more of them are joined by a shuffle.
MAX_BROADCAST = 20_000
BINS_PER_OCTAVE, LOW_BIN, HIGH_BIN = 16, -160, 480


def chi2_cdf(x: float, k: int) -> float:
    """For even k."""
    term, total = 1.0, 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, k: int) -> float:
    """What the covariance of a normal sample's central `share` must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (words in 3-word windows that occur twice or more), written once, so that what is asked of them later doesn't count
    the texts again. Windows are told apart by a 64-bit hash and sorted within their row, so a text of any length takes
    n log n steps and no shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    step = step.withColumns({
        "w": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)),
        "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "blanks": F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]")).cast("long"),
        "lines": F.expr(r"filter(split(t, '\n'), l -> rlike(l, '[^\\x20\\x09-\\x0D]'))"),
    })
    step = step.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), (F.char_length("t") - F.col("blanks")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(w) > 2 THEN transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])) ELSE array() END").alias("h"),
    )
    step = step.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) END")).drop("h")
    step = step.withColumn("p", F.expr("CASE WHEN s IS NOT NULL THEN sort_array(transform(filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false)), x -> x.i)) END")).drop("s")
    covered = F.expr("CASE WHEN p IS NOT NULL THEN aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0L, (a, x) -> a + x) ELSE 0L END")
    return materialize(step.withColumn("n_repeat_words", covered).drop("p"), "quality-statistics")


def statistic_vectors(base: DataFrame) -> DataFrame:
    """Add base_failed, the four statistics in whole thousandths (x0 log of the mean word length, x1 root of the symbols
    a word, x2 share of repeated lines a word, x3 root of the share of repeated words) and the keys of the groups that the
    row belongs to: g0 (all rows), g1 (language), g2 (language and source)."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    x = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n), F.col("n_dup_lines") * 10.0 / (F.col("n_dup_lines") * 10.0 + n), F.sqrt(F.col("n_repeat_words") / n))
    out = base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumns({s: F.round(v * SCALE).cast("long") for s, v in zip(STATS, x, strict=True)})
    lang, source = (F.col("lang"), F.isnull("lang")), (F.col("source"), F.isnull("source"))
    return out.withColumns({"g0": F.xxhash64(F.lit(0)), "g1": F.xxhash64(F.lit(1), *lang), "g2": F.xxhash64(F.lit(2), *lang, *source)})


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


_MOMENTS = [*(f"m{i}" for i in range(len(STATS))), *(f"c{i}{j}" for i, j in _pairs())]


def _sums() -> list[Column]:
    out = [F.count("*").alias("n"), *(F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS))]
    return [*out, *(F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i, j in _pairs())]


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """gid, start, centre m* and covariance c** from summed moments."""
    d = lambda name: F.col(name).cast("double")
    out = sums.filter("n > 0").withColumns({f"m{i}": d(f"s{i}") / d("n") for i in range(len(STATS))})
    out = out.withColumns({f"c{i}{j}": (d(f"q{i}{j}") / d("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (F.lit((FLOORS[i] * SCALE) ** 2) if i == j else F.lit(0.0)) for i, j in _pairs()})
    return out.select("gid", "start", *_MOMENTS)


def _factor(estimates: DataFrame) -> DataFrame:
    """Add the covariance's Cholesky factor l** and the log of its root determinant."""
    out = estimates
    for i, j in _pairs():
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(len(STATS))), F.lit(0.0)))


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d2 of rows joined to an estimate, by forward substitution."""
    for i, s in enumerate(STATS):
        z = F.col(s) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(STATS))), F.lit(0.0)))


def _meet(rows: DataFrame, estimates: DataFrame, few: bool, key: str = "gid", how: str = "inner") -> DataFrame:
    """Rows with the written estimates of their group: no shuffle of rows unless there are very many estimates."""
    return rows.join(F.broadcast(estimates) if few else estimates, key, how)


def _bin(d2: Column) -> Column:
    return F.greatest(F.lit(LOW_BIN), F.least(F.lit(HIGH_BIN), F.floor(F.log2(d2 + 1e-9) * BINS_PER_OCTAVE))).cast("int")


def _concentrate(fit: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """One concentration step for every group and start."""
    binned = _distance(_meet(fit, now, few)).withColumn("bin", _bin(F.col("d2"))).groupBy("gid", "start", "bin").agg(*_sums())
    group = Window.partitionBy("gid", "start")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = binned.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "all": F.sum("n").over(group)}).filter(F.col("before") < F.col("all") * HALF)
    names = ["n", *(f"s{i}" for i in range(len(STATS))), *(f"q{i}{j}" for i, j in _pairs())]
    return _factor(_estimate(inner.groupBy("gid", "start").agg(*(F.sum(c).alias(c) for c in names)), consistency(HALF, len(STATS))))


def mcd(fit: DataFrame, starts: int = 4, steps: int = 30) -> DataFrame:
    """fit (gid, uid, x0..x3) -> one estimate for each gid, and its rows. Start 0 is all rows; the others are small random
    subsets, chosen by a hash of the row's own values. Steps are taken until all groups have settled, `steps` at most."""
    sizes = materialize(fit.groupBy("gid").agg(F.count("*").alias("rows")), "mcd-sizes")
    few = sizes.count() * starts <= MAX_BROADCAST
    seeded = _meet(fit, sizes, few).withColumn("start", F.explode(F.array(*map(F.lit, range(starts)))))
    one_in = F.greatest(F.lit(1), F.floor(F.col("rows") / 12)).cast("long")
    seeded = seeded.filter((F.col("start") == 0) | (F.pmod(F.xxhash64("uid", "start", *STATS), one_in) == 0))
    now = materialize(_factor(_estimate(seeded.groupBy("gid", "start").agg(*_sums()), 1.0)), "mcd-start")
    for _ in range(steps):
        after = materialize(_concentrate(fit, now, few), "mcd-step")
        least = lambda e, name: e.groupBy("gid").agg(F.min("logdet").alias(name))
        fallen = least(now, "was").join(least(after, "is"), "gid").agg(F.max(F.col("was") - F.col("is"))).first()[0]
        now = after
        if fallen is None or fallen <= SETTLED:
            break
    best = Window.partitionBy("gid").orderBy("logdet", "start")
    now = materialize(now.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth"), "mcd-best")
    inner = _distance(_meet(fit, now, few)).filter(F.col("d2") <= chi2_quantile(0.975, len(STATS)))
    found = _estimate(inner.groupBy("gid", "start").agg(*_sums()), consistency(0.975, len(STATS)))
    return materialize(found.join(sizes, "gid"), "mcd")


def _drawn_together(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups (g0, g1, g2) with the estimate of g2, drawn to that of g1, drawn to that of g0."""
    out = groups
    for level in range(3):
        own = found.select(F.col("gid").alias(f"g{level}"), F.col("rows").alias(f"n{level}"), *(F.col(c).alias(f"{c}_{level}") for c in _MOMENTS))
        out = out.join(own, f"g{level}")
    for c in _MOMENTS:
        value = F.col(f"{c}_0") * (1 + F.lit(SHRINK) / F.col("n0")) if c.startswith("c") else F.col(f"{c}_0")
        for level in (1, 2):
            n = F.col(f"n{level}")
            value = (n * F.col(f"{c}_{level}") + SHRINK * value) / (n + SHRINK)
        out = out.withColumn(c, value)
    return _factor(out.select("g2", *_MOMENTS))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and the squared distance (null where the base rules fail).

    A null text has no words and fails the base rules. Null languages and sources are groups of their own. Small groups are
    drawn to larger ones, see above. Rows that repeat count as often as they stand. An empty table gives an empty
    result; other columns are not read."""
    rows = statistic_vectors(base_statistics(docs))
    keys = [f"g{i}" for i in range(3)]
    fit = materialize(rows.filter("NOT base_failed").select(*keys, F.col("doc_id").alias("uid"), *STATS), "quality-fit")
    groups = materialize(fit.select(*keys).distinct(), "quality-groups")
    found = mcd(fit.select(F.explode(F.array(*keys)).alias("gid"), "uid", *STATS))
    by_group = materialize(_drawn_together(groups, found), "quality-estimates")
    measured = _distance(_meet(rows, by_group, groups.count() <= MAX_BROADCAST, "g2", "left"))
    fine = ~F.col("base_failed") & (F.col("d2") <= chi2_quantile(CUT, len(STATS)))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(fine, F.lit(False)).alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance"))
