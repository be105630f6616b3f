"""Feature importances over folds: weighting, grouping, intervals, categories, draws, direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.resample import axis, subset_draws


def relative_gain(gains: DataFrame) -> DataFrame:
    """gains (fold, feature, gain) with rel: gain over the fold's total, 0 in a fold without gain."""
    total = F.sum("gain").over(Window.partitionBy("fold"))
    return gains.withColumn("rel", F.when(total > 0, F.col("gain") / total).otherwise(0.0))


def aggregated(gains: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature, importance_abs, importance_rel): means over folds weighted by the edges assigned to each (fold, edges)."""
    rows = relative_gain(gains).join(F.broadcast(weights), "fold")
    w = F.sum("edges")
    return rows.groupBy("feature").agg((F.sum(F.col("edges") * F.col("gain")) / w).alias("importance_abs"), (F.sum(F.col("edges") * F.col("rel")) / w).alias("importance_rel"))


def grouped(features: DataFrame, key: str) -> DataFrame:
    """(group_name, importance_abs, importance_rel) summed over the features of each rule or type; null keys are dropped."""
    return features.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("group_name")).agg(F.sum("importance_abs").alias("importance_abs"), F.sum("importance_rel").alias("importance_rel"))


def fold_matrix(gains: DataFrame, meta: DataFrame, folds: Sequence[str], key: str = "lr_name") -> DataFrame:
    """A row for each group, a column for each fold, of summed relative gain."""
    return relative_gain(gains).join(F.broadcast(meta), "feature").groupBy(key).pivot("fold", list(folds)).agg(F.sum("rel"))


def interval(rows: DataFrame, by: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    q = lambda p, n: F.percentile(value, p).alias(n)
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), q(0.5, "median"), q(alpha / 2, "lo"), q(1 - alpha / 2, "hi"))
    return out.withColumn("width", F.col("hi") - F.col("lo"))


def group_interval(gains: DataFrame, meta: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """Sums per fold and group first, then intervals over folds."""
    sums = relative_gain(gains).join(F.broadcast(meta), "feature").filter(F.col(key).isNotNull()).groupBy("fold", F.col(key).alias("group_name")).agg(F.sum("rel").alias("s"))
    return interval(sums, ["group_name"], "s", alpha)


def categorised(first: DataFrame, second: DataFrame, threshold: float = 1.2, least: float = 0.0) -> DataFrame:
    """Two importance tables (group_name, importance_rel) side by side: ratio, its log, bias label, and ranks (averages of
    ties, cut to whole numbers, highest first)."""
    a = first.select("group_name", F.col("importance_rel").alias("importance_sc"))
    b = second.select("group_name", F.col("importance_rel").alias("importance_fc"))
    both = a.join(b, "group_name", "full_outer").fillna(0.0, ["importance_sc", "importance_fc"])
    both = both.withColumn("importance_combined", F.col("importance_sc") + F.col("importance_fc")).filter(F.col("importance_combined") > least)
    ratio = (F.col("importance_sc") + 1e-10) / (F.col("importance_fc") + 1e-10)
    out = both.withColumns({"ratio": ratio, "log2_ratio": F.log2(ratio), "category": S.bias_label(F.col("importance_sc"), F.col("importance_fc"), threshold)})
    for name in ("sc", "fc", "combined"):
        v = f"importance_{name}"
        rank = F.rank().over(Window.orderBy(F.desc(v))) + (F.count("*").over(Window.partitionBy(v)) - 1) / F.lit(2.0)
        out = out.withColumn(f"rank_{name}", rank.cast("int"))
    return out


def matched_draws(rules: DataFrame, k: int, n: int, seed: int, target: float, tolerance: float, proposals: int, most: int | None = None) -> DataFrame:
    """(draw, lr_name): the first n random subsets of size k whose summed importance is within tolerance of target. rules:
    (lr_name, importance), a null importance being 0.

    Proposals are judged in rounds, `proposals` in the first and four times as many in each next one, until n are accepted;
    a draw is told by its number, so rounds don't change what is drawn. A target that isn't positive, fewer rules than k and
    more than `most` proposals (20,000 for each subset asked for) raise."""
    if target <= 0 or rules.count() < k:
        raise ValueError("a matched draw needs a positive target and as many rules as it takes")
    most = most or 20_000 * n
    accepted: list[int] = []
    at, size = 0, proposals
    while len(accepted) < n:
        if at >= most:
            raise ValueError(f"fewer than {n} of {most} draws come within {tolerance}")
        size = min(size, most - at)
        drawn = subset_draws(rules, "lr_name", k, size, seed, F.sequence(F.lit(at), F.lit(at + size - 1)))
        sums = drawn.join(rules, "lr_name").groupBy("draw").agg(F.sum(F.coalesce("importance", F.lit(0.0))).alias("total"))
        fine = sums.filter(F.abs(F.col("total") - target) / target <= tolerance).orderBy("draw").limit(n - len(accepted))
        accepted += [r.draw for r in fine.select("draw").collect()]  # n numbers at most
        at, size = at + size, size * 4
    return subset_draws(rules, "lr_name", k, n, seed, F.array(*map(F.lit, accepted)).cast("array<int>"))


def features_of(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Features whose rule is among rules (lr_name); a rule that no feature has raises."""
    if not rules.join(features.select("lr_name"), "lr_name", "left_anti").isEmpty():
        raise ValueError("a rule has no feature")
    return features.join(F.broadcast(rules.select("lr_name").distinct()), "lr_name", "left_semi")


def difference_interval(first: DataFrame, second: DataFrame, n: int, seed: int) -> DataFrame:
    """Independent fold resampling of two runs (fold, group_name, pct): intervals of each, of their difference and log
    ratio, the two-sided p of the difference (at least 1 / n) and its adjusted value."""

    def boots(rows: DataFrame, s: int, name: str) -> DataFrame:
        folds = rows.select("fold").distinct().withColumns({"_i": F.row_number().over(Window.orderBy("fold")) - 1, "_n": F.count("*").over(Window.partitionBy())})
        picks = axis(folds.select(F.col("_i").alias("_k"), "_n"), n, "boot").withColumn("_i", (S.hash_number(S.hash_key(s, "boot", "_k")) % F.col("_n")).cast("int"))
        drawn = picks.select("boot", "_i", "_n").join(F.broadcast(folds.select("_i", "fold")), "_i")
        return drawn.join(F.broadcast(rows), "fold").groupBy("boot", "group_name").agg((F.sum("pct") / F.first("_n")).alias(name))

    both = boots(first, seed, "a").join(boots(second, seed + 1, "b"), ["boot", "group_name"], "full_outer").fillna(0.0, ["a", "b"])
    d, ratio = F.col("a") - F.col("b"), F.log2((F.col("a") + 1e-10) / (F.col("b") + 1e-10))
    q = lambda v, p, name: F.percentile(v, p).alias(name)
    p = F.greatest(F.lit(1.0 / n), F.least(F.lit(1.0), 2 * F.least(F.avg((d < -1e-12).cast("double")), F.avg((d > 1e-12).cast("double")))))
    out = both.groupBy("group_name").agg(q("a", 0.025, "sc_lo"), q("a", 0.975, "sc_hi"), q("b", 0.025, "fc_lo"), q("b", 0.975, "fc_hi"), q(d, 0.025, "diff_lo"), q(d, 0.975, "diff_hi"), q(ratio, 0.025, "log2_lo"), q(ratio, 0.975, "log2_hi"), p.alias("p"))
    return S.bh_adjusted(out, "p", [], "fdr", ["group_name"])


def directionality(rows: DataFrame) -> DataFrame:
    """rows (feature, value, effect): mean absolute effect, correlation (0 where constant), share of positive effects above
    the median value, mean effects above and not above it, and the direction's name."""
    median = rows.groupBy("feature").agg(F.percentile("value", 0.5).alias("median"))
    at = rows.join(median, "feature").withColumn("high", F.col("value") > F.col("median"))
    out = at.groupBy("feature").agg(
        F.avg(F.abs("effect")).alias("mean_abs"), F.coalesce(S.correlation("value", "effect"), F.lit(0.0)).alias("r"),
        F.avg(F.when(F.col("high"), (F.col("effect") > 0).cast("double"))).alias("positive_when_high"),
        F.avg(F.when(F.col("high"), F.col("effect"))).alias("mean_high"), F.avg(F.when(~F.col("high"), F.col("effect"))).alias("mean_low"),
    )
    return out.withColumn("direction", F.when(F.col("r") > 0.1, "positive").when(F.col("r") < -0.1, "negative").otherwise("mixed"))
