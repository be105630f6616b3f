"""Rankings of types, regions, pairs and rules in a network, and its decay with distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.resample import bootstrap_means, shuffled_labels
from ..sources.work import cut

#: Words that place a type in a class, in the order in which they are tried.
CLASS_WORDS = (
    ("Excitatory", ("excitatory", "intratelencephalic", "corticothalamic", "near-projecting", "l2", "l3", "l4", "l5", "l6")),
    ("Inhibitory", ("inhibitory", "interneuron", "mge", "cge", "lamp5", "lhx6")),
    ("Glia", ("astro", "oligo", "opc", "micro", "ependymal", "bergmann", "choroid")),
)


def keyword_class(cell_type: str, words: Sequence[tuple[str, Sequence[str]]] = CLASS_WORDS) -> Column:
    """The first class one of whose words the lower-cased type contains, else Other."""
    name, out = F.lower(cell_type), F.lit(None).cast("string")
    for label, own in reversed(list(words)):
        hit = F.lit(False)
        for w in own:
            hit = hit | name.contains(w)
        out = F.when(hit, label).otherwise(out)
    return F.coalesce(out, F.lit("Other"))


def _node_sums(net: DataFrame, side: str) -> DataFrame:
    """(node, s, c): sum and number of the positive weights that leave (side sender) or enter (receiver) each node."""
    positive = F.col("weight") > 0
    return net.groupBy(F.col(side).alias("node")).agg(F.sum(F.when(positive, F.col("weight")).otherwise(0.0)).alias("s"), F.sum(positive.cast("long")).alias("c"))


def _mean_of_sums() -> Column:
    return F.when(F.sum("c") > 0, F.sum("s") / F.sum("c")).otherwise(0.0)


def directed_means(net: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(label, out_mean, in_mean): mean of positive weights leaving and entering the nodes with each label."""
    own = labels.select("node", label)
    out, into = (_node_sums(net, side).join(own, "node").groupBy(label).agg(_mean_of_sums().alias(f"{name}_mean")) for side, name in (("sender", "out"), ("receiver", "in")))
    return out.join(into, label, "full_outer").select(label, F.coalesce("out_mean", F.lit(0.0)).alias("out_mean"), F.coalesce("in_mean", F.lit(0.0)).alias("in_mean"))


def label_permutation_test(net: DataFrame, labels: DataFrame, label: str, n: int, seed: int) -> DataFrame:
    """directed_means with p_out, p_in (share of label shuffles at least as high, one added above and below), adjusted
    q_out, q_in and their stars. Senders and receivers are shuffled apart. The network is summed by node first, so shuffles
    are a row for each node and never meet pairs of nodes."""
    net, labels = cut(net), cut(labels)
    seen = cut(directed_means(net, labels, label))

    def null(side: str, s: int, name: str) -> DataFrame:
        drawn = shuffled_labels(labels, "node", label, n, s)
        means = drawn.join(_node_sums(net, side), "node").groupBy("perm", label).agg(_mean_of_sums().alias("m"))
        at = means.join(seen, label).groupBy(label)
        return at.agg(((F.sum((F.col("m") >= F.col(f"{name}_mean") - 1e-12).cast("long")) + 1) / (F.lit(n) + 1.0)).alias(f"p_{name}"))

    out = seen.join(null("sender", seed, "out"), label).join(null("receiver", seed + 1, "in"), label)
    for name in ("out", "in"):
        out = S.bh_adjusted(out, f"p_{name}", [], f"q_{name}", [label])
        out = out.withColumn(f"sig_{name}", S.significance(F.col(f"q_{name}")))
    return out


def bootstrap_interval(values: DataFrame, group: Sequence[str], value: str, order: Sequence[str], n: int, seed: int, least: int = 1) -> DataFrame:
    """(group, mean, lo, hi) of the means of n resamples of the positive values; under `least` values the plain mean."""
    positive = values.filter((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) < float("inf")))
    plain = positive.groupBy(*group).agg(F.avg(value).alias("plain"), F.count("*").alias("n"))
    boots = bootstrap_means(positive, group, value, order, n, seed).groupBy(*group).agg(F.avg("mean").alias("mean"), F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"))
    small = F.col("n") < least
    pick = lambda c: F.when(small, F.col("plain")).otherwise(F.col(c)).alias(c)
    return plain.join(boots, list(group)).select(*group, pick("mean"), pick("lo"), pick("hi"))


def top_pairs(net: DataFrame, labels: DataFrame, label: str, k: int) -> DataFrame:
    """The k strongest ordered pairs of different labels: (source, target, mean)."""
    a = F.broadcast(labels.select(F.col("node").alias("sender"), F.col(label).alias("source")))
    b = F.broadcast(labels.select(F.col("node").alias("receiver"), F.col(label).alias("target")))
    means = net.join(a, "sender").join(b, "receiver").filter("source <> target").groupBy("source", "target").agg(S.mean_positive("weight").alias("mean"))
    return means.filter("mean > 0").orderBy(F.desc("mean"), "source", "target").limit(k)


def ranked_rules(net: DataFrame, k: int, testable: int = 10) -> DataFrame:
    """(rank, lr_name, n_positive, mean, p, q, sig) of the k rules with the highest mean of positive scores.

    Shuffling a rule's scores over node pairs cannot change the mean of its positive ones, so p is 1 by definition where
    there are enough scores to test; label_permutation_test is the informative null."""
    found = net.groupBy("lr_name").agg(S.mean_positive("net").alias("mean"), F.count(F.when(F.col("net") > 0, 1)).alias("n_positive"))
    top = found.orderBy(F.desc("mean"), F.desc("lr_name")).limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), F.desc("lr_name")))).withColumn("p", F.when(F.col("n_positive") >= testable, 1.0))
    top = S.bh_adjusted(top, "p", [], "q", ["lr_name"])
    return top.withColumn("sig", F.when(F.col("q").isNull(), f"n<{testable}").otherwise(S.significance(F.col("q"))))


def decay(edges: DataFrame, groups: DataFrame, width: float, least_length: float, least_pairs: int = 10) -> tuple[DataFrame, DataFrame]:
    """Bins and correlations of strength against length, by category of the two ends.

    edges: (source, target, ct_source, ct_target, length, weight); groups: (cell_type, grp). Self edges and ungrouped
    types go; every pair of regions counts once a category, with the length of its least edge and its mean strength;
    a category of least_pairs pairs or fewer is left out; the bin of lengths below one width is named least_length."""
    own = edges.filter((F.col("source") != F.col("target")) & (F.col("length") > 0) & F.col("weight").isNotNull())
    a = F.broadcast(groups.select(F.col("cell_type").alias("ct_source"), F.col("grp").alias("gs")))
    b = F.broadcast(groups.select(F.col("cell_type").alias("ct_target"), F.col("grp").alias("gt")))
    pairs = own.join(a, "ct_source").join(b, "ct_target").withColumn("category", F.concat_ws("-", "gs", "gt"))
    pairs = pairs.groupBy("source", "target", "category").agg(F.min("length").alias("length"), F.avg("weight").alias("weight")).filter(F.col("length") >= least_length)
    enough = pairs.groupBy("category").agg(F.count("*").alias("n")).filter(F.col("n") > least_pairs).select("category")
    pairs = pairs.join(F.broadcast(enough), "category", "left_semi")
    low = F.floor(F.col("length") / width) * width
    binned = pairs.withColumn("bin", F.when(low == 0, F.lit(float(least_length))).otherwise(low.cast("double")))
    bins = binned.groupBy("category", "bin").agg(F.avg("weight").alias("mean"), F.coalesce(F.stddev_samp("weight"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    corr = pairs.groupBy("category").agg(F.count("*").alias("n"), S.correlation("length", "weight").alias("r"), F.avg("weight").alias("mean"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    return bins, corr
