"""Classes of rules and types, comparison of two models, gene lists, and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.resample import axis, hash_ranked
from ..functions.special import hypergeometric_upper
from ..sources.work import stored

#: A broad pathway and the parts of a rule's name that put it there, tried in this order.
PATHWAYS = (
    ("Neurexin-Neuroligin", ("NRXN", "NLGN", "LRRTM", "CLSTN")),
    ("Semaphorin-Plexin", ("SEMA", "NRP", "PLXN")),
    ("Slit-Robo", ("SLIT", "ROBO")),
    ("Neuregulin-ERBB", ("NRG", "ERBB")),
    ("Ephrin", ("EFN", "EPH")),
    ("Laminin-Integrin", ("LAM", "ITG", "CD44")),
    ("Teneurin-Latrophilin", ("TENM", "ADGRL")),
    ("FLRT-Adhesion", ("FLRT", "UNC5")),
    ("Cerebellin-Grid", ("CBLN", "GRID")),
    ("GABA_Signaling", ("GAD", "GABR", "SLC6A")),
    ("Glutamate_Signaling", ("GLUTAMATE", "GLU-")),
    ("Cell_Adhesion", ("NEGR", "LRRC4", "NTNG", "C1QL", "ADGRB")),
)

#: A rule's class and the tests for it, any of which is enough, tried in this order. A test is a list of
#: parts that must all be in the upper-cased name; a part that starts with ^ must begin it.
RULE_CLASSES = (
    ("GABA-A", (("GABA-A",), ("GABR_A",))),
    ("GABA-B", (("GABA-B",), ("GABBR",))),
    ("Glutamate", (("GLUTAMATE",), ("^GLU",), ("GRIK",), ("GRIA",), ("GRIN",), ("GRM",))),
    ("Neurexin", (("NRXN",),)),
    ("Neuregulin-ErbB", (("NRG", "ERBB"),)),
    ("Semaphorin-Plexin", (("SEMA",), ("PLXN",))),
    ("Slit-Robo", (("SLIT", "ROBO"),)),
    ("Collagen", (("^COL",),)),
    ("Neuroligin", (("NLGN",),)),
    ("LRRTM/LRRC", (("LRRTM",), ("LRRC4",))),
    ("FLRT", (("FLRT",),)),
    ("Ephrin", (("EFNA",), ("EPHA",), ("EPHB",))),
    ("Serotonin", (("5-HT",), ("HTR",))),
    ("Integrin", (("SPP1",), ("ITGA", "ITGB"))),
    ("BMP/GDF", (("^BMP",), ("^GDF",))),
    ("Wnt", (("^WNT",), ("FZD",))),
    ("FGF", (("^FGF",),)),
)

#: The class of each known type; unknown ones are Other.
TYPE_CLASSES = {
    "Excitatory": ("Deep-layer corticothalamic and 6b", "Deep-layer intratelencephalic", "Upper-layer intratelencephalic", "Deep-layer near-projecting", "Amygdala excitatory", "Thalamic excitatory"),
    "Inhibitory": ("MGE interneuron", "LAMP5-LHX6 and Chandelier", "Midbrain-derived inhibitory", "CGE interneuron", "Cerebellar inhibitory"),
    "Glia": ("Astrocyte", "Oligodendrocyte precursor", "Oligodendrocyte", "Committed oligodendrocyte precursor", "Microglia", "Bergmann glia"),
}


def rule_class(name: str) -> Column:
    upper, out = F.upper(name), F.lit("Other")
    for label, tests in reversed(RULE_CLASSES):
        hit = F.lit(False)
        for parts in tests:
            every = F.lit(True)
            for p in parts:
                every = every & (upper.startswith(p[1:]) if p[0] == "^" else upper.contains(p))
            hit = hit | every
        out = F.when(hit, label).otherwise(out)
    return out


def pathway(name: str) -> Column:
    upper, out = F.upper(name), F.lit("Other")
    for label, parts in reversed(PATHWAYS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | upper.contains(p)
        out = F.when(hit, label).otherwise(out)
    return out


def type_class(cell_type: str, classes: dict[str, Sequence[str]] | None = None) -> Column:
    out = F.lit("Other")
    for label, names in (classes or TYPE_CLASSES).items():
        out = F.when(F.col(cell_type).isin(list(names)), label).otherwise(out)
    return out


def plus_list(column: str) -> Column:
    """Members of a list held as text with plus signs, trimmed, without empty ones; null gives none."""
    parts = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), "\\+"), lambda g: F.trim(g))
    return F.filter(parts, lambda g: g != "")


def class_matrix(features: DataFrame, classes: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(sender_class, receiver_class, importance) from (ct_l, ct_r, importance)."""
    return features.groupBy(type_class("ct_l", classes).alias("sender_class"), type_class("ct_r", classes).alias("receiver_class")).agg(F.sum("importance").alias("importance"))


def compared(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str, threshold: float = 1.2) -> DataFrame:
    """Two tables side by side on keys, 0 where one lacks a key: sc, fc, log2_ratio, label."""
    both = first.select(*keys, F.col(value).alias("sc")).join(second.select(*keys, F.col(value).alias("fc")), list(keys), "full_outer").fillna(0.0, ["sc", "fc"])
    return both.withColumns({"log2_ratio": F.log2((F.col("sc") + 1e-10) / (F.col("fc") + 1e-10)), "label": S.bias_label(F.col("sc"), F.col("fc"), threshold)})


def top_overlap(first: DataFrame, second: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """(name, rank_a, rank_b, jaccard): members of both top-k lists, and the share of common ones in all."""
    top = lambda df, r: df.orderBy(F.desc(value), name).limit(k).select(name, F.row_number().over(Window.orderBy(F.desc(value), name)).alias(r))
    both = top(first, "rank_a").join(top(second, "rank_b"), name, "full_outer")
    return both.withColumn("jaccard", F.count(F.when(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull(), 1)).over(Window.partitionBy()) / F.count("*").over(Window.partitionBy())).filter("rank_a IS NOT NULL AND rank_b IS NOT NULL")


def pathway_summary(categorised: DataFrame, threshold: float = 1.2) -> DataFrame:
    """By pathway of the rule's name: rules, sums for either side and both, and the bias label."""
    out = categorised.groupBy(pathway("group_name").alias("pathway")).agg(F.count("*").alias("rules"), F.sum("importance_sc").alias("sc"), F.sum("importance_fc").alias("fc"))
    return out.withColumns({"combined": F.col("sc") + F.col("fc"), "label": S.bias_label(F.col("sc"), F.col("fc"), threshold)})


def category_genes(categorised: DataFrame, genes: DataFrame, labels: Sequence[str] = ("SC-biased", "FC-biased", "Balanced")) -> DataFrame:
    """(category, genes): the distinct sorted genes of each category's rules; categories without a gene have none.
    genes: (lr_name, gene)."""
    spark = categorised.sparkSession
    own = categorised.select(F.col("group_name").alias("lr_name"), "category").join(genes, "lr_name").groupBy("category").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    return spark.createDataFrame([(x,) for x in labels], "category string").join(own, "category", "left").withColumn("genes", F.coalesce("genes", F.array().cast("array<string>")))


def gene_ranking(categorised: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, score, n): mean log ratio over the rules with the gene, a gene named on both sides counting twice. Rules
    without a gene list are split at the first underscore of their name; those without one are passed over."""
    listed = genes.groupBy("lr_name").agg(F.collect_list("gene").alias("all"))
    parts = F.split("lr_name", "_", 2)
    rows = categorised.select(F.col("group_name").alias("lr_name"), F.log2((F.col("importance_sc") + 1e-10) / (F.col("importance_fc") + 1e-10)).alias("x")).join(listed, "lr_name", "left")
    rows = rows.withColumn("all", F.coalesce("all", F.when(F.size(parts) == 2, parts).otherwise(F.array().cast("array<string>"))))
    return rows.select("x", F.explode("all").alias("gene")).filter("gene <> ''").groupBy("gene").agg(F.avg("x").alias("score"), F.count("*").alias("n"))


def over_representation(hits: DataFrame, universe: DataFrame, sets: DataFrame, least: int = 3) -> DataFrame:
    """(set_name, k, size, p, q): chance of k or more of the set's genes among the hits, and its step-up adjusted value.
    hits, universe: (gene); sets: (set_name, gene). Fewer than `least` hits give nothing."""
    inside = hits.distinct().join(universe, "gene", "left_semi")
    n_hits, n_all = inside.count(), universe.distinct().count()
    own = sets.distinct().join(universe.distinct(), "gene", "left_semi").join(inside.withColumn("hit", F.lit(1)), "gene", "left")
    found = own.groupBy("set_name").agg(F.count("hit").alias("k"), F.count("*").alias("size")).filter(F.lit(n_hits >= least) & (F.col("k") > 0))

    def work(batches):
        for pdf in batches:
            pdf["p"] = [hypergeometric_upper(int(k), n_all, int(s), n_hits) for k, s in zip(pdf["k"], pdf["size"], strict=True)]
            yield pdf.astype({"p": float})

    return S.bh_adjusted(found.mapInPandas(work, "set_name string, k long, size long, p double"), "p", [], "q", ["set_name"])


def _set_scores(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, set_name, size, es) from (by, set_name, place, weight, n_all): a set's members with their places from 1.

    Between members the running sum only falls, so it is highest after a member and lowest before one (or 0, where it ends):
    a set's sorted places are all that its score needs, not a row for each gene outside it."""
    own = members.groupBy(*by, "set_name").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("m"), F.sum("weight").alias("total"), F.first("n_all").alias("n_all"))
    size = F.size("m")
    miss = F.when(F.col("n_all") > size, 1.0 / (F.col("n_all") - size)).otherwise(0.0)
    zero = F.lit(0.0)

    def step(run, x):
        fall = (x["place"] - run["i"] - 1) * miss
        up = run["h"] + F.when(F.col("total") > 0, x["weight"] / F.col("total")).otherwise(1.0 / size)
        return F.struct((run["i"] + 1).alias("i"), up.alias("h"), F.greatest(run["hi"], up - fall).alias("hi"), F.least(run["lo"], run["h"] - fall).alias("lo"))

    ends = F.aggregate("m", F.struct(F.lit(0).alias("i"), zero.alias("h"), zero.alias("hi"), zero.alias("lo")), step)
    out = own.select(*by, "set_name", size.cast("long").alias("size"), ends.alias("e"))
    return out.select(*by, "set_name", "size", F.when(F.col("e.hi") >= -F.col("e.lo"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("es"))


def _placed(ranking: DataFrame) -> DataFrame:
    """(gene, weight, place, n_all): the genes from the highest score down; a ranking is one row a gene."""
    return ranking.select("gene", F.abs("score").alias("weight"), F.row_number().over(Window.orderBy(F.desc("score"), "gene")).alias("place"), F.count("*").over(Window.partitionBy()).alias("n_all"))


def running_enrichment(ranking: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_name, size, es): greatest deviation of the running sum over genes from the highest score down; members add
    their share of absolute score, others take away an equal share. ranking: (gene, score); sets: (set_name, gene)."""
    return _set_scores(_placed(ranking).join(sets.distinct(), "gene"), [])


def ranked_enrichment(ranking: DataFrame, sets: DataFrame, n: int, seed: int, least: int = 10, most: int = 500) -> DataFrame:
    """running_enrichment with p, the normalised score and its adjusted value from n permutations, each of which gives every
    gene another's place and score; sets with fewer than least or more than most genes of the ranking are left out.

    Rows are genes times permutations for the shuffles, then members times permutations; a set's members in a permutation are
    one sorted array of at most `most`. A permutation's genes are ordered by one task, and everything after stays there: the
    tables of places and of members are stored, so Spark knows their sizes and broadcasts them if they are small."""
    sized = sets.distinct().join(ranking.select("gene"), "gene", "left_semi")
    fine = sized.groupBy("set_name").count().filter(F.col("count").between(least, most)).select("set_name")
    own = stored(sized.join(fine, "set_name", "left_semi"))
    placed = stored(_placed(ranking))
    seen = _set_scores(placed.join(own, "gene"), [])
    plain = stored(hash_ranked(placed.withColumn("_k", S.hash_key(seed, -1, "gene")), [], "_k", ["gene"], "_r").select("_r", "weight", "place", "n_all"))
    key = F.unhex(S.hash_key(seed, "perm", "gene"))  # half the bytes to shuffle and sort, in the same order
    order = Window.partitionBy("perm").orderBy("_k", "gene")
    drawn = axis(placed.select("gene"), n, "perm").withColumn("_k", key).withColumn("_r", F.row_number().over(order).cast("long")).select("perm", "gene", "_r")
    members = drawn.join(plain, "_r").join(own, "gene").select("perm", "set_name", "place", "weight", "n_all")
    null = _set_scores(members, ["perm"]).select("set_name", F.col("es").alias("null_es"))
    both = null.join(seen, "set_name").withColumn("same", F.signum("null_es") == F.signum("es"))
    out = both.groupBy("set_name", "size", "es").agg(
        ((F.sum((F.col("same") & (F.abs("null_es") >= F.abs("es") - 1e-12)).cast("long")) + 1) / (F.sum(F.col("same").cast("long")) + 1)).alias("p"),
        F.try_divide(F.first("es"), F.avg(F.when(F.col("same"), F.abs("null_es")))).alias("nes"),
    )
    return S.bh_adjusted(out, "p", [], "q", ["set_name"])


def signed_results(results: Sequence[DataFrame], limit: float = 0.25) -> DataFrame:
    """Enrichment results put together, without those that have no normalised score, with their direction."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.filter(F.col("nes").isNotNull()).withColumns({"direction": F.when(F.col("nes") >= 0, "up").otherwise("down"), "significant": F.col("q") < limit})
