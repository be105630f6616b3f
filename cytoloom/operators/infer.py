"""Interaction inference: rules, group expression, side scores, observed and tested networks.

Everything is long: one row per node and gene, per node and rule side, per sender, receiver and rule. Rules are joined
by name, so a sender-receiver product is an equi-join, never a cross join of nodes with nodes of other rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.resample import axis, shuffled_labels
from ..sources.work import stored
from .shuffles import shuffled_expression

METHODS = ("default", "hill", "minmean")


def rule_genes(rules: DataFrame) -> DataFrame:
    """(lr_name, side, gene, grp): a row for each gene of a rule's side; side is lig or rec."""

    def side(name: str, prefix: str) -> DataFrame:
        pairs = F.explode(F.arrays_zip(F.col(prefix).alias("gene"), F.col(f"{prefix}_group").alias("grp"))).alias("p")
        return rules.select("lr_name", F.lit(name).alias("side"), pairs).select("lr_name", "side", "p.gene", "p.grp")

    return side("lig", "lig_contributor").unionByName(side("rec", "receptor_subunit"))


def rule_coefficients(rules: DataFrame) -> DataFrame:
    """(lr_name, side, grp, coeff): the groups of a side and their whole coefficients; fractions are cut off."""

    def side(name: str, prefix: str) -> DataFrame:
        return rules.select("lr_name", F.lit(name).alias("side"), F.posexplode(f"{prefix}_coeff").alias("at", "c")).select("lr_name", "side", (F.col("at") + 1).alias("grp"), F.col("c").cast("int").alias("coeff"))

    return side("lig", "lig_contributor").unionByName(side("rec", "receptor_subunit"))


def add_rule(rules: DataFrame, name: str, ligand: Sequence[str], receptor: Sequence[str], *, ligand_group: Sequence[int] | None = None, receptor_group: Sequence[int] | None = None, ligand_coeff: Sequence[float] | None = None, receptor_coeff: Sequence[float] | None = None) -> DataFrame:
    """rules with one more. Groups default to 1, coefficients to 1.0; a taken name or unequal lengths raise."""
    lg, rg = list(ligand_group or [1] * len(ligand)), list(receptor_group or [1] * len(receptor))
    lc, rc = list(ligand_coeff or [1.0] * len(set(lg))), list(receptor_coeff or [1.0] * len(set(rg)))
    if len(lg) != len(ligand) or len(rg) != len(receptor):
        raise ValueError("each gene needs one group")
    if len(lc) != len(set(lg)) or len(rc) != len(set(rg)):
        raise ValueError("each group needs one coefficient")
    if not rules.filter(F.col("lr_name") == name).isEmpty():
        raise ValueError(f"rule {name!r} exists")
    row = (name, list(ligand), lg, [float(x) for x in lc], list(receptor), rg, [float(x) for x in rc])
    return rules.unionByName(rules.sparkSession.createDataFrame([row], "lr_name string, lig_contributor array<string>, lig_contributor_group array<int>, lig_contributor_coeff array<double>, receptor_subunit array<string>, receptor_subunit_group array<int>, receptor_subunit_coeff array<double>"))


def eligible_rules(rules: DataFrame, panel: DataFrame, strict: int = 1) -> DataFrame:
    """(lr_name, eligible): strict 1 wants every group of both sides in the panel (gene), 0 wants a gene of either side."""
    marked = rule_genes(rules).join(panel.select("gene").distinct().withColumn("there", F.lit(1)), "gene", "left")
    groups = marked.groupBy("lr_name", "side", "grp").agg(F.max(F.coalesce("there", F.lit(0))).alias("there"))
    sides = groups.groupBy("lr_name", "side").agg((F.min("there") if strict == 1 else F.max("there")).alias("there"))
    return sides.groupBy("lr_name").agg(((F.min("there") == 1) & (F.count("*") == 2)).alias("eligible"))


def signalling(expr: DataFrame, rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, cell_id, gene, value): expression of the rules' genes over its greatest value within `by`; left as it is where
    nothing is above zero."""
    own = expr.join(F.broadcast(rule_genes(rules).select("gene").distinct()), "gene", "left_semi")
    if by:
        scaled = own.join(own.groupBy(*by).agg(F.max("value").alias("most")), list(by))
    else:
        scaled = own.join(F.broadcast(own.agg(F.max("value").alias("most"))))
    return scaled.select(*by, "cell_id", "gene", F.when(F.col("most") > 0, F.col("value") / F.col("most")).otherwise(F.col("value")).alias("value"))


def group_expression(expr: DataFrame, labels: DataFrame, how: str = "triquartile", by: Sequence[str] = (), dense: bool = True, panel: DataFrame | None = None) -> DataFrame:
    """(by, node, gene, value) from expr (cell_id, gene, value) and labels (by, cell_id, node).

    Zeros are not stored: each node and gene gets one weighted zero for its cells without a row, so quantiles count them
    and no dense table of cells is made. Without dense, nodes have no row for genes that none of their cells has; with it,
    they have one for each gene of panel (gene, each once), or of expr where no panel is given."""
    if how not in ("triquartile", "mean"):
        raise ValueError(f"unknown mean {how!r}")
    seen = labels.join(expr, "cell_id").groupBy(*by, "node", "gene", "value").agg(F.count("*").alias("w"))
    sizes = labels.groupBy(*by, "node").agg(F.count("*").alias("size"))
    held = seen.groupBy(*by, "node", "gene").agg(F.sum("w").alias("held"))
    genes = expr.select("gene").distinct() if panel is None else panel.select("gene")
    there = sizes.crossJoin(genes).join(held, [*by, "node", "gene"], "left") if dense else held.join(sizes, [*by, "node"])
    zeros = there.select(*by, "node", "gene", F.lit(0.0).alias("value"), (F.col("size") - F.coalesce("held", F.lit(0))).alias("w")).filter("w > 0")
    rows = seen.unionByName(zeros)
    value = S.tri_quartile("value", "w") if how == "triquartile" else F.sum(F.col("value") * F.col("w")) / F.sum("w")
    return rows.groupBy(*by, "node", "gene").agg(value.alias("value"))


def side_scores(grouped: DataFrame, rules: DataFrame, method: str = "default", k: float = 0.5, by: Sequence[str] = (), panel: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(by, lr_name, side, node, score) for all rules at once from (by, node, gene, value).

    default: mean of each group's genes, a group without any counts 1, then the geometric mean of the groups with each
    taken as often as its coefficient says; any zero gives zero. hill: geometric mean of the genes. minmean: the least.
    Where grouped isn't dense, panel (gene) says which genes there are, and nodes (by, node) which nodes; only default
    takes them."""
    genes = F.broadcast(rule_genes(rules))
    rows = grouped.join(genes, "gene")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "minmean":
        return rows.groupBy(*by, "lr_name", "side", "node").agg(F.min("value").alias("score"))
    if method == "hill":
        safe = F.when(F.col("value") > 0, F.log("value"))
        return rows.groupBy(*by, "lr_name", "side", "node").agg(F.when(F.min("value") <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(safe))).alias("score"))
    groups = rows.groupBy(*by, "lr_name", "side", "node", "grp").agg(F.sum("value").alias("x"), F.count("*").alias("n"))
    nodes = grouped.select(*by, "node").distinct() if nodes is None else nodes
    coefficients = rule_coefficients(rules)
    if panel is not None:
        sizes = rule_genes(rules).join(panel.select("gene").distinct(), "gene").groupBy("lr_name", "side", "grp").agg(F.count("*").alias("known"))
        coefficients = coefficients.join(sizes, ["lr_name", "side", "grp"], "left")
    full = nodes.crossJoin(F.broadcast(coefficients)).join(groups, [*by, "lr_name", "side", "node", "grp"], "left")  # the rules are a small table
    if panel is None:
        full = full.withColumn("x", F.coalesce(F.col("x") / F.col("n"), F.lit(1.0)))
    else:
        full = full.withColumn("x", F.when(F.col("known").isNull(), 1.0).otherwise(F.coalesce("x", F.lit(0.0)) / F.col("known")))
    weight = F.sum("coeff").cast("double")
    log = F.sum(F.when(F.col("coeff") > 0, F.col("coeff") * F.log(F.when(F.col("x") > 0, F.col("x")))))
    zero = F.max(((F.col("coeff") > 0) & (F.col("x") <= 0)).cast("int")) == 1
    return full.groupBy(*by, "lr_name", "side", "node").agg(F.when(zero, F.lit(0.0)).otherwise(F.exp(log / weight)).alias("score"))


def combine(lig: Column, rec: Column, method: str = "default", k: float = 0.5) -> Column:
    if method == "hill":
        return S.hill(lig, k) * S.hill(rec, k)
    if method == "minmean":
        return F.when((lig > 0) & (rec > 0), (lig + rec) / 2).otherwise(F.lit(0.0))
    return lig * rec


def observed_network(scores: DataFrame, method: str = "default", k: float = 0.5, by: Sequence[str] = (), senders: Sequence[str] | None = None, receivers: Sequence[str] | None = None) -> DataFrame:
    """(by, lr_name, sender, receiver, prob) of every pair of nodes within a rule; senders and receivers narrow them."""
    lig = scores.filter("side = 'lig'").select(*by, "lr_name", F.col("node").alias("sender"), F.col("score").alias("lig"))
    rec = scores.filter("side = 'rec'").select(*by, "lr_name", F.col("node").alias("receiver"), F.col("score").alias("rec"))
    if senders is not None:
        lig = lig.filter(F.col("sender").isin(list(senders)))
    if receivers is not None:
        rec = rec.filter(F.col("receiver").isin(list(receivers)))
    return lig.join(rec, [*by, "lr_name"]).select(*by, "lr_name", "sender", "receiver", combine(F.col("lig"), F.col("rec"), method, k).alias("prob"))


def permuted_labels(labels: DataFrame, m: int, seed: int, senders: Sequence[str] | None = None, receivers: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, perm, cell_id, node): m shuffles of labels (by, cell_id, node) within `by`. Where senders or receivers are named,
    cells of the receivers trade labels among themselves, the other cells of the senders take theirs from a shuffle of all
    cells of the senders, and all other cells keep their own."""
    if senders is None and receivers is None:
        return shuffled_labels(labels, "cell_id", "node", m, seed, by)
    of = lambda nodes: F.lit(True) if nodes is None else F.col("node").isin(list(nodes))
    sent, received = of(senders), of(receivers)
    own = lambda rows, at: shuffled_labels(rows, "cell_id", "node", m, at, by)
    keep = labels.filter(sent & ~received).select("cell_id")
    names = [*by, "perm", "cell_id", "node"]
    rest = axis(labels.filter(~sent & ~received), m, "perm").select(*names)
    return own(labels.filter(received), seed + 1).unionByName(own(labels.filter(sent), seed).join(keep, "cell_id", "left_semi").select(*names)).unionByName(rest)


def _trades(seed: int, senders: Sequence[str] | None, receivers: Sequence[str] | None) -> list[tuple[Column, int]]:
    """The sets of cells that trade labels, as permuted_labels has them; the later one counts."""
    if senders is None and receivers is None:
        return [(F.lit(True), seed)]
    of = lambda nodes: F.lit(True) if nodes is None else F.col("node").isin(list(nodes))
    return [(of(senders), seed), (of(receivers), seed + 1)]


def permutation_pvalues(expr: DataFrame, labels: DataFrame, rules: DataFrame, observed: DataFrame, m: int, seed: int, how: str = "triquartile", method: str = "default", k: float = 0.5, senders: Sequence[str] | None = None, receivers: Sequence[str] | None = None, by: Sequence[str] = (), panel: DataFrame | None = None) -> DataFrame:
    """observed with pvalue: the share of m label shuffles (see permuted_labels) whose score is above, strictly. One shuffle
    serves all rules. Rules that are zero everywhere (within `by`), and all rules when m is 0, get none.

    Shuffles are counted by blocks of cells (see shuffles). The null scores of a rule's side at a node are one array of m
    numbers, so pairs of nodes are shuffled once and not m times: each observed pair meets its two arrays and counts. panel (gene) says which genes there are, those of expr where
    it isn't given."""
    if m == 0:
        return observed.withColumn("pvalue", F.lit(None).cast("double"))
    observed = stored(observed)
    living = observed.filter("prob > 0").select(*by, "lr_name").distinct()
    alive = rules.join(living.select("lr_name").distinct(), "lr_name", "left_semi")
    expr = expr.join(F.broadcast(rule_genes(alive).select("gene").distinct()), "gene", "left_semi")
    keys = [*by, "perm"]
    found = stored(shuffled_expression(expr, labels.select(*by, "cell_id", "node"), m, _trades(seed, senders, receivers), how, by))
    grouped, nodes = found.filter("gene IS NOT NULL"), found.filter("gene IS NULL").select(*keys, "node")
    panel = grouped.select("gene").distinct() if panel is None else panel.select("gene")
    if method != "default":
        grouped = nodes.crossJoin(F.broadcast(panel)).join(grouped, [*keys, "node", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    more = {"panel": panel, "nodes": nodes} if method == "default" else {}
    scores = side_scores(grouped, alive, method, k, by=keys, **more)
    if by:
        scores = scores.join(living, [*by, "lr_name"], "left_semi")
    own = scores.groupBy(*by, "lr_name", "side", "node").agg(F.map_from_entries(F.collect_list(F.struct("perm", "score"))).alias("by_perm"))
    own = own.select(*by, "lr_name", "side", "node", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.col("by_perm")[i]).alias("null"))
    lig = own.filter("side = 'lig'").select(*by, "lr_name", F.col("node").alias("sender"), F.col("null").alias("null_lig"))
    rec = own.filter("side = 'rec'").select(*by, "lr_name", F.col("node").alias("receiver"), F.col("null").alias("null_rec"))
    above = F.zip_with("null_lig", "null_rec", lambda a, b: F.when(combine(a, b, method, k) > F.col("prob") * (1 + 1e-12), 1).otherwise(0))
    share = F.aggregate(above, F.lit(0), lambda total, x: total + x) / float(m)
    return observed.join(lig, [*by, "lr_name", "sender"], "left").join(rec, [*by, "lr_name", "receiver"], "left").select(*observed.columns, share.alias("pvalue"))


def run_inference(expr: DataFrame, labels: DataFrame, rules: DataFrame, *, senders: Sequence[str] | None = None, receivers: Sequence[str] | None = None, m: int = 100, fdr: float = 0.05, k: float = 0.5, method: str = "default", how: str = "triquartile", strict: int = 1, seed: int = 42) -> DataFrame:
    """(lr_name, sender, receiver, prob, pvalue, net) from raw expression (cell_id, gene, value) and labels (cell_id, node):
    scaled signal, eligible rules, group expression, side scores, network, m shuffles and the place-by-place filter."""
    signal = stored(signalling(expr, rules))
    fine = eligible_rules(rules, signal.select("gene"), strict).filter("eligible")
    own = rules.join(fine, "lr_name", "left_semi")
    scores = side_scores(group_expression(signal, labels, how), own, method, k)
    observed = observed_network(scores, method, k, senders=senders, receivers=receivers)
    return filtered_network(permutation_pvalues(signal, labels, own, observed, m, seed, how, method, k, senders, receivers), fdr)


def run_by_subject(expr: DataFrame, cells: DataFrame, rules: DataFrame, panel: DataFrame, *, senders: Sequence[str] | None = None, receivers: Sequence[str] | None = None, m: int = 100, fdr: float = 0.05, k: float = 0.5, method: str = "default", how: str = "triquartile", strict: int = 1, seed: int = 42) -> DataFrame:
    """(subject, lr_name, sender, receiver, prob, pvalue, net): run_inference of every subject of cells (subject, cell_id, node)
    by itself, all in one plan with the subject as a leading key of scaling, group expression, shuffles and filter.

    A subject's result depends on its own cells, the rules and panel (gene: what was measured, for all subjects alike), never
    on which other subjects run with it. Cells without subject or node take no part; cell ids are unique across subjects.
    A gene of the panel that a subject lacks counts as zero there. Which subjects run is the caller's choice
    (subjects_to_run)."""
    by = ["subject"]
    labels = stored(cells.filter("subject IS NOT NULL AND node IS NOT NULL").select("subject", "cell_id", "node"))
    own = rules.join(eligible_rules(rules, panel, strict).filter("eligible"), "lr_name", "left_semi")
    measured = F.broadcast(panel.select("gene").distinct())
    raw = expr.join(labels.select("subject", "cell_id"), "cell_id").join(measured, "gene", "left_semi")
    signal = stored(signalling(raw, rules, by).select("cell_id", "gene", "value"))
    used = panel.select("gene").distinct().join(F.broadcast(rule_genes(own).select("gene").distinct()), "gene", "left_semi")
    grouped = group_expression(signal, labels, how, by, panel=used)
    observed = observed_network(side_scores(grouped, own, method, k, by), method, k, by, senders, receivers)
    return filtered_network(permutation_pvalues(signal, labels, own, observed, m, seed, how, method, k, senders, receivers, by, used), fdr, by)


def filtered_network(tested: DataFrame, fdr: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """tested with net: prob where the place-by-place filter of its rule (within `by`) keeps it, else 0; rules without p
    keep all."""
    place = F.row_number().over(Window.partitionBy(*by, "lr_name").orderBy("pvalue", "receiver", "sender"))
    limit = F.lit(fdr) * place / F.count("*").over(Window.partitionBy(*by, "lr_name"))
    return tested.withColumn("net", F.when(F.col("pvalue").isNull() | (F.col("pvalue") < limit), F.col("prob")).otherwise(0.0))


def rule_summary(scores: DataFrame, net: DataFrame) -> DataFrame:
    """(lr_name, fc, info): the wider of the two sides' ranges over nodes, and the network's total."""
    span = scores.groupBy("lr_name", "side").agg((F.max("score") - F.min("score")).alias("span")).groupBy("lr_name").agg(F.max("span").alias("fc"))
    return span.join(net.groupBy("lr_name").agg(F.sum("net").alias("info")), "lr_name")


def aggregate_network(net: DataFrame, how: str = "weight", cut: float = 0.05) -> DataFrame:
    """(sender, receiver, weight) over rules: weight, count, weighted_count, weighted_count2 or weight_threshold."""
    n = F.col("net")
    if how == "weight":
        rows, value = net, n
    elif how == "count":
        rows, value = net, (n > 0).cast("double")
    elif how in ("weighted_count", "weighted_count2", "weight_threshold"):
        totals = net.groupBy("lr_name").agg(F.sum("net").alias("total"), F.percentile("net", cut).alias("limit"))
        rows = net.join(totals, "lr_name")
        over = F.col("net") > F.col("limit")
        if how == "weighted_count":
            value = F.when(n > 0, F.col("total")).otherwise(0.0)
        elif how == "weight_threshold":
            value = F.when(over, n).otherwise(0.0)
        else:
            above = rows.groupBy("lr_name").agg(F.sum(over.cast("double")).alias("above"))
            rows, value = rows.join(above, "lr_name"), F.when(over, F.col("total") / (F.col("above") + 1e-6)).otherwise(0.0)
    else:
        raise ValueError(f"unknown aggregation {how!r}")
    return rows.groupBy("sender", "receiver").agg(F.sum(value).alias("weight"))


def merge_runs(runs: dict[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Runs one under the other with their name in `datasets`; columns that some run lacks are left out."""
    shared = list(columns) if columns else [c for c in next(iter(runs.values())).columns if all(c in r.columns for r in runs.values())]
    out = None
    for name, run in runs.items():
        part = run.select(*shared, F.lit(name).alias("datasets"))
        out = part if out is None else out.unionByName(part)
    return out


def shared_genes(panels: Sequence[DataFrame], signals: Sequence[DataFrame] | None = None) -> DataFrame:
    """Genes of every panel; with signals, those of them that any signal uses."""
    out = panels[0].select("gene").distinct()
    for p in panels[1:]:
        out = out.intersect(p.select("gene"))
    if signals:
        used = signals[0].select("gene")
        for s in signals[1:]:
            used = used.union(s.select("gene"))
        out = out.join(used.distinct(), "gene", "left_semi")
    return out


def subjects_to_run(cells: DataFrame, done: DataFrame, min_cells: int = 10, min_groups: int = 2) -> DataFrame:
    """(subject, cells, groups) still to do: known subjects with enough cells and nodes and no finished run."""
    sizes = cells.filter("subject IS NOT NULL AND node IS NOT NULL").groupBy("subject").agg(F.count("*").alias("cells"), F.countDistinct("node").alias("groups"))
    return sizes.filter((F.col("cells") >= min_cells) & (F.col("groups") >= min_groups)).join(done.select("subject"), "subject", "left_anti")
