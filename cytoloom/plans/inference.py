"""Queries over inference: panels, rules, scores, networks and their tests.

Products of scaled quantities often end in a 5 at the seventh place; where they are returned, 1e-10 is added before
rounding, in the SQL as well, so that both engines round the same way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import infer
from ..sources import domain
from ..sources.work import stored
from .registry import CELLS, EXPR, query

PERMUTATIONS, SEED = 100, 42


def _values() -> str:
    """The rule table as SQL rows (lr_name, side, gene, grp) and (lr_name, side, grp, coeff)."""
    genes, coeffs = [], []
    for name, lig, lig_grp, lig_c, rec, rec_grp, rec_c in domain.RULES:
        for side, own, grp, c in (("lig", lig, lig_grp, lig_c), ("rec", rec, rec_grp, rec_c)):
            genes += [f"('{name}', '{side}', '{g}', {i})" for g, i in zip(own, grp, strict=True)]
            coeffs += [f"('{name}', '{side}', {i}, {int(x)})" for i, x in enumerate(c, 1)]
    return f"lr_gene(lr_name, side, gene, grp) AS (VALUES {', '.join(genes)}), lr_coeff(lr_name, side, grp, coeff) AS (VALUES {', '.join(coeffs)})"


RULES = _values()
SIGNAL = "signal AS (SELECT cell_id, gene, value / (SELECT max(value) FROM expr WHERE gene IN (SELECT gene FROM lr_gene)) AS value FROM expr WHERE gene IN (SELECT gene FROM lr_gene))"
DENSE = "dense AS (SELECT c.cell_id, c.node, g.gene, coalesce(s.value, 0) AS value FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM signal) g LEFT JOIN signal s ON s.cell_id = c.cell_id AND s.gene = g.gene)"
TRI = "0.25 * quantile_cont(value, 0.25) + 0.5 * quantile_cont(value, 0.5) + 0.25 * quantile_cont(value, 0.75)"
GROUPED = f"grouped AS (SELECT node, gene, {TRI} AS value FROM dense GROUP BY 1, 2)"
ELIGIBLE = "ok AS (SELECT lr_name FROM (SELECT lr_name, side, grp, max(CASE WHEN gene IN (SELECT gene FROM expr) THEN 1 ELSE 0 END) AS there FROM lr_gene GROUP BY 1, 2, 3) GROUP BY lr_name HAVING min(there) = 1)"


def _scores(keys: str = "", source: str = "grouped") -> str:
    """Default side scores; keys is '' or 'perm, '."""
    on = "AND x.perm = n.perm " if keys else ""
    n_keys = "n.perm, " if keys else ""
    return f"""gx AS (SELECT {keys}lr_name, side, node, grp, avg(value) AS x FROM {source} JOIN lr_gene USING (gene) GROUP BY ALL),
        scored AS (SELECT {n_keys}c.lr_name, c.side, n.node,
            CASE WHEN max(CASE WHEN c.coeff > 0 AND coalesce(x.x, 1.0) <= 0 THEN 1 ELSE 0 END) = 1 THEN 0.0
                 ELSE exp(sum(CASE WHEN coalesce(x.x, 1.0) > 0 THEN c.coeff * ln(coalesce(x.x, 1.0)) END) / sum(c.coeff)) END AS score
            FROM (SELECT DISTINCT {keys}node FROM {source}) n CROSS JOIN lr_coeff c
            LEFT JOIN gx x ON x.lr_name = c.lr_name AND x.side = c.side AND x.node = n.node AND x.grp = c.grp {on}
            GROUP BY ALL)"""


NETWORK = "net0 AS (SELECT a.lr_name, a.node AS sender, b.node AS receiver, a.score * b.score AS prob FROM scored a JOIN scored b ON a.lr_name = b.lr_name WHERE a.side = 'lig' AND b.side = 'rec' AND a.lr_name IN (SELECT lr_name FROM ok))"
BASE = f"WITH {CELLS}, {EXPR}, {RULES}, {SIGNAL}, {DENSE}, {GROUPED}, {ELIGIBLE}, {_scores()}, {NETWORK}"


def inputs(spark, sf_dir):
    """Signalling expression, labels, and the rules whose genes the panel has. The expression comes from a join of the
    three largest tables and is used several times over, so it is worked out once."""
    table = domain.rule_table(spark)
    signal = stored(infer.signalling(domain.expression(spark, sf_dir), table))
    fine = infer.eligible_rules(table, signal.select("gene")).filter("eligible")
    return signal, domain.cells(spark, sf_dir).select("cell_id", "node"), table.join(fine, "lr_name", "left_semi")


def parts(spark, sf_dir, how="triquartile"):
    """inputs and group expression."""
    signal, labels, own = inputs(spark, sf_dir)
    return signal, labels, own, stored(infer.group_expression(signal, labels, how))


def tested(spark, sf_dir):
    signal, labels, own, grouped = parts(spark, sf_dir)
    observed = infer.observed_network(infer.side_scores(grouped, own))
    return infer.permutation_pvalues(signal, labels, own, observed, PERMUTATIONS, SEED)


@query("cells_by_node", f"WITH {CELLS} SELECT node, count(*) AS cells, count(DISTINCT subject) AS subjects FROM cells GROUP BY node")
def cells_by_node(spark, sf_dir):
    return domain.cells(spark, sf_dir).groupBy("node").agg(F.count("*").alias("cells"), F.countDistinct("subject").alias("subjects"))


@query("lr_genes_present", f"WITH {EXPR}, {RULES} SELECT lr_name, side, gene, CAST(grp AS INTEGER) AS grp, gene IN (SELECT gene FROM expr) AS present FROM lr_gene")
def lr_genes_present(spark, sf_dir):
    genes = domain.expression(spark, sf_dir).select("gene").distinct().withColumn("there", F.lit(True))
    own = infer.rule_genes(domain.rule_table(spark)).join(genes, "gene", "left")
    return own.select("lr_name", "side", "gene", "grp", F.coalesce("there", F.lit(False)).alias("present"))


def _eligibility(strict: int, test: str) -> str:
    return f"WITH {EXPR}, {RULES}, g AS (SELECT lr_name, side, grp, max(CASE WHEN gene IN (SELECT gene FROM expr) THEN 1 ELSE 0 END) AS there FROM lr_gene GROUP BY 1, 2, 3), s AS (SELECT lr_name, side, {test}(there) AS there FROM g GROUP BY 1, 2) SELECT lr_name, min(there) = 1 AS eligible FROM s GROUP BY lr_name"


@query("rule_eligibility_strict", _eligibility(1, "min"))
def rule_eligibility_strict(spark, sf_dir):
    return infer.eligible_rules(domain.rule_table(spark), domain.expression(spark, sf_dir).select("gene"), 1)


@query("rule_eligibility_any", _eligibility(0, "max"))
def rule_eligibility_any(spark, sf_dir):
    return infer.eligible_rules(domain.rule_table(spark), domain.expression(spark, sf_dir).select("gene"), 0)


@query("signalling_scaled", f"WITH {EXPR}, {RULES}, {SIGNAL} SELECT cell_id, gene, round(value, 6) AS value FROM signal")
def signalling_scaled(spark, sf_dir):
    return infer.signalling(domain.expression(spark, sf_dir), domain.rule_table(spark)).withColumn("value", r6("value"))


@query("group_expr_triquartile", f"WITH {CELLS}, {EXPR}, {RULES}, {SIGNAL}, {DENSE}, {GROUPED} SELECT node, gene, round(value, 6) AS value FROM grouped")
def group_expr_triquartile(spark, sf_dir):
    return parts(spark, sf_dir)[3].withColumn("value", r6("value"))


@query("group_expr_mean", f"WITH {CELLS}, {EXPR}, {RULES}, {SIGNAL}, {DENSE} SELECT node, gene, round(avg(value), 6) AS value FROM dense GROUP BY 1, 2")
def group_expr_mean(spark, sf_dir):
    return parts(spark, sf_dir, "mean")[3].withColumn("value", r6("value"))


@query("side_scores_default", BASE + " SELECT lr_name, side, node, round(score, 6) AS score FROM scored WHERE lr_name IN (SELECT lr_name FROM ok)")
def side_scores_default(spark, sf_dir):
    _, _, own, grouped = parts(spark, sf_dir)
    return infer.side_scores(grouped, own).withColumn("score", r6("score"))


@query("net0_default", BASE + " SELECT lr_name, sender, receiver, round(prob + 1e-10, 6) AS prob FROM net0")
def net0_default(spark, sf_dir):
    _, _, own, grouped = parts(spark, sf_dir)
    return infer.observed_network(infer.side_scores(grouped, own)).withColumn("prob", r6(F.col("prob") + 1e-10))


def _other(score: str, prob: str) -> str:
    return f"""WITH {CELLS}, {EXPR}, {RULES}, {SIGNAL}, {DENSE}, {GROUPED}, {ELIGIBLE},
        scored AS (SELECT lr_name, side, node, {score} AS score FROM grouped JOIN lr_gene USING (gene) WHERE lr_name IN (SELECT lr_name FROM ok) GROUP BY 1, 2, 3)
        SELECT a.lr_name, a.node AS sender, b.node AS receiver, round({prob}, 6) AS prob FROM scored a JOIN scored b ON a.lr_name = b.lr_name WHERE a.side = 'lig' AND b.side = 'rec'"""


@query("net0_hill", _other("CASE WHEN min(value) <= 0 THEN 0.0 ELSE exp(avg(CASE WHEN value > 0 THEN ln(value) END)) END", "a.score * a.score / (a.score * a.score + 0.25) * (b.score * b.score / (b.score * b.score + 0.25))"))
def net0_hill(spark, sf_dir):
    _, _, own, grouped = parts(spark, sf_dir)
    return infer.observed_network(infer.side_scores(grouped, own, "hill"), "hill").withColumn("prob", r6("prob"))


@query("net0_minmean", _other("min(value)", "CASE WHEN a.score > 0 AND b.score > 0 THEN (a.score + b.score) / 2 ELSE 0.0 END"))
def net0_minmean(spark, sf_dir):
    _, _, own, grouped = parts(spark, sf_dir)
    return infer.observed_network(infer.side_scores(grouped, own, "minmean"), "minmean").withColumn("prob", r6("prob"))


@query("net0_senders_receivers", BASE + " SELECT lr_name, sender, receiver, round(prob + 1e-10, 6) AS prob FROM net0 WHERE sender IN ('ASIA::BUILDING', 'EUROPE::MACHINERY') AND receiver IN ('ASIA::BUILDING', 'AMERICA::FURNITURE')")
def net0_senders_receivers(spark, sf_dir):
    _, _, own, grouped = parts(spark, sf_dir)
    net = infer.observed_network(infer.side_scores(grouped, own), senders=["ASIA::BUILDING", "EUROPE::MACHINERY"], receivers=["ASIA::BUILDING", "AMERICA::FURNITURE"])
    return net.withColumn("prob", r6(F.col("prob") + 1e-10))


@query("lr_fc_info", BASE + ", span AS (SELECT lr_name, max(s) AS fc FROM (SELECT lr_name, side, max(score) - min(score) AS s FROM scored GROUP BY 1, 2) GROUP BY 1) SELECT n.lr_name, round(any_value(fc), 6) AS fc, round(sum(prob), 5) AS info FROM net0 n JOIN span USING (lr_name) GROUP BY 1")
def lr_fc_info(spark, sf_dir):
    _, _, own, grouped = parts(spark, sf_dir)
    scores = infer.side_scores(grouped, own)
    net = infer.observed_network(scores).withColumnRenamed("prob", "net")
    return infer.rule_summary(scores, net).select("lr_name", r6("fc").alias("fc"), F.round("info", 5).alias("info"))


TESTED = BASE + f""",
    plain AS (SELECT node, row_number() OVER (ORDER BY md5('{SEED}_-1_' || cell_id), cell_id) AS r FROM cells),
    drawn AS (SELECT perm, cell_id, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}_' || perm || '_' || cell_id), cell_id) AS r FROM cells CROSS JOIN range({PERMUTATIONS}) p(perm)),
    pdense AS (SELECT d.perm, p.node, g.gene, coalesce(s.value, 0) AS value FROM drawn d JOIN plain p USING (r) CROSS JOIN (SELECT DISTINCT gene FROM signal) g LEFT JOIN signal s ON s.cell_id = d.cell_id AND s.gene = g.gene),
    pgrouped AS (SELECT perm, node, gene, {TRI} AS value FROM pdense GROUP BY 1, 2, 3),
    {_scores('perm, ', 'pgrouped').replace('gx AS', 'pgx AS').replace('gx x', 'pgx x').replace('scored AS', 'pscored AS')},
    pv AS (SELECT n.lr_name, n.sender, n.receiver, n.prob, sum(CASE WHEN a.score * b.score > n.prob * (1 + 1e-12) THEN 1 ELSE 0 END) / {PERMUTATIONS}.0 AS pvalue
           FROM net0 n JOIN pscored a ON a.lr_name = n.lr_name AND a.side = 'lig' AND a.node = n.sender JOIN pscored b ON b.lr_name = n.lr_name AND b.side = 'rec' AND b.node = n.receiver AND b.perm = a.perm GROUP BY 1, 2, 3, 4),
    kept AS (SELECT *, CASE WHEN pvalue < 0.05 * row_number() OVER (PARTITION BY lr_name ORDER BY pvalue, receiver, sender) / count(*) OVER (PARTITION BY lr_name) THEN prob ELSE 0 END AS net FROM pv)"""


@query("perm_pvalue", TESTED + " SELECT lr_name, sender, receiver, round(CAST(pvalue AS DOUBLE), 6) AS pvalue FROM pv")
def perm_pvalue(spark, sf_dir):
    return tested(spark, sf_dir).select("lr_name", "sender", "receiver", r6("pvalue").alias("pvalue"))


@query("net_bh", TESTED + " SELECT lr_name, sender, receiver, round(net, 6) AS net FROM kept")
def net_bh(spark, sf_dir):
    return infer.filtered_network(tested(spark, sf_dir)).select("lr_name", "sender", "receiver", r6("net").alias("net"))


SENDERS, RECEIVERS = ("ASIA::BUILDING", "EUROPE::MACHINERY", "AFRICA::FURNITURE"), ("ASIA::BUILDING", "AMERICA::FURNITURE", "EUROPE::AUTOMOBILE")


def _trade(name: str, nodes: tuple[str, ...], seed: int) -> str:
    """A shuffle of the labels of the cells of some nodes, as SQL."""
    own = f"SELECT * FROM cells WHERE node IN {nodes}"
    return f"""{name}_plain AS (SELECT node, row_number() OVER (ORDER BY md5('{seed}_-1_' || cell_id), cell_id) AS r FROM ({own})),
        {name}_drawn AS (SELECT perm, cell_id, node AS was, row_number() OVER (PARTITION BY perm ORDER BY md5('{seed}_' || perm || '_' || cell_id), cell_id) AS r FROM ({own}) CROSS JOIN range({PERMUTATIONS}) p(perm)),
        {name} AS (SELECT perm, cell_id, was, p.node FROM {name}_drawn JOIN {name}_plain p USING (r))"""


RESTRICTED = (
    TESTED.replace("FROM drawn d JOIN plain p USING (r) CROSS JOIN", "FROM labelled d JOIN labelled p USING (perm, cell_id) CROSS JOIN")
    .replace(f"{BASE},", f"""{BASE}, {_trade('sent', SENDERS, SEED)}, {_trade('received', RECEIVERS, SEED + 1)},
    labelled AS (SELECT perm, cell_id, node FROM received UNION ALL SELECT perm, cell_id, node FROM sent WHERE was NOT IN {RECEIVERS}
                 UNION ALL SELECT perm, cell_id, node FROM cells CROSS JOIN range({PERMUTATIONS}) p(perm) WHERE node NOT IN {SENDERS} AND node NOT IN {RECEIVERS}),""")
    .replace("FROM net0 n JOIN pscored a", f"FROM (SELECT * FROM net0 WHERE sender IN {SENDERS} AND receiver IN {RECEIVERS}) n JOIN pscored a")
)


@query("inference_run", RESTRICTED + " SELECT lr_name, sender, receiver, round(prob + 1e-10, 6) AS prob, round(CAST(pvalue AS DOUBLE), 6) AS pvalue, round(net + 1e-10, 6) AS net FROM kept")
def inference_run(spark, sf_dir):
    out = infer.run_inference(domain.expression(spark, sf_dir), domain.cells(spark, sf_dir).select("cell_id", "node"), domain.rule_table(spark), senders=SENDERS, receivers=RECEIVERS, m=PERMUTATIONS, seed=SEED)
    return out.select("lr_name", "sender", "receiver", r6(F.col("prob") + 1e-10).alias("prob"), r6("pvalue").alias("pvalue"), r6(F.col("net") + 1e-10).alias("net"))


def _aggregation(value: str) -> str:
    return BASE + f""", t AS (SELECT lr_name, sum(prob) AS total, quantile_cont(prob, 0.05) AS lim FROM net0 GROUP BY 1),
        a AS (SELECT n.lr_name, sum(CASE WHEN prob > lim THEN 1 ELSE 0 END) AS above FROM net0 n JOIN t USING (lr_name) GROUP BY 1)
        SELECT sender, receiver, round(CAST(sum({value}) AS DOUBLE), 5) AS weight FROM net0 JOIN t USING (lr_name) JOIN a USING (lr_name) GROUP BY 1, 2"""


def _aggregated(how: str, value: str) -> None:
    @query(f"net_agg_{how}", _aggregation(value))
    def run(spark, sf_dir):
        _, _, own, grouped = parts(spark, sf_dir)
        net = infer.observed_network(infer.side_scores(grouped, own)).withColumnRenamed("prob", "net")
        return infer.aggregate_network(net, how).withColumn("weight", F.round("weight", 5))


for _how, _value in (("weight", "prob"), ("count", "CASE WHEN prob > 0 THEN 1 ELSE 0 END"), ("weighted_count", "CASE WHEN prob > 0 THEN total ELSE 0 END"), ("weighted_count2", "CASE WHEN prob > lim THEN total / (above + 1e-6) ELSE 0 END"), ("weight_threshold", "CASE WHEN prob > lim THEN prob ELSE 0 END")):
    _aggregated(_how, _value)


@query("merge_runs", f"WITH {CELLS}, {EXPR} SELECT lower(region) AS datasets, gene, count(*) AS cells, round(sum(value), 6) AS total FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2")
def merge_runs(spark, sf_dir):
    expr, cells = domain.expression(spark, sf_dir), domain.cells(spark, sf_dir)
    names = sorted(r["r_name"] for r in domain.table(spark, sf_dir, "region").select("r_name").collect())
    runs = {name.lower(): expr.join(cells.filter(F.col("region") == name).select("cell_id"), "cell_id", "left_semi") for name in names}
    return infer.merge_runs(runs).groupBy("datasets", "gene").agg(F.count("*").alias("cells"), r6(F.sum("value")).alias("total"))


@query("shared_gene_panel", f"WITH {CELLS}, {EXPR}, {RULES}, p AS (SELECT DISTINCT region, gene FROM expr JOIN cells USING (cell_id)) SELECT gene FROM p WHERE gene IN (SELECT gene FROM lr_gene) GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT region) FROM p)")
def shared_gene_panel(spark, sf_dir):
    rows = domain.expression(spark, sf_dir).join(domain.cells(spark, sf_dir).select("cell_id", "region"), "cell_id").select("region", "gene").distinct()
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return infer.shared_genes([rows.filter(F.col("region") == n) for n in names], [infer.rule_genes(domain.rule_table(spark))])


@query("subjects_to_run", f"WITH {CELLS} SELECT subject, count(*) AS cells, count(DISTINCT node) AS groups FROM cells WHERE subject NOT LIKE 'NATION_1%' GROUP BY subject HAVING count(*) >= 10 AND count(DISTINCT node) >= 2")
def subjects_to_run(spark, sf_dir):
    cells = domain.cells(spark, sf_dir)
    return infer.subjects_to_run(cells, cells.filter("subject LIKE 'NATION_1%'").select("subject").distinct())
