"""Queries over subjects: their networks, features, and rank association with outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.resample import shuffled_labels
from ..functions.stats import r6
from ..operators import association as assoc
from ..operators import infer
from ..operators import preprocess as pre
from ..sources import domain
from ..sources.work import cut
from .inference import ELIGIBLE, NETWORK, PERMUTATIONS, RULES, SIGNAL, TRI, _scores, inputs
from .preparation import MEANS
from .registry import CELLS, EXPR, query

SDENSE = "sdense AS (SELECT c.subject AS perm, c.cell_id, c.node, g.gene, coalesce(s.value, 0) AS value FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM signal) g LEFT JOIN signal s ON s.cell_id = c.cell_id AND s.gene = g.gene), grouped AS (SELECT perm, node, gene, avg(value) AS value FROM sdense GROUP BY 1, 2, 3)"
SNET = NETWORK.replace("SELECT a.lr_name", "SELECT a.perm AS subject, a.lr_name").replace("ON a.lr_name = b.lr_name", "ON a.lr_name = b.lr_name AND a.perm = b.perm")
BASE = f"WITH {CELLS}, {EXPR}, {RULES}, {SIGNAL}, {SDENSE}, {ELIGIBLE}, {_scores('perm, ')}, {SNET}"


def networks(spark, sf_dir):
    """(subject, lr_name, sender, receiver, net), each subject inferred from its own cells."""
    signal, _, own = inputs(spark, sf_dir)
    labels = domain.cells(spark, sf_dir).select("subject", "cell_id", "node")
    scores = infer.side_scores(infer.group_expression(signal, labels, "mean", by=["subject"]), own, by=["subject"])
    return infer.observed_network(scores, by=["subject"]).withColumnRenamed("prob", "net")


FEATURES = "feat AS (SELECT subject, lr_name, split_part(sender, '::', 2) AS ct_s, split_part(receiver, '::', 2) AS ct_r, avg(prob) AS value FROM net0 GROUP BY 1, 2, 3, 4)"


@query("region_collapsed_subject", BASE + f", {FEATURES} SELECT subject, lr_name, ct_s, ct_r, round(value + 1e-10, 6) AS value FROM feat")
def region_collapsed_subject(spark, sf_dir):
    return assoc.subject_features(networks(spark, sf_dir)).withColumn("value", r6(F.col("value") + 1e-10))


@query("region_specific_subject", BASE + " SELECT subject, split_part(sender, '::', 1) AS region, lr_name, split_part(sender, '::', 2) AS ct_s, split_part(receiver, '::', 2) AS ct_r, round(avg(prob) + 1e-10, 6) AS value FROM net0 WHERE split_part(sender, '::', 1) = split_part(receiver, '::', 1) GROUP BY 1, 2, 3, 4, 5")
def region_specific_subject(spark, sf_dir):
    return assoc.subject_features(networks(spark, sf_dir), within_region=True).withColumn("value", r6(F.col("value") + 1e-10))


@query("feature_names", BASE + f", {FEATURES} SELECT DISTINCT lr_name || ' | ' || ct_s || '→' || ct_r AS feature, lr_name AS lr, ct_s AS sender, ct_r AS receiver FROM feat")
def feature_names(spark, sf_dir):
    named = assoc.subject_features(networks(spark, sf_dir)).select(assoc.feature_name(F.col("lr_name"), F.col("ct_s"), F.col("ct_r")).alias("feature")).distinct()
    lr, sender, receiver = assoc.parse_feature("feature")
    return named.select("feature", lr.alias("lr"), sender.alias("sender"), receiver.alias("receiver"))


RUN_SEED = 42
#: Inference of each subject by itself: perm is the subject, and subject#number for its shuffles.
BY_SUBJECT = f"""WITH {CELLS.replace("cells AS (", "all_cells AS (")}, {EXPR}, {RULES},
    panel AS (SELECT DISTINCT p_brand AS gene FROM part), used AS (SELECT DISTINCT gene FROM lr_gene WHERE gene IN (SELECT gene FROM panel)),
    cells AS (SELECT * FROM all_cells WHERE subject IN (SELECT subject FROM all_cells GROUP BY 1 HAVING count(*) >= 10 AND count(DISTINCT node) >= 2)),
    signal AS (SELECT subject, cell_id, gene, value / max(value) OVER (PARTITION BY subject) AS value FROM expr JOIN cells USING (cell_id) WHERE gene IN (SELECT gene FROM used)),
    dense AS (SELECT c.subject AS perm, c.node, g.gene, coalesce(s.value, 0) AS value FROM cells c CROSS JOIN used g LEFT JOIN signal s ON s.cell_id = c.cell_id AND s.gene = g.gene),
    grouped AS (SELECT perm, node, gene, {TRI} AS value FROM dense GROUP BY 1, 2, 3), {ELIGIBLE.replace("FROM expr", "FROM panel")}, {_scores('perm, ')}, {SNET},
    plain AS (SELECT subject, node, row_number() OVER (PARTITION BY subject ORDER BY md5('{RUN_SEED}_-1_' || cell_id), cell_id) AS r FROM cells),
    drawn AS (SELECT subject, perm, cell_id, row_number() OVER (PARTITION BY subject, perm ORDER BY md5('{RUN_SEED}_' || perm || '_' || cell_id), cell_id) AS r FROM cells CROSS JOIN range({PERMUTATIONS}) p(perm)),
    pdense AS (SELECT d.subject || '#' || d.perm AS perm, p.node, g.gene, coalesce(s.value, 0) AS value FROM drawn d JOIN plain p USING (subject, r) CROSS JOIN used g LEFT JOIN signal s ON s.cell_id = d.cell_id AND s.gene = g.gene),
    pgrouped AS (SELECT perm, node, gene, {TRI} AS value FROM pdense GROUP BY 1, 2, 3),
    {_scores('perm, ', 'pgrouped').replace('gx AS', 'pgx AS').replace('gx x', 'pgx x').replace('scored AS', 'pscored AS')},
    null_score AS (SELECT *, split_part(perm, '#', 1) AS subject FROM pscored),
    pv AS (SELECT n.subject, n.lr_name, n.sender, n.receiver, n.prob, CASE WHEN any_value(n.alive) THEN sum(CASE WHEN a.score * b.score > n.prob * (1 + 1e-12) THEN 1 ELSE 0 END) / {PERMUTATIONS}.0 END AS pvalue
           FROM (SELECT *, max(prob) OVER (PARTITION BY subject, lr_name) > 0 AS alive FROM net0) n
           JOIN null_score a ON a.subject = n.subject AND a.lr_name = n.lr_name AND a.side = 'lig' AND a.node = n.sender
           JOIN null_score b ON b.subject = n.subject AND b.lr_name = n.lr_name AND b.side = 'rec' AND b.node = n.receiver AND b.perm = a.perm GROUP BY 1, 2, 3, 4, 5),
    kept AS (SELECT *, CASE WHEN pvalue IS NULL OR pvalue < 0.05 * row_number() OVER (PARTITION BY subject, lr_name ORDER BY pvalue, receiver, sender) / count(*) OVER (PARTITION BY subject, lr_name) THEN prob ELSE 0 END AS net FROM pv)
    SELECT subject, lr_name, sender, receiver, round(prob + 1e-10, 6) AS prob, round(CAST(pvalue AS DOUBLE), 6) AS pvalue, round(net + 1e-10, 6) AS net FROM kept"""


def rounded(out):
    return out.select("subject", "lr_name", "sender", "receiver", r6(F.col("prob") + 1e-10).alias("prob"), r6("pvalue").alias("pvalue"), r6(F.col("net") + 1e-10).alias("net"))


@query("inference_by_subject", BY_SUBJECT)
def inference_by_subject(spark, sf_dir):
    cells = domain.cells(spark, sf_dir)
    due = cells.join(infer.subjects_to_run(cells, cells.select("subject").limit(0)).select("subject"), "subject", "left_semi")
    panel = domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct()
    return rounded(infer.run_by_subject(domain.expression(spark, sf_dir), due, domain.rule_table(spark), panel, m=PERMUTATIONS, seed=RUN_SEED))


OUTCOMES = "outcome AS (SELECT subject, avg(balance) AS y, CAST(count(*) AS DOUBLE) AS c, min(balance) AS c2 FROM cells GROUP BY 1)"
#: Values are rounded before they are ranked, so that sums taken in another order tie in the same way.
RANKED = f"{FEATURES}, {OUTCOMES}, d AS (SELECT lr_name, ct_s, ct_r, round(value, 9) AS x, y, c FROM feat JOIN outcome USING (subject)), k AS (SELECT *, rank() OVER (PARTITION BY lr_name, ct_s, ct_r ORDER BY x) + (count(*) OVER (PARTITION BY lr_name, ct_s, ct_r, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lr_name, ct_s, ct_r ORDER BY y) + (count(*) OVER (PARTITION BY lr_name, ct_s, ct_r, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY lr_name, ct_s, ct_r ORDER BY c) + (count(*) OVER (PARTITION BY lr_name, ct_s, ct_r, c) - 1) / 2.0 AS rc FROM d)"


def observations(spark, sf_dir):
    outcome = domain.cells(spark, sf_dir).groupBy("subject").agg(F.avg("balance").alias("y"), F.count("*").cast("double").alias("c"), F.min("balance").alias("c2"))
    return assoc.subject_features(networks(spark, sf_dir)).join(F.broadcast(outcome), "subject").withColumn("x", F.round("value", 9))


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


@query("spearman", BASE + f", {RANKED} SELECT lr_name, ct_s, ct_r, count(*) AS n, round({_corr('rx', 'ry')}, 6) AS rho FROM k GROUP BY 1, 2, 3")
def spearman(spark, sf_dir):
    return assoc.spearman(observations(spark, sf_dir), ["lr_name", "ct_s", "ct_r"]).withColumn("rho", r6("rho"))


@query("partial_spearman_k1", BASE + f", {RANKED}, r AS (SELECT lr_name, ct_s, ct_r, count(*) AS n, {_corr('rx', 'ry')} AS xy, {_corr('rx', 'rc')} AS xc, {_corr('ry', 'rc')} AS yc FROM k GROUP BY 1, 2, 3) SELECT lr_name, ct_s, ct_r, n, round((xy - xc * yc) / sqrt((1 - xc * xc) * (1 - yc * yc)), 6) AS rho FROM r")
def partial_spearman_k1(spark, sf_dir):
    return assoc.partial_spearman_one(observations(spark, sf_dir), ["lr_name", "ct_s", "ct_r"]).withColumn("rho", r6("rho"))


def _partial(a: str, b: str, c: str) -> str:
    return f"({a} - {b} * {c}) / nullif(sqrt((1 - {b} * {b}) * (1 - {c} * {c})), 0)"


def _t_share(rho: str, df: str) -> str:
    """Two-sided p of t with df degrees of freedom by the finite sums for the angle, whose products are written with lgamma."""
    c2 = f"(1 - {rho} * {rho})"
    odd = f"list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * {c2} ** j))"
    even = f"list_sum(list_transform(range(0, {df} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * {c2} ** j))"
    return f"CASE WHEN {df} % 2 = 1 THEN 1 - 2 / pi() * (asin(abs({rho})) + abs({rho}) * sqrt{c2} * coalesce({odd}, 0)) ELSE 1 - abs({rho}) * {even} END"


PLACES = "rank() OVER (PARTITION BY lr_name, ct_s, ct_r ORDER BY {0}) + (count(*) OVER (PARTITION BY lr_name, ct_s, ct_r, {0}) - 1) / 2.0 AS r{0}"
OUTCOMES_3 = OUTCOMES.replace("min(balance) AS c2", "min(balance) AS c2, max(balance) AS c3")
COVARIATES = f"""{FEATURES}, {OUTCOMES_3}, d AS (SELECT lr_name, ct_s, ct_r, round(value, 9) AS x, y, c, c2, c3 FROM feat JOIN outcome USING (subject)),
    k AS (SELECT lr_name, ct_s, ct_r, {', '.join(PLACES.format(v) for v in ('x', 'y', 'c', 'c2', 'c3'))} FROM d),
    r AS (SELECT lr_name, ct_s, ct_r, count(*) AS n, {', '.join(f"{_corr('r' + a, 'r' + b)} AS {a}_{b}" for n, a in enumerate(('x', 'y', 'c', 'c2', 'c3')) for b in ('x', 'y', 'c', 'c2', 'c3')[n + 1:])} FROM k GROUP BY 1, 2, 3),
    g AS (SELECT *, {_partial('x_y', 'x_c', 'y_c')} AS xy1, {_partial('x_c2', 'x_c', 'c_c2')} AS xd1, {_partial('y_c2', 'y_c', 'c_c2')} AS yd1, {_partial('x_c3', 'x_c', 'c_c3')} AS xe1, {_partial('y_c3', 'y_c', 'c_c3')} AS ye1, {_partial('c2_c3', 'c_c2', 'c_c3')} AS de1 FROM r),
    h AS (SELECT *, {_partial('xy1', 'xd1', 'yd1')} AS two, {_partial('xe1', 'xd1', 'de1')} AS xe2, {_partial('ye1', 'yd1', 'de1')} AS ye2 FROM g), p AS (SELECT *, {_partial('two', 'xe2', 'ye2')} AS three FROM h)"""


def _covariates(rho: str) -> str:
    return f"{BASE}, {COVARIATES} SELECT lr_name, ct_s, ct_r, n, round({rho}, 6) AS rho, round({_t_share(rho, '(n - 2)')}, 6) AS p FROM p"


def partial(spark, sf_dir, covariates):
    rows = observations(spark, sf_dir)
    if "c3" in covariates:
        rows = rows.join(F.broadcast(domain.cells(spark, sf_dir).groupBy("subject").agg(F.max("balance").alias("c3"))), "subject")
    return assoc.partial_spearman(rows, ["lr_name", "ct_s", "ct_r"], covariates).withColumns({"rho": r6("rho"), "p": r6("p")})


@query("partial_spearman_k2", _covariates("two"))
def partial_spearman_k2(spark, sf_dir):
    return partial(spark, sf_dir, ["c", "c2"])


@query("partial_spearman_k3", _covariates("three"))
def partial_spearman_k3(spark, sf_dir):
    return partial(spark, sf_dir, ["c", "c2", "c3"])


@query("partial_spearman_k2_rho", f"{BASE}, {COVARIATES} SELECT lr_name, ct_s, ct_r, n, round(two, 6) AS rho FROM p")
def partial_spearman_k2_rho(spark, sf_dir):
    return partial(spark, sf_dir, ["c", "c2"]).drop("p")


SURROGATES, SEED = 100, 42
#: A feature is a segment, its profile over nations the mean balance; a surrogate set gives every nation another's values.
ALIGNMENT = f"""WITH u AS (SELECT n_name AS unit FROM nation), f AS (SELECT c_mktsegment AS feature, n_name AS unit, round(avg(c_acctbal), 6) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    o AS (SELECT n_name AS unit, round(avg(o_totalprice), 4) AS y, CAST(count(*) AS DOUBLE) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    plain AS (SELECT unit AS lab, row_number() OVER (ORDER BY md5('{SEED}_-1_' || unit), unit) AS r FROM u),
    drawn AS (SELECT s, unit, row_number() OVER (PARTITION BY s ORDER BY md5('{SEED}_' || s || '_' || unit), unit) AS r FROM u CROSS JOIN range({SURROGATES}) p(s)),
    a AS (SELECT -1 AS s, feature, unit, x FROM f UNION ALL SELECT s, feature, unit, x FROM drawn JOIN plain USING (r) JOIN f ON f.unit = lab),
    a2 AS (SELECT s, feature, a.unit, x, y, c FROM (SELECT s, feature, unit, x FROM a) a JOIN o ON o.unit = a.unit)"""


def _alignment_sql() -> str:
    rank = lambda v, out: f"rank() OVER (PARTITION BY s, feature ORDER BY {v}) + (count(*) OVER (PARTITION BY s, feature, {v}) - 1) / 2.0 AS {out}"
    sets = ALIGNMENT.replace("SELECT s, feature, unit, x FROM drawn JOIN plain USING (r) JOIN f ON f.unit = lab", "SELECT s, feature, drawn.unit, x FROM drawn JOIN plain USING (r) JOIN f ON f.unit = lab")
    return f"""{sets}, k AS (SELECT s, feature, {rank('x', 'rx')}, {rank('y', 'ry')}, {rank('c', 'rc')} FROM a2),
    r AS (SELECT s, feature, {_corr('rx', 'ry')} AS xy, {_corr('rx', 'rc')} AS xc, {_corr('ry', 'rc')} AS yc FROM k GROUP BY 1, 2),
    v AS (SELECT s, avg(abs({_partial('xy', 'xc', 'yc')})) AS v, count(*) AS features FROM r GROUP BY 1),
    t AS (SELECT (SELECT v FROM v WHERE s = -1) AS real, (SELECT features FROM v WHERE s = -1) AS features, (sum(CASE WHEN v >= (SELECT v FROM v WHERE s = -1) - 1e-12 THEN 1 ELSE 0 END) + 1) / (count(*) + 1.0) AS p, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS median, count(*) AS surrogates FROM v WHERE s >= 0)
    SELECT round(real, 6) AS real, features, round(CAST(p AS DOUBLE), 6) AS p, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round((real - mean) / sd, 4) AS z, surrogates FROM t"""


@query("null_alignment", _alignment_sql())
def null_alignment(spark, sf_dir):
    nation = domain.table(spark, sf_dir, "nation")
    owners = domain.table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    real = cut(owners.groupBy(F.col("c_mktsegment").alias("feature"), F.col("n_name").alias("unit")).agg(F.round(F.avg("c_acctbal"), 6).alias("x")))
    orders = domain.table(spark, sf_dir, "orders").join(owners.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    y = cut(orders.groupBy(F.col("n_name").alias("unit")).agg(F.round(F.avg("o_totalprice"), 4).alias("y"), F.count("*").cast("double").alias("c")))
    moved = shuffled_labels(nation.select(F.col("n_name").alias("unit"), F.col("n_name").alias("lab")), "unit", "lab", SURROGATES, SEED)
    surrogates = moved.join(F.broadcast(real.withColumnRenamed("unit", "lab")), "lab").select(F.col("perm").alias("s"), "feature", "unit", "x")
    out = assoc.null_alignment(real, surrogates, y, "unit", ["c"])
    return out.select(*(r6(c).alias(c) for c in ("real", "p", "mean", "sd", "median")), "features", F.round("z", 4).alias("z"), "surrogates")


@query("lr_expression_covariate", f"WITH {CELLS}, {EXPR}, {RULES}, n AS (SELECT subject, region, count(*) AS size FROM cells GROUP BY 1, 2), m AS (SELECT subject, region, gene, sum(ln(1 + value)) / any_value(size) AS value FROM expr JOIN cells USING (cell_id) JOIN n USING (subject, region) GROUP BY 1, 2, 3) SELECT subject, region, lr_name, round(avg(value), 6) AS value FROM m JOIN (SELECT DISTINCT lr_name, gene FROM lr_gene) g USING (gene) GROUP BY 1, 2, 3")
def lr_expression_covariate(spark, sf_dir):
    means = pre.region_means(domain.expression(spark, sf_dir), domain.cells(spark, sf_dir).select("cell_id", "subject", "region"), ["subject", "region"], "before")
    return assoc.rule_covariate(means, infer.rule_genes(domain.rule_table(spark)), ["subject", "region"]).withColumn("value", r6("value"))


@query("pseudobulk", f"WITH {CELLS}, {EXPR}, n AS (SELECT subject, region, count(*) AS size FROM cells GROUP BY 1, 2) SELECT subject, region || '::' || gene AS feature, round(sum(value) / any_value(size), 6) AS value FROM expr JOIN cells USING (cell_id) JOIN n USING (subject, region) GROUP BY subject, region, gene")
def pseudobulk(spark, sf_dir):
    means = pre.region_means(domain.expression(spark, sf_dir), domain.cells(spark, sf_dir).select("cell_id", "subject", "region"), ["subject", "region"], "none")
    return means.select("subject", F.concat_ws("::", "region", "gene").alias("feature"), r6("value").alias("value"))


#: The regions' matrix of products, squared over its trace until one direction is left.
COMPONENT = f"""WITH {CELLS}, {EXPR}, {MEANS}, u AS (SELECT DISTINCT region FROM means), nu AS (SELECT count(*) AS k FROM u),
    st AS (SELECT gene, sum(value) / any_value(k) AS m, sum(value * value) / any_value(k) - (sum(value) / any_value(k)) ** 2 AS var FROM means, nu GROUP BY 1),
    z AS (SELECT u.region, st.gene, (coalesce(value, 0) - m) / sqrt(var) AS z FROM u CROSS JOIN st LEFT JOIN means ON means.region = u.region AND means.gene = st.gene WHERE var > 1e-14),
    gram AS MATERIALIZED (SELECT a.region AS i, b.region AS j, sum(a.z * b.z) AS g FROM z a JOIN z b USING (gene) GROUP BY 1, 2),
    p0 AS MATERIALIZED (SELECT i, j, g / (SELECT sum(g) FROM gram WHERE i = j) AS g FROM gram)"""
for _k in range(12):
    COMPONENT += f", s{_k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.g * b.g) AS g FROM p{_k} a JOIN p{_k} b ON a.j = b.i GROUP BY 1, 2), p{_k + 1} AS MATERIALIZED (SELECT i, j, g / (SELECT sum(g) FROM s{_k} WHERE i = j) AS g FROM s{_k})"
COMPONENT += """, ax AS (SELECT i, g / sqrt(sum(g * g) OVER ()) AS u FROM p12 WHERE j = (SELECT arg_max(i, g) FROM p12 WHERE i = j)),
    len AS (SELECT sqrt(sum(g * a.u * b.u)) AS len FROM gram JOIN ax a ON a.i = gram.i JOIN ax b ON b.i = gram.j)
    SELECT i AS region, round(u * len * CASE WHEN (SELECT arg_min(u, i) FROM ax) >= 0 THEN 1 ELSE -1 END, 6) AS score FROM ax CROSS JOIN len"""


@query("pc1_covariate", COMPONENT)
def pc1_covariate(spark, sf_dir):
    means = pre.region_means(domain.expression(spark, sf_dir), domain.cells(spark, sf_dir).select("cell_id", "region"), ["region"])
    return assoc.first_component(means).withColumn("score", r6("score"))
