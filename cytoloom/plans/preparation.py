"""Queries over preparation: checks, normalisation, annotation, region tables, edges and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import features, infer
from ..operators import preprocess as pre
from ..sources import domain
from .inference import BASE, parts
from .registry import CELLS, EXPR, query


@query("raw_count_check", f"WITH {EXPR}, c AS (SELECT DISTINCT cell_id FROM expr ORDER BY 1 LIMIT 100), g AS (SELECT DISTINCT gene FROM expr ORDER BY 1 LIMIT 100), b AS (SELECT value FROM expr WHERE cell_id IN (SELECT cell_id FROM c) AND gene IN (SELECT gene FROM g)) SELECT bool_and(abs(value - round(value)) <= 1e-6) AS whole, max(value) AS most, bool_and(abs(value - round(value)) <= 1e-6) AND max(value) > 20 AS raw FROM b")
def raw_count_check(spark, sf_dir):
    return pre.raw_count_check(domain.expression(spark, sf_dir))


@query("log_normalize", f"WITH {EXPR} SELECT cell_id, gene, round(ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 10000), 6) AS value FROM expr")
def log_normalize(spark, sf_dir):
    return pre.log_normalise(domain.expression(spark, sf_dir)).withColumn("value", r6("value"))


@query("gene_subset", f"WITH {EXPR} SELECT cell_id, gene, value FROM expr WHERE gene IN ('Brand#11', 'Brand#23', 'Brand#45')")
def gene_subset(spark, sf_dir):
    return pre.subset_genes(domain.expression(spark, sf_dir), pre.gene_list(spark.createDataFrame([("Brand#11; Brand#23", "Brand#45;")], "a string, b string"), ["a", "b"]))


@query("taxonomy_walk", "SELECT 'R' || r_regionkey AS label, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'C' || c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def taxonomy_walk(spark, sf_dir):
    return pre.nearest_marked(domain.terms(spark, sf_dir))


@query("annotate_left", "SELECT c_custkey AS cell_id, n_name AS subject FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def annotate_left(spark, sf_dir):
    own = domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("k"))
    meta = domain.table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("subject"))
    return pre.annotate(own, meta, "k").select("cell_id", "subject")


@query("attach_inner", f"WITH {CELLS} SELECT cell_id, region || '::' || cell_type AS label FROM cells WHERE region <> 'ASIA'")
def attach_inner(spark, sf_dir):
    cells = domain.cells(spark, sf_dir)
    assigned = cells.filter("region <> 'ASIA'").select("cell_id", "region", "cell_type")
    return pre.attach_assignments(cells.select("cell_id"), assigned, "cell_id", "region", "cell_type").select("cell_id", "label")


@query("swap_ids", "SELECT DISTINCT p_type AS gene, p_brand AS ensg FROM part")
def swap_ids(spark, sf_dir):
    return pre.swap_ids(domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("ensg")).distinct())


@query("dataset_cell_names", f"WITH {CELLS} SELECT cell_id || '_' || region AS cell_id, region AS dataset FROM cells")
def dataset_cell_names(spark, sf_dir):
    return pre.dataset_cell_names(domain.cells(spark, sf_dir).select(F.col("cell_id").cast("string"), F.col("region").alias("dataset")))


@query("strip_suffix", "SELECT c_custkey, regexp_replace(c_name, '[01]$', '') AS name FROM customer")
def strip_suffix(spark, sf_dir):
    return domain.table(spark, sf_dir, "customer").select("c_custkey", pre.strip_suffix("c_name", "[01]$").alias("name"))


MEANS = "n AS (SELECT region, count(*) AS size FROM cells GROUP BY 1), means AS (SELECT region, gene, ln(1 + sum(value) / any_value(size)) AS value FROM expr JOIN cells USING (cell_id) JOIN n USING (region) GROUP BY 1, 2)"


def region_table(spark, sf_dir, log="after"):
    return pre.region_means(domain.expression(spark, sf_dir), domain.cells(spark, sf_dir).select("cell_id", "region"), ["region"], log)


@query("region_expression_mean_then_log", f"WITH {CELLS}, {EXPR}, {MEANS} SELECT region, gene, round(value, 6) AS value FROM means")
def region_expression_mean_then_log(spark, sf_dir):
    return region_table(spark, sf_dir).withColumn("value", r6("value"))


@query("region_expression_log_then_mean", f"WITH {CELLS}, {EXPR}, n AS (SELECT subject, region, count(*) AS size FROM cells GROUP BY 1, 2) SELECT subject, region, gene, round(sum(ln(1 + value)) / any_value(size), 6) AS value FROM expr JOIN cells USING (cell_id) JOIN n USING (subject, region) GROUP BY 1, 2, 3")
def region_expression_log_then_mean(spark, sf_dir):
    labels = domain.cells(spark, sf_dir).select("cell_id", "subject", "region")
    return pre.region_means(domain.expression(spark, sf_dir), labels, ["subject", "region"], "before").withColumn("value", r6("value"))


@query("pair_counts", f"WITH {CELLS} SELECT regexp_replace(region, '^MIDDLE ', '') AS region, cell_type, count(*) AS cells FROM cells GROUP BY 1, 2")
def pair_counts(spark, sf_dir):
    return pre.pair_counts(domain.cells(spark, sf_dir), "MIDDLE ")


@query("complete_counts", f"WITH {CELLS}, k AS (SELECT * FROM cells WHERE NOT (region = 'ASIA' AND cell_type = 'BUILDING')) SELECT r.region, t.cell_type, count(k.cell_id) AS cells FROM (SELECT DISTINCT region FROM k) r CROSS JOIN (SELECT DISTINCT cell_type FROM k) t LEFT JOIN k ON k.region = r.region AND k.cell_type = t.cell_type GROUP BY 1, 2")
def complete_counts(spark, sf_dir):
    return pre.complete_counts(pre.pair_counts(domain.cells(spark, sf_dir).filter("NOT (region = 'ASIA' AND cell_type = 'BUILDING')")))


EDGES = "names AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS i FROM (SELECT DISTINCT r_name AS region FROM region)), edges AS (SELECT CAST(a.i + (SELECT count(*) FROM names) * b.i AS BIGINT) AS edge_idx, a.region AS src_region, b.region AS tgt_region FROM names a CROSS JOIN names b)"


def region_edges(spark, sf_dir):
    return features.edge_table(domain.table(spark, sf_dir, "region").select(F.col("r_name").alias("region")))


@query("edge_table", f"WITH {EDGES} SELECT * FROM edges")
def edge_table(spark, sf_dir):
    return region_edges(spark, sf_dir)


@query("parse_labels", f"WITH {CELLS} SELECT DISTINCT node, split_part(node, '::', 1) AS region, split_part(node, '::', 2) AS cell_type, CASE WHEN node = 'ASIA::BUILDING' THEN 'x' ELSE node END AS renamed FROM cells")
def parse_labels(spark, sf_dir):
    out = domain.cells(spark, sf_dir).select("node").distinct().select("node", features.region_of("node").alias("region"), features.type_of("node").alias("cell_type"), F.col("node").alias("renamed"))
    return features.with_alias(out, "renamed", {"ASIA::BUILDING": "x"})


def network(spark, sf_dir):
    _, _, own, grouped = parts(spark, sf_dir)
    return infer.observed_network(infer.side_scores(grouped, own)).withColumnRenamed("prob", "net")


#: Edge features of the observed network, thinned so that zeros and gaps occur.
ROWS = BASE + """, f AS (SELECT split_part(sender, '::', 1) AS src_region, split_part(receiver, '::', 1) AS tgt_region, lr_name || '_' || split_part(sender, '::', 2) || '_' || split_part(receiver, '::', 2) AS feature, lr_name, sender, receiver, CASE WHEN prob < 0.02 THEN 0 ELSE prob END AS value FROM net0 WHERE NOT (sender = 'ASIA::BUILDING' AND receiver LIKE 'E%'))"""


def edge_rows(spark, sf_dir):
    net = network(spark, sf_dir).filter("NOT (sender = 'ASIA::BUILDING' AND receiver LIKE 'E%')").withColumn("net", F.when(F.col("net") < 0.02, 0.0).otherwise(F.col("net")))
    return features.edge_features(net)


@query("feature_filter", ROWS + " SELECT feature, round(count(value) / 25.0, 6) AS valid, round(1 - sum(CASE WHEN value <> 0 THEN 1 ELSE 0 END) / 25.0, 6) AS zero FROM f GROUP BY feature HAVING count(value) / 25.0 >= 0.9 AND 1 - sum(CASE WHEN value <> 0 THEN 1 ELSE 0 END) / 25.0 <= 0.6")
def feature_filter(spark, sf_dir):
    return features.kept_features(edge_rows(spark, sf_dir), 25, 0.9, 0.6).select("feature", r6("valid").alias("valid"), r6("zero").alias("zero"))


@query("variance_filter", ROWS + " SELECT feature, round((sum(value * value) / 25 - (sum(value) / 25) ** 2) * 1e4, 6) AS variance FROM f GROUP BY feature HAVING sum(value * value) / 25 - (sum(value) / 25) ** 2 >= 1e-5")
def variance_filter(spark, sf_dir):
    return features.varying_features(edge_rows(spark, sf_dir), 25, 1e-5).select("feature", r6(F.col("variance") * 1e4).alias("variance"))


@query("drop_empty_features", ROWS + " SELECT feature, count(CASE WHEN value > 0.02 THEN 1 END) AS n FROM f GROUP BY feature HAVING count(CASE WHEN value > 0.02 THEN 1 END) > 0")
def drop_empty_features(spark, sf_dir):
    return features.not_all_null(edge_rows(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0.02, F.col("value"))))


@query("aligned_features", ROWS + f", {EDGES}, w(feature) AS (VALUES ('R1_single_BUILDING_BUILDING'), ('none_here')) SELECT e.edge_idx, w.feature, round(coalesce(f.value, 0), 6) AS value FROM edges e CROSS JOIN w LEFT JOIN f ON f.src_region = e.src_region AND f.tgt_region = e.tgt_region AND f.feature = w.feature")
def aligned_features(spark, sf_dir):
    rows = edge_rows(spark, sf_dir).join(F.broadcast(region_edges(spark, sf_dir)), ["src_region", "tgt_region"]).select("edge_idx", "feature", "value")
    return features.aligned_features(rows, spark.createDataFrame([("R1_single_BUILDING_BUILDING",), ("none_here",)], "feature string")).withColumn("value", r6("value"))


@query("region_collapsed", BASE + " SELECT split_part(sender, '::', 1) AS src_region, split_part(receiver, '::', 1) AS tgt_region, lr_name, round(avg(prob), 6) AS value FROM net0 GROUP BY 1, 2, 3")
def region_collapsed(spark, sf_dir):
    return features.region_collapsed(network(spark, sf_dir)).withColumn("value", r6("value"))


@query("expr_product", BASE + f", {MEANS}, {EDGES}, s AS (SELECT lr_name, side, region, avg(value) AS x FROM means JOIN lr_gene USING (gene) GROUP BY 1, 2, 3) SELECT e.edge_idx, r.lr_name, round(l.x * c.x, 6) AS value FROM edges e CROSS JOIN (SELECT DISTINCT lr_name FROM lr_gene) r LEFT JOIN s l ON l.lr_name = r.lr_name AND l.side = 'lig' AND l.region = e.src_region LEFT JOIN s c ON c.lr_name = r.lr_name AND c.side = 'rec' AND c.region = e.tgt_region")
def expr_product(spark, sf_dir):
    return features.expression_product(region_table(spark, sf_dir), infer.rule_genes(domain.rule_table(spark)), region_edges(spark, sf_dir)).withColumn("value", r6("value"))


@query("coexpression_corr", f"WITH {CELLS}, {EXPR}, {MEANS}, {EDGES} SELECT e.edge_idx, round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0), 6) AS value FROM edges e JOIN means a ON a.region = e.src_region JOIN means b ON b.region = e.tgt_region AND b.gene = a.gene GROUP BY 1")
def coexpression_corr(spark, sf_dir):
    return features.region_coexpression(region_table(spark, sf_dir), region_edges(spark, sf_dir)).withColumn("value", r6("value"))
