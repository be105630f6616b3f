"""Queries over classes, comparison, enrichment, graphs, space and heterogeneity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import biology as bio
from ..operators import characterize as char
from ..operators import graph, heterogeneity, infer, spatial
from ..operators import importance as imp
from ..operators import preprocess as pre
from ..sources import domain
from ..sources.work import cut
from .inference import RULES
from .prediction import AGG, TWO, complete_gains, importances, meta, two_tables, weights
from .preparation import EDGES, MEANS, ROWS, edge_rows, region_edges, region_table
from .registry import CELLS, EXPR, query

N, SEED = 1000, 3
CLASSES = {"Neuron": ("T1", "T2"), "Glia": ("T3",)}
CASE = "CASE WHEN {0} IN ('T1', 'T2') THEN 'Neuron' WHEN {0} = 'T3' THEN 'Glia' ELSE 'Other' END"


#: Every part names a rule, its key picking the ligand and its size the receptor, and every customer a type.
LIGANDS = ("NRXN1", "GABA-A", "NRG1", "Glu", "SEMA3A", "SLIT2", "COL1A1", "ITGA1", "WNT5A", "FGF2", "BMP4", "EFNA1", "GABBR1", "HTR2A", "SPP1", "LRRTM2", "FLRT3", "abc")
RECEPTORS = ("NLGN1", "ERBB4", "GRIA1", "NRP1", "ROBO1", "CD44", "ITGB1", "EPHA4", "TENM2", "CBLN1", "x")
TYPES = ("Astrocyte", "MGE interneuron", "Amygdala excitatory", "Vascular", "Microglia", "Upper-layer intratelencephalic", "L5 ET", "nobody")
NAMED = f"SELECT ({list(LIGANDS)})[1 + p_partkey % {len(LIGANDS)}] || '_' || ({list(RECEPTORS)})[1 + p_size % {len(RECEPTORS)}] AS name FROM part"
TYPED = f"SELECT ({list(TYPES)})[1 + c_custkey % {len(TYPES)}] AS name FROM customer"


def _classed(names: str, column: str, out: str, cases: list[tuple[str, str]]) -> str:
    """Names by class and how often they stand: cases are (class, condition on upper-cased u or name), first match first."""
    when = " ".join(f"WHEN {test} THEN '{label}'" for label, test in cases)
    return f"SELECT name AS {column}, CASE {when} ELSE 'Other' END AS {out}, count(*) AS n FROM (SELECT name, upper(name) AS u FROM ({names})) GROUP BY 1, 2"


def _part_test(part: str) -> str:
    return f"starts_with(u, '{part[1:]}')" if part[0] == "^" else f"contains(u, '{part}')"


def rule_names(spark, sf_dir):
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    return domain.table(spark, sf_dir, "part").select(F.concat_ws("_", pick(LIGANDS, "p_partkey"), pick(RECEPTORS, "p_size")).alias("lr_name"))


def type_names(spark, sf_dir):
    return domain.table(spark, sf_dir, "customer").select(F.element_at(F.array(*map(F.lit, TYPES)), (F.col("c_custkey") % len(TYPES) + 1).cast("int")).alias("cell_type"))


@query("classify_lr", _classed(NAMED, "lr_name", "class", [(label, " OR ".join("(" + " AND ".join(map(_part_test, parts)) + ")" for parts in tests)) for label, tests in bio.RULE_CLASSES]))
def classify_lr(spark, sf_dir):
    return rule_names(spark, sf_dir).groupBy("lr_name", bio.rule_class("lr_name").alias("class")).agg(F.count("*").alias("n"))


@query("classify_pathway", _classed(NAMED, "lr_name", "pathway", [(label, " OR ".join(map(_part_test, parts))) for label, parts in bio.PATHWAYS]))
def classify_pathway(spark, sf_dir):
    return rule_names(spark, sf_dir).groupBy("lr_name", bio.pathway("lr_name").alias("pathway")).agg(F.count("*").alias("n"))


@query("classify_type", _classed(TYPED, "cell_type", "class", [(label, f"name IN {own}") for label, own in bio.TYPE_CLASSES.items()]))
def classify_type(spark, sf_dir):
    return type_names(spark, sf_dir).groupBy("cell_type", bio.type_class("cell_type").alias("class")).agg(F.count("*").alias("n"))


@query("keyword_class", _classed(TYPED, "cell_type", "class", [(label, " OR ".join(f"contains(lower(name), '{w}')" for w in words)) for label, words in char.CLASS_WORDS]))
def keyword_class(spark, sf_dir):
    return type_names(spark, sf_dir).groupBy("cell_type", char.keyword_class("cell_type").alias("class")).agg(F.count("*").alias("n"))


#: Lists held as text: a part's brand and the words of its name, with stray blanks and empty members.
@query("gene_strings", "WITH g AS (SELECT p_partkey, p_brand || ' + ' || replace(p_name, ' ', '+ ') || '+ +' AS s FROM part) SELECT p_partkey, s, array_to_string(list_filter(list_transform(string_split(s, '+'), lambda x: trim(x)), lambda x: x <> ''), ',') AS genes FROM g")
def gene_strings(spark, sf_dir):
    text = F.concat("p_brand", F.lit(" + "), F.replace("p_name", F.lit(" "), F.lit("+ ")), F.lit("+ +"))
    return domain.table(spark, sf_dir, "part").select("p_partkey", text.alias("s")).select("p_partkey", "s", F.array_join(bio.plus_list("s"), ",").alias("genes"))


#: A network of 25 types: a brand sends to the brands its size classes name.
TYPE_EDGES = AGG + ", x AS (SELECT lr_name AS ct_l, 'Brand#' || (1 + (CAST(substr(feature, -1) AS INTEGER) + CAST(substr(lr_name, 7, 1) AS INTEGER)) % 5) || substr(lr_name, 8, 1) AS ct_r, importance_rel AS importance FROM a)"


def type_features(spark, sf_dir, found=None):
    own = (found or importances(spark, sf_dir)).join(F.broadcast(meta(spark, sf_dir).select("feature", "lr_name")), "feature")
    to = F.concat(F.lit("Brand#"), 1 + (F.substring("feature", -1, 1).cast("int") + F.substring("lr_name", 7, 1).cast("int")) % 5, F.substring("lr_name", 8, 1))
    return own.select(F.col("lr_name").alias("ct_l"), to.alias("ct_r"), F.col("importance_rel").alias("importance"))


@query("class_matrix", AGG + f" SELECT {CASE.format('ct_l')} AS sender_class, {CASE.format('ct_l')} AS receiver_class, round(sum(importance_rel) * 100, 5) AS importance FROM a GROUP BY 1, 2")
def class_matrix(spark, sf_dir):
    own = importances(spark, sf_dir).join(F.broadcast(meta(spark, sf_dir)), "feature").select("ct_l", F.col("ct_l").alias("ct_r"), F.col("importance_rel").alias("importance"))
    return bio.class_matrix(own, CLASSES).withColumn("importance", F.round(F.col("importance") * 100, 5))


@query("compare_classes", TWO + " SELECT group_name, round(a * 100, 6) AS sc, round(b * 100, 6) AS fc, round(ln(ratio) / ln(2), 5) AS log2_ratio, category AS label FROM cat")
def compare_classes(spark, sf_dir):
    a, b = two_tables(spark, sf_dir)
    out = bio.compared(a, b, ["group_name"], "importance_rel")
    return out.select("group_name", r6(F.col("sc") * 100).alias("sc"), r6(F.col("fc") * 100).alias("fc"), F.round("log2_ratio", 5).alias("log2_ratio"), "label")


@query("topk_jaccard", TWO + ", x AS (SELECT group_name, row_number() OVER (ORDER BY v DESC, group_name) AS rank_a FROM sc), y AS (SELECT group_name, row_number() OVER (ORDER BY v DESC, group_name) AS rank_b FROM fc), b AS (SELECT group_name, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b FROM x JOIN y USING (group_name) WHERE rank_a <= 12 AND rank_b <= 12) SELECT *, round(CAST((SELECT count(*) FROM b) AS DOUBLE) / (24 - (SELECT count(*) FROM b)), 6) AS jaccard FROM b")
def topk_jaccard(spark, sf_dir):
    return bio.top_overlap(*two_tables(spark, sf_dir), "group_name", "importance_rel", 12).withColumn("jaccard", r6("jaccard"))


def genes(spark, sf_dir):
    return domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("lr_name"), F.col("p_type").alias("gene")).distinct()


@query("genes_by_category", TWO + ", g2 AS (SELECT c.category, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS genes FROM cat c JOIN part ON p_brand = group_name GROUP BY 1) SELECT t.category, coalesce(genes, '') AS genes FROM (VALUES ('SC-biased'), ('FC-biased'), ('Balanced')) t(category) LEFT JOIN g2 USING (category)")
def genes_by_category(spark, sf_dir):
    return bio.category_genes(imp.categorised(*two_tables(spark, sf_dir)), genes(spark, sf_dir)).select("category", F.array_join("genes", ",").alias("genes"))


@query("gene_ranking", TWO + " SELECT p_type AS gene, round(avg(ln(ratio) / ln(2)), 4) AS score, count(*) AS n FROM cat JOIN (SELECT DISTINCT p_brand, p_type FROM part) ON p_brand = group_name GROUP BY 1")
def gene_ranking(spark, sf_dir):
    return bio.gene_ranking(imp.categorised(*two_tables(spark, sf_dir)), genes(spark, sf_dir)).withColumn("score", F.round("score", 4))


#: Gene sets: parts by type; hits: the parts of some brands; scores: retail prices.
def _sets(spark, sf_dir):
    return domain.table(spark, sf_dir, "part").select(F.concat_ws("_", "p_type", F.col("p_size") % 3).alias("set_name"), F.col("p_partkey").cast("string").alias("gene"))


ORA = """WITH u AS (SELECT CAST(p_partkey AS VARCHAR) AS gene, p_type || '_' || (p_size % 3) AS set_name, p_brand IN ('Brand#11', 'Brand#23') AS hit FROM part),
    c AS (SELECT count(*) AS n_all, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS n_hits FROM u),
    f AS (SELECT set_name, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS k, count(*) AS size FROM u GROUP BY 1 HAVING sum(CASE WHEN hit THEN 1 ELSE 0 END) > 0),
    i AS (SELECT set_name, k, size, n_all, n_hits, unnest(range(CAST(k AS BIGINT), CAST(least(size, n_hits) AS BIGINT) + 1)) AS i FROM f CROSS JOIN c WHERE n_hits >= 3),
    p AS (SELECT set_name, any_value(k) AS k, any_value(size) AS size, least(1.0, sum(CASE WHEN n_hits - i <= n_all - size THEN exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(n_all - size + 1) - lgamma(n_hits - i + 1) - lgamma(n_all - size - n_hits + i + 1) - lgamma(n_all + 1) + lgamma(n_hits + 1) + lgamma(n_all - n_hits + 1)) ELSE 0 END)) AS p FROM i GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY p, set_name) AS nth, count(*) OVER () AS n FROM p)
    SELECT set_name, CAST(k AS BIGINT) AS k, size, round(p, 6) AS p, round(least(1.0, min(p * n / nth) OVER (ORDER BY p, set_name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r"""


@query("ora", ORA)
def ora(spark, sf_dir):
    part = domain.table(spark, sf_dir, "part")
    hits = part.filter("p_brand IN ('Brand#11', 'Brand#23')").select(F.col("p_partkey").cast("string").alias("gene"))
    return bio.over_representation(hits, part.select(F.col("p_partkey").cast("string").alias("gene")), _sets(spark, sf_dir)).select("set_name", "k", "size", r6("p").alias("p"), r6("q").alias("q"))


def _ranking(spark, sf_dir):
    return domain.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("gene"), (F.round("p_retailprice", 2) - 1200).alias("score"))


@query("gsea_running_sum", """WITH s AS (SELECT p_type || '_' || (p_size % 3) AS set_name, CAST(p_partkey AS VARCHAR) AS gene FROM part), r AS (SELECT CAST(p_partkey AS VARCHAR) AS gene, round(p_retailprice, 2) - 1200 AS score FROM part),
    j AS (SELECT n.set_name, r.gene, r.score, s.gene IS NOT NULL AS hit FROM r CROSS JOIN (SELECT DISTINCT set_name FROM s) n LEFT JOIN s ON s.set_name = n.set_name AND s.gene = r.gene),
    k AS (SELECT *, sum(CASE WHEN hit THEN abs(score) ELSE 0 END) OVER w AS hits, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS n_in, count(*) OVER w AS n_all FROM j WINDOW w AS (PARTITION BY set_name)),
    t AS (SELECT set_name, n_in, sum(CASE WHEN hit THEN abs(score) / hits ELSE -1.0 / (n_all - n_in) END) OVER (PARTITION BY set_name ORDER BY score DESC, gene ROWS UNBOUNDED PRECEDING) AS run FROM k)
    SELECT set_name, CAST(any_value(n_in) AS BIGINT) AS size, round(CASE WHEN max(run) >= -min(run) THEN max(run) ELSE min(run) END, 6) AS es FROM t GROUP BY 1""")
def gsea_running_sum(spark, sf_dir):
    return bio.running_enrichment(_ranking(spark, sf_dir), _sets(spark, sf_dir)).withColumn("es", r6("es"))


#: The sets of the permutation test: parts by type, by brand and by both, so that some are of 10 to 500 parts at every size.
GSEA = f"""WITH r AS (SELECT gene, abs(score) AS weight, row_number() OVER (ORDER BY score DESC, gene) AS place, count(*) OVER () AS n_all FROM (SELECT CAST(p_partkey AS VARCHAR) AS gene, round(p_retailprice, 2) - 1200 AS score FROM part)),
    s0 AS (SELECT p_type AS set_name, CAST(p_partkey AS VARCHAR) AS gene FROM part UNION SELECT p_brand, CAST(p_partkey AS VARCHAR) FROM part UNION SELECT p_brand || ' ' || p_type, CAST(p_partkey AS VARCHAR) FROM part),
    s AS (SELECT * FROM s0 WHERE set_name IN (SELECT set_name FROM s0 GROUP BY 1 HAVING count(*) BETWEEN 10 AND 500)),
    plain AS (SELECT place, weight, n_all, row_number() OVER (ORDER BY md5('{SEED}_-1_' || gene), gene) AS nth FROM r),
    drawn AS (SELECT perm, gene, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}_' || perm || '_' || gene), gene) AS nth FROM r CROSS JOIN range({N}) p(perm)),
    m AS (SELECT -1 AS perm, set_name, place, weight, n_all FROM r JOIN s USING (gene) UNION ALL SELECT perm, set_name, place, weight, n_all FROM drawn JOIN plain USING (nth) JOIN s USING (gene)),
    w AS (SELECT *, count(*) OVER (PARTITION BY perm, set_name) AS size, weight / sum(weight) OVER (PARTITION BY perm, set_name) AS share, row_number() OVER o AS i FROM m WINDOW o AS (PARTITION BY perm, set_name ORDER BY place)),
    run AS (SELECT *, sum(share) OVER (PARTITION BY perm, set_name ORDER BY place ROWS UNBOUNDED PRECEDING) AS h, (place - i) / CAST(n_all - size AS DOUBLE) AS fall FROM w),
    e AS (SELECT perm, set_name, any_value(size) AS size, greatest(0, max(h - fall)) AS hi, least(0, min(h - share - fall)) AS lo FROM run GROUP BY 1, 2),
    es AS (SELECT perm, set_name, size, CASE WHEN hi >= -lo THEN hi ELSE lo END AS es FROM e),
    b AS (SELECT o.set_name, o.size, o.es, x.es AS null_es, sign(o.es) = sign(x.es) AS same FROM es o JOIN es x USING (set_name) WHERE o.perm = -1 AND x.perm >= 0),
    t AS (SELECT set_name, size, es, (sum(CASE WHEN same AND abs(null_es) >= abs(es) - 1e-12 THEN 1 ELSE 0 END) + 1.0) / (sum(CASE WHEN same THEN 1 ELSE 0 END) + 1) AS p, es / avg(CASE WHEN same THEN abs(null_es) END) AS nes FROM b GROUP BY 1, 2, 3),
    q0 AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, set_name) AS raw FROM t),
    q AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p, set_name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM q0)
    SELECT set_name, size, round(es, 6) AS es, round(nes, 6) AS nes, round(CAST(p AS DOUBLE), 6) AS p, round(CAST(q AS DOUBLE), 6) AS q, CASE WHEN nes >= 0 THEN 'up' ELSE 'down' END AS direction, q < 0.25 AS significant FROM q WHERE nes IS NOT NULL"""


@query("gsea_permuted", GSEA)
def gsea_permuted(spark, sf_dir):
    part = domain.table(spark, sf_dir, "part")
    names = F.explode(F.array("p_type", "p_brand", F.concat_ws(" ", "p_brand", "p_type"))).alias("set_name")
    out = bio.ranked_enrichment(_ranking(spark, sf_dir), part.select(names, F.col("p_partkey").cast("string").alias("gene")), N, SEED)
    return bio.signed_results([out]).select("set_name", "size", *(r6(c).alias(c) for c in ("es", "nes", "p", "q")), "direction", "significant")


NET = TYPE_EDGES + ", sums AS (SELECT ct_l AS sender, ct_r AS receiver, sum(importance) AS weight FROM x GROUP BY 1, 2), net AS (SELECT * FROM sums WHERE weight >= (SELECT quantile_cont(weight, 0.2) FROM sums))"


def net(spark, sf_dir):
    return graph.type_network(type_features(spark, sf_dir))


@query("celltype_network", NET + " SELECT sender, receiver, round(weight * 100, 5) AS weight FROM net")
def celltype_network(spark, sf_dir):
    return net(spark, sf_dir).withColumn("weight", F.round(F.col("weight") * 100, 5))


DEGREES = NET + ", deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, sum(iw) AS in_strength, sum(ow) AS out_strength, sum(iw) + sum(ow) AS total_strength FROM (SELECT sender AS node, 1 AS o, 0 AS i, weight AS ow, 0 AS iw FROM net UNION ALL SELECT receiver, 0, 1, 0, weight FROM net) GROUP BY 1)"


@query("network_degrees", DEGREES + " SELECT node, in_degree, out_degree, round(in_strength * 100, 5) AS in_strength, round(out_strength * 100, 5) AS out_strength, round(total_strength * 100, 5) AS total_strength FROM deg")
def network_degrees(spark, sf_dir):
    return graph.degrees(net(spark, sf_dir)).select("node", "in_degree", "out_degree", *(F.round(F.col(c) * 100, 5).alias(c) for c in ("in_strength", "out_strength", "total_strength")))


#: Page rank in rounds until the summed change falls below the number of nodes times 1e-6; done is the first such round.
RANKS = """, nodes AS (SELECT sender AS node FROM net UNION SELECT receiver FROM net), tot AS (SELECT sender, sum(weight) AS total FROM net GROUP BY 1),
    sh AS (SELECT sender, receiver, weight / total AS share FROM net JOIN tot USING (sender)), nn AS (SELECT count(*) AS n FROM nodes),
    rounds AS (SELECT 0 AS i, node, CAST(1 AS DOUBLE) / n AS rank, CAST(1 AS DOUBLE) AS change FROM nodes, nn
        UNION ALL SELECT i + 1, node, new, sum(abs(new - rank)) OVER () FROM (
            SELECT r.i, r.node, r.rank, 0.15 / n + 0.85 * (coalesce((SELECT sum(share * f.rank) FROM sh JOIN rounds f ON f.node = sh.sender WHERE sh.receiver = r.node), 0)
                   + coalesce((SELECT sum(f.rank) FROM rounds f WHERE f.node NOT IN (SELECT sender FROM tot)), 0) / n) AS new
            FROM rounds r, nn WHERE r.change >= CASE WHEN r.i = 0 THEN 0 ELSE n * 1e-6 END AND r.i < 100)),
    ranks AS (SELECT node, rank FROM rounds WHERE i = (SELECT max(i) FROM rounds))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("pagerank", recursive(NET + RANKS) + " SELECT node, round(rank, 6) AS rank FROM ranks")
def pagerank(spark, sf_dir):
    return graph.page_rank(net(spark, sf_dir)).withColumn("rank", r6("rank"))


def node_metrics(spark, sf_dir, found=None):
    own = cut(graph.type_network(type_features(spark, sf_dir, found)))
    return graph.degrees(own).join(graph.page_rank(own), "node")


#: The network of the even nations' folds beside that of the odd ones'.
HALF = DEGREES + RANKS + " SELECT d.node, total_strength, rank FROM deg d JOIN ranks p ON p.node = d.node"
EVEN, ODD = (recursive(HALF.replace("AS edges FROM nation)", f"AS edges FROM nation WHERE n_nationkey % 2 = {odd})")) for odd in (0, 1))
LOG_RATIO = "round(log2((coalesce(a.{0}, 0) + 1e-10) / (coalesce(b.{0}, 0) + 1e-10)), 4)"


@query("compare_networks", f"SELECT coalesce(a.node, b.node) AS node, round(coalesce(a.total_strength, 0) * 100, 5) AS strength_sc, round(coalesce(b.total_strength, 0) * 100, 5) AS strength_fc, round(coalesce(a.rank, 0), 6) AS rank_sc, round(coalesce(b.rank, 0), 6) AS rank_fc, {LOG_RATIO.format('total_strength')} AS log2_strength, {LOG_RATIO.format('rank')} AS log2_rank FROM ({EVEN}) a FULL JOIN ({ODD}) b ON a.node = b.node")
def compare_networks(spark, sf_dir):
    gains, folds = complete_gains(spark, sf_dir).select("fold", "feature", "gain"), weights(spark, sf_dir)
    parity = domain.table(spark, sf_dir, "nation").select(F.col("n_name").alias("fold"), (F.col("n_nationkey") % 2).alias("odd"))
    half = lambda odd: node_metrics(spark, sf_dir, imp.aggregated(*(t.join(parity.filter(F.col("odd") == odd), "fold", "left_semi") for t in (gains, folds))))
    out = graph.compared_nodes(half(0), half(1))
    return out.select("node", *(F.round(F.col(c) * 100, 5).alias(c) for c in ("strength_sc", "strength_fc")), r6("rank_sc").alias("rank_sc"), r6("rank_fc").alias("rank_fc"), *(F.round(c, 4).alias(c) for c in ("log2_strength", "log2_rank")))


@query("hubs", recursive(DEGREES + RANKS) + " SELECT d.node, total_strength >= (SELECT quantile_cont(total_strength, 0.8) FROM deg) AS strength_hub, rank >= (SELECT quantile_cont(rank, 0.8) FROM ranks) AS rank_hub FROM deg d JOIN ranks p ON p.node = d.node WHERE total_strength >= (SELECT quantile_cont(total_strength, 0.8) FROM deg) OR rank >= (SELECT quantile_cont(rank, 0.8) FROM ranks)")
def hubs(spark, sf_dir):
    return graph.hubs(node_metrics(spark, sf_dir)).select("node", "strength_hub", "rank_hub")


HUBS = DEGREES + ", cls AS (SELECT node, 'C' || substr(node, 8, 1) AS cell_class, total_strength >= (SELECT quantile_cont(total_strength, 0.8) FROM deg) AS is_hub FROM deg)"


def hub_nodes(spark, sf_dir):
    m = graph.degrees(net(spark, sf_dir))
    limit = m.agg(F.percentile("total_strength", 0.8).alias("l"))
    return m.join(F.broadcast(limit)).select("node", F.concat(F.lit("C"), F.substring("node", 8, 1)).alias("cell_class"), (F.col("total_strength") >= F.col("l")).alias("is_hub"))


@query("hub_permutation", HUBS + f""", h AS (SELECT count(*) AS hubs FROM cls WHERE is_hub), o AS (SELECT cell_class, sum(CASE WHEN is_hub THEN 1.0 ELSE 0 END) / any_value(hubs) AS observed FROM cls, h GROUP BY 1),
    pl AS (SELECT cell_class, row_number() OVER (ORDER BY md5('{SEED}_-1_' || node), node) AS r FROM cls), dr AS (SELECT perm, node, is_hub, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}_' || perm || '_' || node), node) AS r FROM cls CROSS JOIN range({N}) p(perm)),
    nu AS (SELECT perm, c.cell_class, coalesce(k, 0) / hubs AS x FROM (SELECT DISTINCT perm FROM dr) CROSS JOIN (SELECT DISTINCT cell_class FROM cls) c CROSS JOIN h LEFT JOIN (SELECT perm, cell_class, sum(CASE WHEN is_hub THEN 1.0 ELSE 0 END) AS k FROM dr JOIN pl USING (r) GROUP BY 1, 2) q USING (perm, cell_class)),
    m AS (SELECT *, avg(x) OVER (PARTITION BY cell_class) AS mean FROM nu JOIN o USING (cell_class))
    SELECT cell_class, round(CAST(any_value(observed) AS DOUBLE), 6) AS observed, round(CAST(avg(x) AS DOUBLE), 6) AS null_mean, round(CAST(stddev_pop(x) AS DOUBLE), 6) AS null_sd, round(CAST((sum(CASE WHEN abs(x - mean) >= abs(observed - mean) - 1e-12 THEN 1 ELSE 0 END) + 1) / {N + 1}.0 AS DOUBLE), 6) AS p FROM m GROUP BY 1""")
def hub_permutation(spark, sf_dir):
    out = graph.hub_class_test(hub_nodes(spark, sf_dir), N, SEED)
    return out.select("cell_class", *(r6(c).alias(c) for c in ("observed", "null_mean", "null_sd", "p")))


@query("hub_contingency", HUBS + ", c AS (SELECT cell_class, count(CASE WHEN is_hub THEN 1 END) AS a, count(CASE WHEN NOT is_hub THEN 1 END) AS b FROM cls GROUP BY 1) SELECT cell_class, a, b, round((a + b) * (SELECT CAST(sum(a) AS DOUBLE) FROM c) / (SELECT sum(a) + sum(b) FROM c), 6) AS expected_a, round((a + b) * (SELECT CAST(sum(b) AS DOUBLE) FROM c) / (SELECT sum(a) + sum(b) FROM c), 6) AS expected_b FROM c")
def hub_contingency(spark, sf_dir):
    own = hub_nodes(spark, sf_dir)
    return graph.contingency(own.filter("is_hub"), own.filter("NOT is_hub"), "cell_class").withColumns({"expected_a": r6("expected_a"), "expected_b": r6("expected_b")})


@query("network_global", NET + " SELECT count(DISTINCT node) AS nodes, (SELECT count(*) FROM net) AS edges, round((SELECT count(*) FROM net) / CAST(count(DISTINCT node) * (count(DISTINCT node) - 1) AS DOUBLE), 6) AS density FROM (SELECT sender AS node FROM net UNION ALL SELECT receiver FROM net)")
def network_global(spark, sf_dir):
    return graph.global_measures(net(spark, sf_dir)).withColumn("density", r6("density"))


CLUSTERING = NET + """, pr AS (SELECT least(sender, receiver) AS a, greatest(sender, receiver) AS b, max(weight) AS weight FROM net WHERE sender <> receiver GROUP BY 1, 2),
    und AS (SELECT a, b, weight / (SELECT max(weight) FROM pr) AS w FROM pr), sides AS (SELECT a, b, w FROM und UNION ALL SELECT b, a, w FROM und),
    t AS (SELECT x.a AS v, sum(cbrt(x.w * y.w * z.w)) AS t FROM sides x JOIN sides y ON x.a = y.a AND x.b < y.b JOIN und z ON z.a = x.b AND z.b = y.b GROUP BY 1),
    k AS (SELECT a AS v, count(*) AS k FROM sides GROUP BY 1), n AS (SELECT sender AS v FROM net UNION SELECT receiver FROM net)
    SELECT round(avg(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END), 6) AS clustering FROM n LEFT JOIN k USING (v) LEFT JOIN t USING (v)"""


@query("network_clustering", CLUSTERING)
def network_clustering(spark, sf_dir):
    return graph.clustering(net(spark, sf_dir)).withColumn("clustering", r6("clustering"))


#: Lengths by doubling (ways of 64 edges at most, among 52 nodes), ways by edges, and each node's share in those of every pair.
BETWEENNESS = NET + ", nodes AS (SELECT sender AS node FROM net UNION SELECT receiver FROM net), d0 AS (SELECT sender AS a, receiver AS b, weight AS d FROM net WHERE sender <> receiver UNION ALL SELECT node, node, 0 FROM nodes)"
for _i in range(6):
    BETWEENNESS += f", d{_i + 1} AS MATERIALIZED (SELECT x.a, y.b, min(x.d + y.d) AS d FROM d{_i} x JOIN d{_i} y ON x.b = y.a GROUP BY 1, 2)"
BETWEENNESS += """, dag AS (SELECT s.a AS s, e.sender AS u, e.receiver AS v FROM d6 s JOIN net e ON e.sender = s.b JOIN d6 t ON t.a = s.a AND t.b = e.receiver WHERE s.d + e.weight <= t.d * (1 + 1e-12)),
    hops AS (SELECT node AS s, node AS v, 0 AS h, CAST(1 AS DOUBLE) AS k FROM nodes UNION ALL SELECT g.s, g.v, h + 1, sum(k) FROM hops p JOIN dag g ON g.s = p.s AND g.u = p.v GROUP BY 1, 2, 3),
    ways AS (SELECT s, v, sum(k) AS k FROM hops GROUP BY 1, 2),
    routes AS (SELECT d.a, d.b, d.d, k FROM d6 d JOIN ways ON s = a AND v = b WHERE a <> b),
    via AS (SELECT x.b AS node, sum(x.k * y.k / z.k) AS owed FROM routes x JOIN routes y ON y.a = x.b JOIN routes z ON z.a = x.a AND z.b = y.b WHERE x.d + y.d <= z.d * (1 + 1e-12) GROUP BY 1),
    c AS (SELECT count(*) AS n FROM nodes)
    SELECT o.node, round(coalesce(owed, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM nodes o CROSS JOIN c LEFT JOIN via ON via.node = o.node"""


@query("network_betweenness", recursive(BETWEENNESS))
def network_betweenness(spark, sf_dir):
    return graph.betweenness(net(spark, sf_dir)).withColumn("betweenness", r6("betweenness"))


@query("network_communities")
def network_communities(spark, sf_dir):
    return graph.communities(net(spark, sf_dir))


#: Space: nations are areas, regions are regions; two regions share areas; customers are voxels and sizes.
BRIDGE = "bridge AS (SELECT DISTINCT r_name AS region, n_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name || ' II', n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION SELECT 'MIXED', n_name FROM nation WHERE n_nationkey < 3), sizes AS (SELECT n_name AS area, CAST(count(*) AS DOUBLE) AS voxels FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey > 0 GROUP BY 1)"
CENTRES = "centre AS (SELECT n_name AS area, 2 * avg(c_custkey % 50) - 10 AS x, 2 * avg(c_custkey % 31) + 5 AS y, 2 * avg(c_custkey % 17) AS z FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"
PEQ = "peq AS (SELECT region, area, 1.0 / count(*) OVER (PARTITION BY region) AS p FROM bridge)"
PVOX = "pvox AS (SELECT region, area, CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 1.0 / count(*) OVER w END AS p FROM (SELECT region, area, coalesce(voxels, 0) AS v FROM bridge LEFT JOIN sizes USING (area)) WINDOW w AS (PARTITION BY region))"
SPACE = f"WITH {BRIDGE}, {CENTRES}, {PEQ}, {PVOX}, conn AS (SELECT a.n_name AS src, b.n_name AS tgt, CAST((a.n_nationkey * 7 + b.n_nationkey * 3) % 11 AS DOUBLE) AS v FROM nation a CROSS JOIN nation b)"


def areas(spark, sf_dir):
    return domain.table(spark, sf_dir, "nation").select(F.col("n_name").alias("area"))


def bridge(spark, sf_dir):
    nation, region = domain.table(spark, sf_dir, "nation"), domain.table(spark, sf_dir, "region")
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    lists = own.groupBy("r_name").agg(F.array_join(F.collect_list("n_name"), " + ").alias("areas")).select(F.when(F.col("r_name") == "ASIA", "ASIA + ASIA II").otherwise(F.col("r_name")).alias("regions"), "areas")
    mixed = nation.filter("n_nationkey < 3").agg(F.array_join(F.collect_list("n_name"), "+").alias("areas")).select(F.lit("MIXED").alias("regions"), F.concat("areas", F.lit("+Nowhere")).alias("areas"))
    return spatial.region_bridge(lists.unionByName(mixed), "regions", "areas", areas(spark, sf_dir))


def sizes(spark, sf_dir):
    own = domain.table(spark, sf_dir, "customer").join(F.broadcast(domain.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).filter("n_nationkey > 0")
    return spatial.aligned_sizes(areas(spark, sf_dir), own.groupBy(F.col("n_name").alias("area")).agg(F.count("*").cast("double").alias("voxels")))


def centres(spark, sf_dir):
    voxels = domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k0"), (F.col("c_nationkey") + 1).alias("label"))
    found = spatial.area_centroids(voxels.select((F.col("k0") % 50).alias("i"), (F.col("k0") % 31).alias("j"), (F.col("k0") % 17).alias("k"), "label"), [[2, 0, 0, -10], [0, 2, 0, 5], [0, 0, 2, 0], [0, 0, 0, 1]])
    names = domain.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("area"), F.col("n_name").alias("name"))
    return found.join(F.broadcast(names), "area").select(F.col("name").alias("area"), "x", "y", "z")


@query("region_bridge", SPACE + " SELECT region, area FROM bridge")
def region_bridge(spark, sf_dir):
    return bridge(spark, sf_dir)


@query("voxel_counts", SPACE + " SELECT n_name AS area, coalesce(voxels, 0) AS voxels FROM nation LEFT JOIN sizes ON area = n_name")
def voxel_counts(spark, sf_dir):
    return sizes(spark, sf_dir)


@query("area_centroids", SPACE + " SELECT area, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM centre")
def area_centroids(spark, sf_dir):
    return centres(spark, sf_dir).select("area", *(r6(c).alias(c) for c in "xyz"))


@query("region_centroids", SPACE + " SELECT region, round(sum(p * x) / sum(p), 6) AS x, round(sum(p * y) / sum(p), 6) AS y, round(sum(p * z) / sum(p), 6) AS z FROM pvox JOIN centre USING (area) GROUP BY 1")
def region_centroids(spark, sf_dir):
    out = spatial.weighted_centroids(spatial.shares(bridge(spark, sf_dir), sizes(spark, sf_dir)), centres(spark, sf_dir))
    return out.select("region", *(r6(c).alias(c) for c in "xyz"))


@query("distance_matrix", SPACE + " SELECT a.area AS src, b.area AS tgt, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS d FROM centre a CROSS JOIN centre b")
def distance_matrix(spark, sf_dir):
    return spatial.distances(centres(spark, sf_dir), "area").withColumn("d", r6("d"))


@query("distance_checks", "SELECT 0 AS missing, 0 AS invalid, 0 AS diagonal, 0 AS asymmetric, 0 AS zero")
def distance_checks(spark, sf_dir):
    out = spatial.distance_faults(spatial.distances(centres(spark, sf_dir), "area"), 25, positive=True)
    return out.select(*(F.col(c).cast("int").alias(c) for c in out.columns))


def _project(p: str) -> str:
    return SPACE + f" SELECT a.region AS src, b.region AS tgt, round(CAST(sum(a.p * v * b.p) AS DOUBLE), 6) AS v FROM conn JOIN {p} a ON a.area = src JOIN {p} b ON b.area = tgt GROUP BY 1, 2"


def conn(spark, sf_dir):
    own = domain.table(spark, sf_dir, "nation").select(F.col("n_name").alias("src"), F.col("n_nationkey").alias("i"))
    to = own.select(F.col("src").alias("tgt"), F.col("i").alias("j"))
    return own.crossJoin(to).select("src", "tgt", ((F.col("i") * 7 + F.col("j") * 3) % 11).cast("double").alias("v"))


@query("project_equal", _project("peq"))
def project_equal(spark, sf_dir):
    return spatial.projected(conn(spark, sf_dir), spatial.shares(bridge(spark, sf_dir), None)).withColumn("v", r6("v"))


@query("project_voxel", _project("pvox"))
def project_voxel(spark, sf_dir):
    return spatial.projected(conn(spark, sf_dir), spatial.shares(bridge(spark, sf_dir), sizes(spark, sf_dir))).withColumn("v", r6("v"))


UNIQUE = SPACE + ", st AS (SELECT region, string_agg(area, ',' ORDER BY area) AS areas FROM bridge GROUP BY 1), un AS (SELECT region, areas, dense_rank() OVER (ORDER BY f) - 1 AS group_id FROM (SELECT *, min(region) OVER (PARTITION BY areas) AS f FROM st))"


@query("unique_nodes", UNIQUE + " SELECT CAST(group_id AS INTEGER) AS group_id, region, areas FROM un")
def unique_nodes(spark, sf_dir):
    return spatial.unique_nodes(bridge(spark, sf_dir)).withColumn("areas", F.array_join("areas", ","))


@query("unique_roundtrip", UNIQUE + ", val AS (SELECT region, CAST(length(region) AS DOUBLE) AS v FROM un), wt AS (SELECT region, sum(coalesce(voxels, 0)) AS w FROM bridge LEFT JOIN sizes USING (area) GROUP BY 1), g AS (SELECT group_id, CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) ELSE avg(v) END AS v FROM un JOIN val USING (region) JOIN wt USING (region) GROUP BY 1) SELECT region, round(g.v, 6) AS v FROM un JOIN g USING (group_id)")
def unique_roundtrip(spark, sf_dir):
    nodes = spatial.unique_nodes(bridge(spark, sf_dir))
    values = nodes.select("region", F.length("region").cast("double").alias("v"))
    return spatial.from_unique(spatial.to_unique(values, nodes, sizes(spark, sf_dir)), nodes).withColumn("v", r6("v"))


LOGS = ROWS + f", {EDGES}, lx AS (SELECT feature, src_region, tgt_region, ln(greatest(value, 0.001)) AS x FROM f WHERE src_region <> tgt_region), ba AS (SELECT feature, avg(x) AS b FROM lx GROUP BY 1), lm AS (SELECT ba.feature, s.side, n.region, coalesce(m.v, b) AS v FROM ba CROSS JOIN names n CROSS JOIN (VALUES ('source'), ('target')) s(side) LEFT JOIN (SELECT feature, 'source' AS side, src_region AS region, avg(x) AS v FROM lx GROUP BY 1, 2, 3 UNION ALL SELECT feature, 'target', tgt_region, avg(x) FROM lx GROUP BY 1, 2, 3) m ON m.feature = ba.feature AND m.side = s.side AND m.region = n.region)"


def marginals(spark, sf_dir):
    return cut(spatial.log_marginals(edge_rows(spark, sf_dir).select("feature", "src_region", "tgt_region", "value"), domain.table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))))


@query("log_marginals", LOGS + " SELECT feature, side, region, round(v, 6) AS v FROM lm UNION ALL SELECT feature, 'all', NULL, round(b, 6) FROM ba")
def log_marginals(spark, sf_dir):
    return marginals(spark, sf_dir).withColumn("v", r6("v"))


@query("reconstruct_features", LOGS + " SELECT l.feature, edge_idx, round(exp(l.v + r.v - b), 6) AS value FROM edges JOIN lm l ON l.side = 'source' AND l.region = src_region JOIN lm r ON r.side = 'target' AND r.region = tgt_region AND r.feature = l.feature JOIN ba ON ba.feature = l.feature")
def reconstruct_features(spark, sf_dir):
    return spatial.reconstructed(marginals(spark, sf_dir), region_edges(spark, sf_dir)).withColumn("value", r6("value"))


@query("null_test", "WITH n AS (SELECT n_name AS k, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT n_name AS k, CAST(n_nationkey * 300 AS DOUBLE) AS real FROM nation), s AS (SELECT k, any_value(real) AS real, (sum(CASE WHEN v >= real THEN 1 ELSE 0 END) + 1) / (count(*) + 1.0) AS p, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS median FROM n JOIN r USING (k) GROUP BY 1) SELECT k, real, round(CAST(p AS DOUBLE), 6) AS p, round(mean, 4) AS mean, round(sd, 4) AS sd, round(median, 4) AS median, round((real - mean) / sd, 6) AS z FROM s")
def null_test(spark, sf_dir):
    nation = domain.table(spark, sf_dir, "nation")
    null = domain.table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("k"), F.col("c_acctbal").alias("v"))
    out = spatial.null_summary(null, nation.select(F.col("n_name").alias("k"), (F.col("n_nationkey") * 300).cast("double").alias("real")), ["k"])
    return out.select("k", "real", r6("p").alias("p"), *(F.round(c, 4).alias(c) for c in ("mean", "sd", "median")), r6("z").alias("z"))


@query("pseudo_cells", f"WITH {CELLS}, {EXPR}, {MEANS} SELECT region, cell_type, gene, round(value * count(*), 5) AS value FROM cells JOIN means USING (region) WHERE cell_type <> 'BUILDING' GROUP BY region, cell_type, gene, value")
def pseudo_cells(spark, sf_dir):
    cells = domain.cells(spark, sf_dir)
    abundance = pre.pair_counts(cells).select("region", "cell_type", F.col("cells").cast("double").alias("abundance"))
    return spatial.pseudo_cells(abundance, region_table(spark, sf_dir), cells.filter("cell_type <> 'BUILDING'")).withColumn("value", F.round("value", 5))


HET = "tm AS (SELECT c.region, c.cell_type, e.gene, sum(value) / any_value(n.size) AS value FROM expr e JOIN cells c USING (cell_id) JOIN (SELECT region, cell_type, count(*) AS size FROM cells GROUP BY 1, 2) n ON n.region = c.region AND n.cell_type = c.cell_type GROUP BY 1, 2, 3), en AS (SELECT region, gene, sum(CASE WHEN p > 0 THEN -p * ln(p) / ln(2) END) AS entropy FROM (SELECT region, gene, value / sum(value) OVER (PARTITION BY region, gene) AS p FROM tm) GROUP BY 1, 2)"
GINI = "gn AS (SELECT region, gene, sum((2 * i - n - 1) * value) / (any_value(n) * sum(value)) AS gini FROM (SELECT region, gene, value, row_number() OVER (PARTITION BY region, gene ORDER BY value) AS i, count(*) OVER (PARTITION BY region, gene) AS n FROM (SELECT c.region, g.gene, coalesce(e.value, 0) AS value FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene)) GROUP BY 1, 2)"


def entropies(spark, sf_dir):
    means = pre.region_means(domain.expression(spark, sf_dir), domain.cells(spark, sf_dir).select("cell_id", "region", "cell_type"), ["region", "cell_type"], "none")
    return heterogeneity.type_entropy(means, ["region", "gene"])


def ginis(spark, sf_dir):
    cells = domain.cells(spark, sf_dir).select("cell_id", "region")
    return heterogeneity.gini(cells.join(domain.expression(spark, sf_dir), "cell_id").select("region", "gene", "value"), cells.groupBy("region").agg(F.count("*").alias("size")), ["region", "gene"], ["region"])


@query("entropy", f"WITH {CELLS}, {EXPR}, {HET} SELECT region, gene, round(entropy, 6) AS entropy FROM en")
def entropy(spark, sf_dir):
    return entropies(spark, sf_dir).withColumn("entropy", r6("entropy"))


@query("gini", f"WITH {CELLS}, {EXPR}, {GINI} SELECT region, gene, round(CAST(gini AS DOUBLE), 6) AS gini FROM gn")
def gini(spark, sf_dir):
    return ginis(spark, sf_dir).withColumn("gini", r6("gini"))


@query("heterogeneity_by_rule", f"WITH {CELLS}, {EXPR}, {RULES}, {HET}, {GINI}, m AS (SELECT gene, avg(entropy) AS entropy, avg(gini) AS gini FROM en JOIN gn USING (region, gene) GROUP BY 1) SELECT lr_name, round(avg(entropy), 6) AS entropy, round(CAST(avg(gini) AS DOUBLE), 6) AS gini FROM m JOIN (SELECT DISTINCT lr_name, gene FROM lr_gene) USING (gene) GROUP BY 1")
def heterogeneity_by_rule(spark, sf_dir):
    both = entropies(spark, sf_dir).join(ginis(spark, sf_dir), ["region", "gene"])
    out = heterogeneity.by_rule(both, infer.rule_genes(domain.rule_table(spark)), ["entropy", "gini"])
    return out.select("lr_name", r6("entropy").alias("entropy"), r6("gini").alias("gini"))


HET_SEED = 42
_TEST = f"""{AGG}, {CELLS}, {EXPR}, {HET}, {GINI}, im AS (SELECT lr_name, round(sum(importance_rel), 9) AS x FROM a GROUP BY 1), hm AS (SELECT gene, round(avg(entropy), 9) AS entropy, round(avg(gini), 9) AS gini FROM en JOIN gn USING (region, gene) GROUP BY 1),
    ok AS (SELECT lr_name, x, -entropy AS e, gini AS i FROM im JOIN hm ON gene = lr_name WHERE x IS NOT NULL AND entropy IS NOT NULL AND gini IS NOT NULL),
    rk AS (SELECT lr_name, {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{c}' for c in 'xei')} FROM ok),
    plain AS (SELECT rx, row_number() OVER (ORDER BY md5('{HET_SEED}_-1_' || lr_name), lr_name) AS k FROM rk),
    drawn AS (SELECT perm, lr_name, row_number() OVER (PARTITION BY perm ORDER BY md5('{HET_SEED}_' || perm || '_' || lr_name), lr_name) AS k FROM rk CROSS JOIN range({N}) p(perm)),
    nu AS (SELECT perm, sum(plain.rx * re) AS e, sum(plain.rx * ri) AS i FROM drawn JOIN plain USING (k) JOIN rk USING (lr_name) GROUP BY 1), ow AS (SELECT count(*) AS rules, sum(rx * re) AS e, sum(rx * ri) AS i, corr(rx, re) AS ce, corr(rx, ri) AS ci FROM rk)
    SELECT rules, round(ce, 6) AS rho_entropy, round(ci, 6) AS rho_gini, {', '.join(f'round(CAST((SELECT count(*) + 1 FROM nu WHERE nu.{c} >= ow.{c}) / {N + 1}.0 AS DOUBLE), 6) AS p_{name}' for c, name in (('e', 'entropy'), ('i', 'gini')))} FROM ow"""


@query("importance_vs_heterogeneity", _TEST)
def importance_vs_heterogeneity(spark, sf_dir):
    found = importances(spark, sf_dir).join(meta(spark, sf_dir).select("feature", "lr_name"), "feature").groupBy("lr_name").agg(F.round(F.sum("importance_rel"), 9).alias("importance"))
    genes = entropies(spark, sf_dir).join(ginis(spark, sf_dir), ["region", "gene"]).groupBy(F.col("gene").alias("lr_name")).agg(F.round(F.avg("entropy"), 9).alias("entropy"), F.round(F.avg("gini"), 9).alias("gini"))
    out = heterogeneity.importance_test(found.join(genes, "lr_name"), N, HET_SEED)
    return out.select("rules", *(r6(c).alias(c) for c in out.columns[1:]))
