"""Queries over rankings, permutation tests, intervals and decay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import mean_positive, r6
from ..operators import characterize as char
from ..operators import features, infer
from ..sources import domain
from ..sources.work import cut
from .inference import BASE
from .preparation import network
from .registry import CELLS, query

N, SEED = 1000, 11
SUMMED = BASE + ", sm AS (SELECT sender, receiver, sum(prob) AS weight FROM net0 GROUP BY 1, 2), lab AS (SELECT DISTINCT node, region, cell_type FROM cells)"
POS = "coalesce(avg(CASE WHEN weight > 0 THEN weight END), 0)"
#: Segments stand in for cell types; which of them count as neurons is arbitrary.
GROUPS = [("BUILDING", "Neuron"), ("MACHINERY", "Neuron"), ("FURNITURE", "Glia"), ("HOUSEHOLD", "Glia")]


def summed(spark, sf_dir):
    return infer.aggregate_network(network(spark, sf_dir))


def labels(spark, sf_dir):
    return domain.cells(spark, sf_dir).select("node", "region", "cell_type").distinct()


@query("summed_net", SUMMED + " SELECT sender, receiver, round(weight, 5) AS weight FROM sm")
def summed_net(spark, sf_dir):
    return summed(spark, sf_dir).withColumn("weight", F.round("weight", 5))


@query("positive_summary", SUMMED + f" SELECT split_part(sender, '::', 1) AS region, round({POS}, 6) AS mean, count(CASE WHEN weight > 0 THEN 1 END) AS n FROM sm GROUP BY 1")
def positive_summary(spark, sf_dir):
    return summed(spark, sf_dir).groupBy(features.region_of("sender").alias("region")).agg(r6(mean_positive("weight")).alias("mean"), F.count(F.when(F.col("weight") > 0, 1)).alias("n"))


def _tested(label: str) -> str:
    def null(side: str, seed: int, name: str) -> str:
        return f"""pl{name} AS (SELECT {label}, row_number() OVER (ORDER BY md5('{seed}_-1_' || node), node) AS r FROM lab),
            dr{name} AS (SELECT perm, node, row_number() OVER (PARTITION BY perm ORDER BY md5('{seed}_' || perm || '_' || node), node) AS r FROM lab CROSS JOIN range({N}) p(perm)),
            nu{name} AS (SELECT perm, {label}, {POS} AS m FROM sm JOIN dr{name} d ON d.node = sm.{side} JOIN pl{name} USING (r) GROUP BY 1, 2),
            p{name} AS (SELECT {label}, (sum(CASE WHEN m >= {name}_mean - 1e-12 THEN 1 ELSE 0 END) + 1) / {N + 1}.0 AS p_{name} FROM nu{name} JOIN obs USING ({label}) GROUP BY 1)"""

    q = lambda n: f"least(1.0, min(p_{n} * cnt / r{n}) OVER (ORDER BY p_{n}, {label} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    star = lambda n: f"CASE WHEN q_{n} < 0.001 THEN '***' WHEN q_{n} < 0.01 THEN '**' WHEN q_{n} < 0.05 THEN '*' ELSE '' END"
    return SUMMED + f""", o AS (SELECT {label}, {POS} AS out_mean FROM sm JOIN lab ON node = sender GROUP BY 1), i AS (SELECT {label}, {POS} AS in_mean FROM sm JOIN lab ON node = receiver GROUP BY 1),
        obs AS (SELECT {label}, out_mean, in_mean FROM o JOIN i USING ({label})), {null('sender', SEED, 'out')}, {null('receiver', SEED + 1, 'in')},
        j AS (SELECT *, count(*) OVER () AS cnt, row_number() OVER (ORDER BY p_out, {label}) AS rout, row_number() OVER (ORDER BY p_in, {label}) AS rin FROM obs JOIN pout USING ({label}) JOIN pin USING ({label})),
        z AS (SELECT *, {q('out')} AS q_out, {q('in')} AS q_in FROM j)
        SELECT {label}, round(out_mean, 6) AS out_mean, round(in_mean, 6) AS in_mean, round(CAST(p_out AS DOUBLE), 6) AS p_out, round(CAST(p_in AS DOUBLE), 6) AS p_in, round(CAST(q_out AS DOUBLE), 6) AS q_out, round(CAST(q_in AS DOUBLE), 6) AS q_in, {star('out')} AS sig_out, {star('in')} AS sig_in FROM z"""


def _label_test(spark, sf_dir, label):
    out = char.label_permutation_test(summed(spark, sf_dir), labels(spark, sf_dir), label, N, SEED)
    return out.select(label, *(r6(c).alias(c) for c in ("out_mean", "in_mean", "p_out", "p_in", "q_out", "q_in")), "sig_out", "sig_in")


@query("top_celltypes", _tested("cell_type"))
def top_celltypes(spark, sf_dir):
    return _label_test(spark, sf_dir, "cell_type")


@query("top_regions", _tested("region"))
def top_regions(spark, sf_dir):
    return _label_test(spark, sf_dir, "region")


def _pairs(label: str) -> str:
    return SUMMED + f" SELECT a.{label} AS source, b.{label} AS target, round({POS}, 6) AS mean FROM sm JOIN lab a ON a.node = sender JOIN lab b ON b.node = receiver WHERE a.{label} <> b.{label} GROUP BY 1, 2 HAVING {POS} > 0 ORDER BY {POS} DESC, source, target LIMIT 7"


@query("top_region_pairs", _pairs("region"))
def top_region_pairs(spark, sf_dir):
    return char.top_pairs(summed(spark, sf_dir), labels(spark, sf_dir), "region", 7).withColumn("mean", r6("mean"))


@query("top_celltype_pairs", _pairs("cell_type"))
def top_celltype_pairs(spark, sf_dir):
    return char.top_pairs(summed(spark, sf_dir), labels(spark, sf_dir), "cell_type", 7).withColumn("mean", r6("mean"))


@query("top_lr", BASE + " SELECT row_number() OVER (ORDER BY mean DESC, lr_name DESC) AS rank, lr_name, n_positive, round(mean, 6) AS mean, CASE WHEN n_positive >= 10 THEN CAST(1 AS DOUBLE) END AS p, CASE WHEN n_positive >= 10 THEN CAST(1 AS DOUBLE) END AS q, CASE WHEN n_positive >= 10 THEN '' ELSE 'n<10' END AS sig FROM (SELECT lr_name, coalesce(avg(CASE WHEN prob > 0 THEN prob END), 0) AS mean, count(CASE WHEN prob > 0 THEN 1 END) AS n_positive FROM net0 GROUP BY 1) ORDER BY mean DESC, lr_name DESC LIMIT 20")
def top_lr(spark, sf_dir):
    out = char.ranked_rules(network(spark, sf_dir), 20)
    return out.select(F.col("rank").cast("long").alias("rank"), "lr_name", "n_positive", r6("mean").alias("mean"), "p", "q", "sig")


@query("bootstrap_ci", SUMMED + f""", v AS (SELECT split_part(sender, '::', 1) AS region, round(weight, 9) AS weight, row_number() OVER (PARTITION BY split_part(sender, '::', 1) ORDER BY sender, receiver) - 1 AS i, count(*) OVER (PARTITION BY split_part(sender, '::', 1)) AS n FROM sm WHERE weight > 0),
    d AS (SELECT region, boot, CAST(('0x' || substr(md5('{SEED}_' || boot || '_' || i), 1, 15)) AS BIGINT) % n AS j FROM v CROSS JOIN range({N}) b(boot)),
    m AS (SELECT d.region, boot, avg(weight) AS mean FROM d JOIN v ON v.region = d.region AND v.i = d.j GROUP BY 1, 2)
    SELECT region, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM m GROUP BY 1""")
def bootstrap_ci(spark, sf_dir):
    values = cut(summed(spark, sf_dir)).select(features.region_of("sender").alias("region"), "sender", "receiver", F.round("weight", 9).alias("weight"))
    out = char.bootstrap_interval(values, ["region"], "weight", ["sender", "receiver"], N, SEED)
    return out.select("region", *(r6(c).alias(c) for c in ("mean", "lo", "hi")))


#: Nations as regions: strength of two nations' segments against the gap between their keys.
DECAY = f"""WITH {CELLS}, g(cell_type, grp) AS (VALUES {', '.join(str(x) for x in GROUPS)}),
    w AS (SELECT n_nationkey AS k, n_name AS region, c_mktsegment AS ct, avg(c_acctbal) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
    e AS (SELECT a.region AS source, b.region AS target, ga.grp || '-' || gb.grp AS category, min(abs(a.k - b.k)) AS length, avg(a.s + 2 * b.s) AS weight FROM w a JOIN w b ON a.region <> b.region JOIN g ga ON ga.cell_type = a.ct JOIN g gb ON gb.cell_type = b.ct GROUP BY 1, 2, 3),
    f AS (SELECT *, CASE WHEN floor(length / 5.0) * 5 = 0 THEN 2.0 ELSE floor(length / 5.0) * 5 END AS bin FROM e WHERE length >= 2)"""


def decay_edges(spark, sf_dir):
    nation = domain.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    own = domain.table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey").groupBy("c_nationkey", "region", "c_mktsegment").agg(F.avg("c_acctbal").alias("s"))
    a = own.select(F.col("c_nationkey").alias("ka"), F.col("region").alias("source"), F.col("c_mktsegment").alias("ct_source"), F.col("s").alias("sa"))
    b = own.select(F.col("c_nationkey").alias("kb"), F.col("region").alias("target"), F.col("c_mktsegment").alias("ct_target"), F.col("s").alias("sb"))
    return a.crossJoin(b).select("source", "target", "ct_source", "ct_target", F.abs(F.col("ka") - F.col("kb")).alias("length"), (F.col("sa") + 2 * F.col("sb")).alias("weight"))


def _decay(spark, sf_dir):
    return char.decay(decay_edges(spark, sf_dir), spark.createDataFrame(GROUPS, "cell_type string, grp string"), 5.0, 2.0)


@query("distance_decay_bins", DECAY + " SELECT category, CAST(bin AS DOUBLE) AS bin, round(avg(weight), 4) AS mean, round(coalesce(stddev_samp(weight), 0), 4) AS sd, count(*) AS n FROM f GROUP BY 1, 2")
def distance_decay_bins(spark, sf_dir):
    return _decay(spark, sf_dir)[0].withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query("distance_decay_corr", DECAY + " SELECT category, count(*) AS n, round(covar_pop(length, weight) / (stddev_pop(length) * stddev_pop(weight)), 6) AS r, round(avg(weight), 4) AS mean, min(length) AS shortest, max(length) AS longest FROM f GROUP BY 1")
def distance_decay_corr(spark, sf_dir):
    return _decay(spark, sf_dir)[1].withColumns({"r": r6("r"), "mean": F.round("mean", 4)})
