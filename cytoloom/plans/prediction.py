"""Queries over folds, metrics, comparison of runs, and importances.

Nations are regions here; the target of a pair follows from its nations' mean balances, and predictions are a closed
formula, so that every engine has the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.resample import subset_draws
from ..functions.stats import bh_adjusted, r6
from ..operators import importance as imp
from ..operators import validation as val
from ..sources import domain
from .registry import query

N, DIFFERENCES, SEED = 1000, 5000, 5
PAIRS = """b AS (SELECT n_nationkey AS k, n_name AS region, round(avg(c_acctbal) + 1e-7, 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    e AS (SELECT CAST(a.k + 25 * c.k AS BIGINT) AS edge_idx, a.region AS src_region, c.region AS tgt_region, round((a.s - c.s) / 100 + a.k, 4) AS y, round((a.s - c.s) / 100 + a.k, 4) * 0.9 + ((a.k * 7 + c.k * 13) % 11 - 5) / 10.0 AS y_hat FROM b a CROSS JOIN b c)"""
FOLDS = f"WITH {PAIRS}, r AS (SELECT region AS fold FROM b), f AS (SELECT fold, e.*, src_region = fold OR tgt_region = fold AS is_test FROM e CROSS JOIN r)"
UNIQUE = FOLDS + ", t AS (SELECT * FROM f WHERE is_test), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_idx ORDER BY CASE WHEN fold = src_region THEN 0 WHEN fold = tgt_region THEN 1 ELSE 2 END, fold) AS n FROM t) WHERE n = 1)"


def edges(spark, sf_dir):
    nation = domain.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    own = domain.table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey").groupBy(F.col("c_nationkey").alias("k"), "region").agg(F.round(F.avg("c_acctbal") + 1e-7, 2).alias("s"))
    a = own.select(F.col("k").alias("ka"), F.col("region").alias("src_region"), F.col("s").alias("sa"))
    b = own.select(F.col("k").alias("kb"), F.col("region").alias("tgt_region"), F.col("s").alias("sb"))
    y = F.round((F.col("sa") - F.col("sb")) / 100 + F.col("ka"), 4)
    hat = F.col("y") * 0.9 + ((F.col("ka") * 7 + F.col("kb") * 13) % 11 - 5) / F.lit(10.0)
    return a.join(F.broadcast(b)).select((F.col("ka") + 25 * F.col("kb")).cast("long").alias("edge_idx"), "src_region", "tgt_region", "ka", "kb", y.alias("y")).withColumn("y_hat", hat).drop("ka", "kb")


def regions(spark, sf_dir):
    return domain.table(spark, sf_dir, "nation").select(F.col("n_name").alias("region"))


def folds(spark, sf_dir):
    return val.fold_rows(edges(spark, sf_dir), regions(spark, sf_dir))


def candidates(spark, sf_dir):
    return folds(spark, sf_dir).filter("is_test")


@query("lobo_folds", FOLDS + " SELECT fold, count(*) AS n, count(CASE WHEN is_test THEN 1 END) AS n_test, round(sum(CASE WHEN is_test THEN y ELSE 0 END), 3) AS y_test FROM f GROUP BY fold")
def lobo_folds(spark, sf_dir):
    return folds(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_test"), 1)).alias("n_test"), F.round(F.sum(F.when(F.col("is_test"), F.col("y")).otherwise(0.0)), 3).alias("y_test"))


@query("usable_targets", FOLDS + " SELECT 'SC' AS data_type, count(*) AS n FROM e WHERE y > 0.5 UNION ALL SELECT 'FC', count(*) FROM e WHERE y <> 0")
def usable_targets(spark, sf_dir):
    own = edges(spark, sf_dir)
    return own.filter(val.usable("y", "SC", 0.5)).agg(F.count("*").alias("n")).select(F.lit("SC").alias("data_type"), "n").unionByName(own.filter(val.usable("y", "FC")).agg(F.count("*").alias("n")).select(F.lit("FC").alias("data_type"), "n"))


@query("log1p_shift", FOLDS + " SELECT fold, edge_idx, round(y - least(0, min(y) OVER (PARTITION BY fold)), 6) AS y_raw, round(ln(1 + y - least(0, min(y) OVER (PARTITION BY fold))), 6) AS y_t FROM f")
def log1p_shift(spark, sf_dir):
    return val.transformed(folds(spark, sf_dir), "log1p").select("fold", "edge_idx", r6("y_raw").alias("y_raw"), r6("y_t").alias("y_t"))


@query("ecdf", FOLDS + ", h AS (SELECT fold, edge_idx, sum(CASE WHEN is_test THEN 0 ELSE 1 END) OVER (PARTITION BY fold ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, sum(CASE WHEN is_test THEN 0 ELSE 1 END) OVER (PARTITION BY fold) AS b FROM f) SELECT fold, edge_idx, round(CAST(a AS DOUBLE) / b, 6) AS y_t FROM h")
def ecdf(spark, sf_dir):
    return val.transformed(folds(spark, sf_dir), "ecdf").select("fold", "edge_idx", r6("y_t").alias("y_t"))


@query("assign_unique_edges", UNIQUE + " SELECT edge_idx, fold, round(y, 4) AS y FROM u")
def assign_unique_edges(spark, sf_dir):
    return val.unique_edges(candidates(spark, sf_dir)).select("edge_idx", "fold", F.round("y", 4).alias("y"))


@query("fold_weights", UNIQUE + " SELECT fold, count(*) AS edges FROM u GROUP BY fold")
def fold_weights(spark, sf_dir):
    return val.fold_weights(val.unique_edges(candidates(spark, sf_dir)))


@query("summarize_candidates", UNIQUE + " SELECT CAST(least(3, n) AS INTEGER) AS candidates, count(*) AS edges FROM (SELECT edge_idx, count(*) AS n FROM t GROUP BY 1) GROUP BY 1")
def summarize_candidates(spark, sf_dir):
    return val.candidate_counts(candidates(spark, sf_dir))


def _metrics(source: str, by: str) -> str:
    group, part, lead = (f"GROUP BY {by}", f"PARTITION BY {by}", f"{by}, ") if by else ("", "", "")
    rank = lambda c: f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {lead}{c}) - 1) / 2.0"
    corr = lambda a, b: f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
    return f"""k AS (SELECT *, {rank('y')} AS ry, {rank('y_hat')} AS rh FROM {source}), m AS (SELECT {lead}count(*) AS n, sqrt(avg((y - y_hat) ** 2)) AS rmse, avg(abs(y - y_hat)) AS mae, avg(sqrt(1 + (y - y_hat) ** 2) - 1) AS huber, 1 - avg((y - y_hat) ** 2) / var_pop(y) AS r2, {corr('y', 'y_hat')} AS pearson, {corr('ry', 'rh')} AS spearman FROM k {group})"""


SHOWN = "n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(huber, 6) AS huber, round(r2, 6) AS r2, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman"


def rounded(df):
    return df.select(*(r6(c).alias(c) if c in ("rmse", "mae", "huber", "r2", "pearson", "spearman", "micro", "macro", "lo", "hi") else c for c in df.columns))


@query("fold_metrics", f"{UNIQUE}, {_metrics('t', 'fold')} SELECT fold, {SHOWN} FROM m")
def fold_metrics(spark, sf_dir):
    return rounded(val.metrics(candidates(spark, sf_dir), ["fold"]))


@query("pooled_metrics", f"{UNIQUE}, {_metrics('u', '')} SELECT {SHOWN} FROM m")
def pooled_metrics(spark, sf_dir):
    return rounded(val.metrics(val.unique_edges(candidates(spark, sf_dir))))


@query("micro_macro", f"{UNIQUE}, {_metrics('t', 'fold')} SELECT 'rmse' AS metric, round(sqrt(sum(n * rmse * rmse) / sum(n)), 6) AS micro, round(avg(rmse), 6) AS macro FROM m UNION ALL SELECT 'mae', round(sum(n * mae) / sum(n), 6), round(avg(mae), 6) FROM m UNION ALL SELECT 'huber', round(sum(n * huber) / sum(n), 6), round(avg(huber), 6) FROM m")
def micro_macro(spark, sf_dir):
    per = val.metrics(candidates(spark, sf_dir), ["fold"])
    out = None
    for m in ("rmse", "mae", "huber"):
        one = rounded(val.micro_macro(per, m)).select(F.lit(m).alias("metric"), "micro", "macro")
        out = one if out is None else out.unionByName(one)
    return out


@query("fold_bootstrap", UNIQUE + f""", s AS (SELECT fold, count(*) AS n, sum((y - y_hat) ** 2) AS sq, sum(abs(y - y_hat)) AS ab, row_number() OVER (ORDER BY fold) - 1 AS i, count(*) OVER () AS nf FROM t GROUP BY fold),
    d AS (SELECT boot, CAST(('0x' || substr(md5('{SEED}_' || boot || '_' || i), 1, 15)) AS BIGINT) % nf AS j FROM s CROSS JOIN range({N}) b(boot)),
    m AS (SELECT boot, sqrt(sum(sq) / sum(n)) AS rmse, sum(ab) / sum(n) AS mae FROM d JOIN s ON s.i = d.j GROUP BY 1)
    SELECT 'rmse' AS metric, round(quantile_cont(rmse, 0.025), 6) AS lo, round(quantile_cont(rmse, 0.975), 6) AS hi FROM m UNION ALL SELECT 'mae', round(quantile_cont(mae, 0.025), 6), round(quantile_cont(mae, 0.975), 6) FROM m""")
def fold_bootstrap(spark, sf_dir):
    return rounded(val.fold_bootstrap(candidates(spark, sf_dir), N, SEED))


#: Runs of a region: its segments' mean balances.
RUNS = "runs AS (SELECT n_name AS region, c_mktsegment AS subset, round(avg(c_acctbal) + 1e-7, 2) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def runs(spark, sf_dir):
    nation = domain.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    own = domain.table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey")
    return own.groupBy("region", F.col("c_mktsegment").alias("subset")).agg(F.round(F.avg("c_acctbal") + 1e-7, 2).alias("value"))


WILCOXON = f"WITH {RUNS}, d AS (SELECT a.subset AS run_a, b.subset AS run_b, round(a.value - b.value, 12) AS d FROM runs a JOIN runs b ON a.region = b.region AND a.subset < b.subset), k AS (SELECT *, rank() OVER (PARTITION BY run_a, run_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY run_a, run_b, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)"


@query("wilcoxon_w", WILCOXON + " SELECT run_a, run_b, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus FROM k GROUP BY 1, 2")
def wilcoxon_w(spark, sf_dir):
    return val.signed_ranks(val.paired_runs(runs(spark, sf_dir)), ["run_a", "run_b"])


#: How many sets of the ranks 1 to k have each sum, by adding one rank at a time; differences here have no ties.
@query(
    "wilcoxon_p",
    WILCOXON.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, ways AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS s, CAST(1 AS HUGEINT) AS c UNION ALL SELECT k + 1, s + b * (k + 1), CAST(sum(c) AS HUGEINT) FROM ways CROSS JOIN (VALUES (0), (1)) v(b) WHERE k < 50 GROUP BY 1, 2),
    w AS (SELECT run_a, run_b, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus FROM k GROUP BY 1, 2)
    SELECT run_a, run_b, n, w_plus, w_minus, round(least(1.0, 2 * CAST((SELECT sum(c) FROM ways o WHERE o.k = w.n AND o.s <= least(w_plus, w_minus)) AS DOUBLE) / 2 ** n), 6) AS p FROM w""",
)
def wilcoxon_p(spark, sf_dir):
    return val.signed_rank_test(val.paired_runs(runs(spark, sf_dir)), ["run_a", "run_b"]).withColumn("p", r6("p"))


@query("relative_metric", f"WITH {RUNS} SELECT a.region, a.subset, round(a.value / b.value, 6) AS relative FROM runs a JOIN runs b ON a.region = b.region AND b.subset = 'BUILDING' WHERE a.subset <> 'BUILDING'")
def relative_metric(spark, sf_dir):
    return val.relative_to(runs(spark, sf_dir), "BUILDING").withColumn("relative", r6("relative"))


@query("pareto_front", "WITH t AS (SELECT s_suppkey AS trial, round(s_acctbal) AS micro, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS macro FROM supplier) SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.micro <= t.micro AND o.macro <= t.macro AND (o.micro < t.micro OR o.macro < t.macro))")
def pareto_front(spark, sf_dir):
    own = domain.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("trial"), F.round("s_acctbal").alias("micro"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("macro"))
    return val.pareto_front(own)


#: Gains: a fold is a nation, a feature a brand with a size class; the rule is the brand, the type the size class.
GAINS = """g AS (SELECT n_name AS fold, p_brand || '_' || (p_size % 5) AS feature, p_brand AS lr_name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'T' || (p_size % 5) END AS ct_l, CAST(sum(l_quantity) AS DOUBLE) AS gain FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
    w AS (SELECT n_name AS fold, n_nationkey + 1 AS edges FROM nation), rel AS (SELECT *, gain / sum(gain) OVER (PARTITION BY fold) AS rel FROM g)"""
AGG = f"WITH {GAINS}, a AS (SELECT feature, any_value(lr_name) AS lr_name, any_value(ct_l) AS ct_l, sum(edges * gain) / (SELECT sum(edges) FROM w) AS importance_abs, sum(edges * rel) / (SELECT sum(edges) FROM w) AS importance_rel FROM rel JOIN w USING (fold) GROUP BY 1)"


def gains(spark, sf_dir):
    """(fold, feature, gain, lr_name, ct_l), every feature in every fold."""
    t = lambda n: domain.table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = lines.join(t("part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.col("p_size") % 5
    return lines.groupBy(F.col("n_name").alias("fold"), F.concat_ws("_", "p_brand", kind).alias("feature"), F.col("p_brand").alias("lr_name"), F.when(kind != 0, F.concat(F.lit("T"), kind)).alias("ct_l")).agg(F.sum("l_quantity").alias("gain"))


def weights(spark, sf_dir):
    return domain.table(spark, sf_dir, "nation").select(F.col("n_name").alias("fold"), (F.col("n_nationkey") + 1).alias("edges"))


def complete_gains(spark, sf_dir):
    own = gains(spark, sf_dir)
    grid = own.select("feature", "lr_name", "ct_l").distinct().join(F.broadcast(weights(spark, sf_dir).select("fold")))
    return grid.join(own.select("fold", "feature", "gain"), ["fold", "feature"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))


def meta(spark, sf_dir):
    return gains(spark, sf_dir).select("feature", "lr_name", "ct_l").distinct()


def importances(spark, sf_dir):
    return imp.aggregated(complete_gains(spark, sf_dir).select("fold", "feature", "gain"), weights(spark, sf_dir))


@query("importance_rel", AGG + " SELECT feature, round(importance_abs, 6) AS importance_abs, round(importance_rel * 100, 6) AS importance_rel FROM a")
def importance_rel(spark, sf_dir):
    return importances(spark, sf_dir).select("feature", r6("importance_abs").alias("importance_abs"), r6(F.col("importance_rel") * 100).alias("importance_rel"))


def _group(key: str) -> str:
    return AGG + f" SELECT {key} AS group_name, round(sum(importance_abs), 5) AS importance_abs, round(sum(importance_rel) * 100, 5) AS importance_rel FROM a WHERE {key} IS NOT NULL GROUP BY 1"


def _grouped(spark, sf_dir, key):
    out = imp.grouped(importances(spark, sf_dir).join(F.broadcast(meta(spark, sf_dir)), "feature"), key)
    return out.select("group_name", F.round("importance_abs", 5).alias("importance_abs"), F.round(F.col("importance_rel") * 100, 5).alias("importance_rel"))


@query("importance_by_rule", _group("lr_name"))
def importance_by_rule(spark, sf_dir):
    return _grouped(spark, sf_dir, "lr_name")


@query("importance_by_type", _group("ct_l"))
def importance_by_type(spark, sf_dir):
    return _grouped(spark, sf_dir, "ct_l")


ALL = f"WITH {GAINS}, x AS (SELECT w.fold, m.feature, m.lr_name, m.ct_l, coalesce(rel, 0) AS rel FROM w CROSS JOIN (SELECT DISTINCT feature, lr_name, ct_l FROM g) m LEFT JOIN rel ON rel.fold = w.fold AND rel.feature = m.feature)"
CI = "round(avg(v) * 100, 6) AS mean, round(quantile_cont(v, 0.5) * 100, 6) AS median, round(quantile_cont(v, 0.025) * 100, 6) AS lo, round(quantile_cont(v, 0.975) * 100, 6) AS hi, round((quantile_cont(v, 0.975) - quantile_cont(v, 0.025)) * 100, 6) AS width"


def _interval(df):
    return df.select(*(r6(F.col(c) * 100).alias(c) if c in ("mean", "median", "lo", "hi", "width") else c for c in df.columns))


@query("feature_ci", ALL + f" SELECT feature, {CI.replace('(v', '(rel')} FROM x GROUP BY 1")
def feature_ci(spark, sf_dir):
    return _interval(imp.interval(imp.relative_gain(complete_gains(spark, sf_dir)), ["feature"], "rel"))


@query("group_ci", ALL + f", s AS (SELECT fold, ct_l AS group_name, sum(rel) AS v FROM x WHERE ct_l IS NOT NULL GROUP BY 1, 2) SELECT group_name, {CI} FROM s GROUP BY 1")
def group_ci(spark, sf_dir):
    own = complete_gains(spark, sf_dir)
    return _interval(imp.group_interval(own.select("fold", "feature", "gain"), meta(spark, sf_dir), "ct_l"))


_FOLD_SUMS = ", ".join(f"round(sum(CASE WHEN fold = 'NATION_{i}' THEN rel END) * 100, 6) AS NATION_{i}" for i in range(25))


@query("lr_fold_matrix", ALL + f" SELECT lr_name, {_FOLD_SUMS} FROM x GROUP BY 1")
def lr_fold_matrix(spark, sf_dir):
    names = sorted(r["region"] for r in regions(spark, sf_dir).collect())
    out = imp.fold_matrix(complete_gains(spark, sf_dir).select("fold", "feature", "gain"), meta(spark, sf_dir), names)
    return out.select("lr_name", *(r6(F.col(n) * 100).alias(n) for n in names))


#: Two importance tables: even and odd nations, with some rules in one only.
TWO = f"""{AGG}, h AS (SELECT lr_name, fold, sum(rel) AS v FROM rel GROUP BY 1, 2),
    sc AS (SELECT lr_name AS group_name, round(avg(v), 9) AS v FROM h JOIN nation ON n_name = fold WHERE n_nationkey % 2 = 0 AND lr_name <> 'Brand#11' GROUP BY 1), fc AS (SELECT lr_name AS group_name, round(avg(v), 9) AS v FROM h JOIN nation ON n_name = fold WHERE n_nationkey % 2 = 1 AND lr_name <> 'Brand#55' GROUP BY 1),
    j AS (SELECT coalesce(sc.group_name, fc.group_name) AS group_name, coalesce(sc.v, 0) AS a, coalesce(fc.v, 0) AS b FROM sc FULL JOIN fc ON sc.group_name = fc.group_name),
    cat AS (SELECT *, (a + 1e-10) / (b + 1e-10) AS ratio, CASE WHEN (a + 1e-10) / (b + 1e-10) > 1.2 THEN 'SC-biased' WHEN (a + 1e-10) / (b + 1e-10) < 1 / 1.2 THEN 'FC-biased' ELSE 'Balanced' END AS category FROM j)"""


def two_tables(spark, sf_dir):
    rel = imp.relative_gain(gains(spark, sf_dir)).groupBy("lr_name", "fold").agg(F.sum("rel").alias("v")).join(F.broadcast(domain.table(spark, sf_dir, "nation").select(F.col("n_name").alias("fold"), "n_nationkey")), "fold")
    side = lambda odd, out: rel.filter((F.col("n_nationkey") % 2 == odd) & (F.col("lr_name") != out)).groupBy(F.col("lr_name").alias("group_name")).agg(F.round(F.avg("v"), 9).alias("importance_rel"))
    return side(0, "Brand#11"), side(1, "Brand#55")


@query("categorize", TWO + " SELECT group_name, round(a * 100, 6) AS importance_sc, round(b * 100, 6) AS importance_fc, round(ln(ratio) / ln(2), 5) AS log2_ratio, category, CAST(floor(rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) AS INTEGER) AS rank_sc, CAST(floor(rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) AS INTEGER) AS rank_fc FROM cat")
def categorize(spark, sf_dir):
    out = imp.categorised(*two_tables(spark, sf_dir))
    return out.select("group_name", r6(F.col("importance_sc") * 100).alias("importance_sc"), r6(F.col("importance_fc") * 100).alias("importance_fc"), F.round("log2_ratio", 5).alias("log2_ratio"), "category", "rank_sc", "rank_fc")


@query("uniform_draw", f"WITH n AS (SELECT DISTINCT p_brand AS lr_name FROM part), d AS (SELECT CAST(draw AS INTEGER) AS draw, lr_name, row_number() OVER (PARTITION BY draw ORDER BY md5('{SEED}_' || draw || '_' || lr_name), lr_name) AS r FROM n CROSS JOIN range(6) t(draw)) SELECT draw, lr_name FROM d WHERE r <= 4")
def uniform_draw(spark, sf_dir):
    names = domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("lr_name")).distinct()
    return subset_draws(names, "lr_name", 4, 6, SEED)


@query("matched_draw", f"WITH n AS (SELECT p_brand AS lr_name, count(*) AS importance FROM part GROUP BY 1), d AS (SELECT draw, lr_name, importance, row_number() OVER (PARTITION BY draw ORDER BY md5('{SEED}_' || draw || '_' || lr_name), lr_name) AS r FROM n CROSS JOIN range(200) t(draw)), s AS (SELECT draw, sum(importance) AS total FROM d WHERE r <= 4 GROUP BY 1), k AS (SELECT draw FROM s WHERE abs(total - (SELECT 4 * avg(importance) FROM n)) / (SELECT 4 * avg(importance) FROM n) <= 0.1 ORDER BY draw LIMIT 5) SELECT CAST(draw AS INTEGER) AS draw, lr_name FROM d WHERE r <= 4 AND draw IN (SELECT draw FROM k)")
def matched_draw(spark, sf_dir):
    rules = domain.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("lr_name")).agg(F.count("*").alias("importance"))
    target = 4 * rules.agg(F.avg("importance").alias("m")).first()["m"]
    return imp.matched_draws(rules, 4, 5, SEED, target, 0.1, 200)


@query("feature_mask", AGG + " SELECT feature FROM a WHERE lr_name IN ('Brand#12', 'Brand#13')")
def feature_mask(spark, sf_dir):
    return imp.features_of(meta(spark, sf_dir), spark.createDataFrame([("Brand#12",), ("Brand#13",)], "lr_name string")).select("feature")


@query("bh_adjusted", "WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 7919 % 1000) / 1000.0 AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM p) SELECT id, round(CAST(p AS DOUBLE), 6) AS p, round(CAST(least(1, min(p * n / k) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS DOUBLE), 6) AS q FROM r")
def bh(spark, sf_dir):
    own = domain.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 7919 % 1000) / F.lit(1000.0)).cast("double").alias("p"))
    return bh_adjusted(own, "p", [], "q", ["id"]).select("id", r6("p").alias("p"), r6("q").alias("q"))


def _pct(spark, sf_dir):
    own = imp.relative_gain(complete_gains(spark, sf_dir)).filter("ct_l IS NOT NULL").groupBy("fold", F.col("ct_l").alias("group_name")).agg(F.round(F.sum("rel") * 100, 9).alias("pct"))
    half = F.regexp_extract("fold", r"(\d+)", 1).cast("int") % 2
    return own.filter(half == 0), own.filter(half == 1)


def _boots(source: str, seed: int, out: str) -> str:
    return f"""f{out} AS (SELECT fold, row_number() OVER (ORDER BY fold) - 1 AS i, count(*) OVER () AS nf FROM (SELECT DISTINCT fold FROM {source})),
        b{out} AS (SELECT boot, group_name, sum(pct) / any_value(d.nf) AS v FROM (SELECT boot, nf, CAST(('0x' || substr(md5('{seed}_' || boot || '_' || i), 1, 15)) AS BIGINT) % nf AS j FROM f{out} CROSS JOIN range({DIFFERENCES}) b(boot)) d JOIN f{out} ON f{out}.i = d.j JOIN {source} s ON s.fold = f{out}.fold GROUP BY 1, 2)"""


@query("diff_pct_ci", ALL + f""", pct AS (SELECT fold, ct_l AS group_name, round(sum(rel) * 100, 9) AS pct FROM x WHERE ct_l IS NOT NULL GROUP BY 1, 2),
    ev AS (SELECT * FROM pct WHERE CAST(regexp_extract(fold, '(\\d+)', 1) AS INTEGER) % 2 = 0), od AS (SELECT * FROM pct WHERE CAST(regexp_extract(fold, '(\\d+)', 1) AS INTEGER) % 2 = 1), {_boots('ev', SEED, 'a')}, {_boots('od', SEED + 1, 'b')},
    j AS (SELECT group_name, ba.v AS a, bb.v AS b FROM ba JOIN bb USING (boot, group_name)),
    k AS (SELECT group_name, quantile_cont(a - b, 0.025) AS lo, quantile_cont(a - b, 0.975) AS hi, greatest(1.0 / {DIFFERENCES}, least(1.0, 2 * least(avg(CASE WHEN a - b < -1e-12 THEN 1.0 ELSE 0 END), avg(CASE WHEN a - b > 1e-12 THEN 1.0 ELSE 0 END)))) AS p FROM j GROUP BY 1),
    l AS (SELECT *, row_number() OVER (ORDER BY p, group_name) AS r, count(*) OVER () AS n FROM k)
    SELECT group_name, round(lo, 6) AS diff_lo, round(hi, 6) AS diff_hi, round(CAST(p AS DOUBLE), 6) AS p, round(CAST(least(1, min(p * n / r) OVER (ORDER BY p, group_name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS DOUBLE), 6) AS fdr FROM l""")
def diff_pct_ci(spark, sf_dir):
    out = imp.difference_interval(*_pct(spark, sf_dir), DIFFERENCES, SEED)
    return out.select("group_name", *(r6(c).alias(c) for c in ("diff_lo", "diff_hi", "p", "fdr")))


EFFECTS = "v AS (SELECT c_mktsegment AS feature, c_acctbal AS value, CAST(c_custkey * 31 % 17 - 8 AS DOUBLE) * 0.5 + c_acctbal / 1000 AS effect FROM customer), m AS (SELECT feature, quantile_cont(value, 0.5) AS median FROM v GROUP BY 1)"


@query("directionality", f"WITH {EFFECTS}, s AS (SELECT feature, avg(abs(effect)) AS mean_abs, coalesce(covar_pop(value, effect) / nullif(stddev_pop(value) * stddev_pop(effect), 0), 0) AS r, avg(CASE WHEN value > median THEN CASE WHEN effect > 0 THEN 1.0 ELSE 0 END END) AS pw, avg(CASE WHEN value > median THEN effect END) AS hi, avg(CASE WHEN value <= median THEN effect END) AS lo FROM v JOIN m USING (feature) GROUP BY 1) SELECT feature, round(mean_abs, 6) AS mean_abs, round(r, 6) AS r, round(CAST(pw AS DOUBLE), 6) AS positive_when_high, round(hi, 6) AS mean_high, round(lo, 6) AS mean_low, CASE WHEN r > 0.1 THEN 'positive' WHEN r < -0.1 THEN 'negative' ELSE 'mixed' END AS direction FROM s")
def directionality(spark, sf_dir):
    own = domain.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("feature"), F.col("c_acctbal").alias("value"), ((F.col("c_custkey") * 31 % 17 - 8).cast("double") * 0.5 + F.col("c_acctbal") / 1000).alias("effect"))
    out = imp.directionality(own)
    return out.select("feature", *(r6(c).alias(c) for c in ("mean_abs", "r", "positive_when_high", "mean_high", "mean_low")), "direction")
