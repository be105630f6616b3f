"""Queries over spatial nulls: surrogate maps, and alignment against features rebuilt from surrogates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import association as assoc
from ..operators import spatial
from ..operators import surrogates as sur
from ..sources import domain
from ..sources.work import cut, shared_folder
from .networks import SPACE, centres
from .registry import query
from .subjects import _corr, _partial

SURROGATES, SEED = 100, 3
DISTANCES = "ds AS (SELECT a.area AS src, b.area AS tgt, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 9) AS d FROM centre a CROSS JOIN centre b)"


def _surrogates() -> str:
    """Clauses from ds (src, tgt, d) and mv (map, side, region, v) to su (map, side, s, region, v), resampled."""
    share = lambda at: f"(CAST(('0x' || substr(h, {at}, 15)) AS BIGINT) % 1000000000 + 0.5) / 1e9"
    portions = ", ".join(f"({p})" for p in sur.PORTIONS)
    return f"""rg AS (SELECT DISTINCT src AS region FROM ds), plain AS (SELECT region, row_number() OVER (ORDER BY region) AS r FROM rg),
    mf AS MATERIALIZED (SELECT m.map, m.side, rg.region, coalesce(v, m.mean) AS v FROM (SELECT map, side, avg(v) AS mean FROM mv GROUP BY 1, 2) m CROSS JOIN rg LEFT JOIN mv ON mv.map = m.map AND mv.side = m.side AND mv.region = rg.region),
    pr AS (SELECT src AS i, tgt AS j, d FROM ds WHERE src < tgt), pz AS (SELECT * FROM pr WHERE d < (SELECT quantile_cont(d, 0.25) FROM pr)),
    lg AS (SELECT l, lo + (hi - lo) * l / 24.0 AS c, 3 * (hi - lo) / 24.0 AS b FROM (SELECT min(d) AS lo, max(d) AS hi FROM pz) CROSS JOIN range(25) t(l)),
    lw AS MATERIALIZED (SELECT l, i, j, w / sum(w) OVER (PARTITION BY l) AS w FROM (SELECT l, i, j, exp(0 - ((2.68 * (d - c)) ** 2) / (2 * b * b)) AS w FROM pz CROSS JOIN lg)),
    nn AS (SELECT src, tgt, d, row_number() OVER (PARTITION BY src ORDER BY d, tgt) AS r FROM ds WHERE src <> tgt),
    nk AS (SELECT q, src, tgt, exp(-d / greatest(max(d) OVER (PARTITION BY q, src), 1e-12)) AS w FROM nn CROSS JOIN (VALUES {portions}) p(q) WHERE r <= greatest(1, q * (SELECT count(*) FROM rg) // 100)),
    kw AS MATERIALIZED (SELECT q, src, tgt, w / sum(w) OVER (PARTITION BY q, src) AS w FROM nk),
    hx AS (SELECT map, s, region, md5('{SEED}_' || s || '_' || map || '_' || region) AS k, md5('{SEED}_' || s || '_' || map || '_' || region || '_noise') AS h FROM (SELECT DISTINCT map FROM mv) CROSS JOIN rg CROSS JOIN range({SURROGATES}) t(s)),
    dr AS MATERIALIZED (SELECT map, s, region, row_number() OVER (PARTITION BY map, s ORDER BY k, region) AS r, sqrt(-2 * ln({share(1)})) * cos(2 * pi() * {share(16)}) AS z FROM hx),
    mo AS (SELECT mf.map, side, s, dr.region, v FROM dr JOIN plain USING (r) JOIN mf ON mf.map = dr.map AND mf.region = plain.region),
    sm AS MATERIALIZED (SELECT map, side, s, q, src AS region, sum(w * v) AS v FROM mo JOIN kw ON tgt = region GROUP BY ALL),
    hv AS (SELECT a.map, a.side, a.s, a.q, a.region AS i, b.region AS j, 0.5 * (a.v - b.v) ** 2 AS h FROM sm a JOIN pz ON pz.i = a.region JOIN sm b ON b.map = a.map AND b.side = a.side AND b.s = a.s AND b.q = a.q AND b.region = pz.j),
    gv AS (SELECT map, side, s, q, l, sum(w * h) AS g FROM hv JOIN lw USING (i, j) GROUP BY ALL),
    go AS MATERIALIZED (SELECT a.map, a.side, l, sum(w * 0.5 * (a.v - b.v) ** 2) AS goal FROM lw JOIN mf a ON a.region = i JOIN mf b ON b.region = j AND b.map = a.map AND b.side = a.side GROUP BY ALL),
    fi AS (SELECT map, side, s, q, CASE WHEN regr_sxx(goal, g) > 1e-300 THEN regr_slope(goal, g) ELSE 0 END AS slope, avg(goal) AS mg, avg(g) AS m, regr_syy(goal, g) AS syy, regr_sxx(goal, g) AS sxx FROM gv JOIN go USING (map, side, l) GROUP BY ALL),
    be AS (SELECT map, side, s, q, slope, mg - slope * m AS base FROM fi QUALIFY row_number() OVER (PARTITION BY map, side, s ORDER BY syy - slope * slope * sxx, q) = 1),
    ma AS (SELECT map, side, s, region, row_number() OVER (PARTITION BY map, side, s ORDER BY sqrt(abs(slope)) * sm.v + sqrt(abs(base)) * z, region) AS r FROM be JOIN sm USING (map, side, s, q) JOIN dr USING (map, s, region)),
    so AS (SELECT map, side, v, row_number() OVER (PARTITION BY map, side ORDER BY v) AS r FROM mf),
    su AS MATERIALIZED (SELECT ma.map, ma.side, ma.s, ma.region, so.v FROM ma JOIN so USING (map, side, r))"""


def region_distances(spark, sf_dir):
    return cut(spatial.distances(centres(spark, sf_dir), "area").withColumn("d", F.round("d", 9)))


@query("variogram_surrogates", f"{SPACE}, {DISTANCES}, mv AS (SELECT c_mktsegment AS map, '' AS side, n_name AS region, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 3), {_surrogates()} SELECT map, CAST(s AS INTEGER) AS s, region, round(v, 6) AS v FROM su")
def variogram_surrogates(spark, sf_dir):
    maps = domain.table(spark, sf_dir, "customer").join(F.broadcast(domain.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("map"), F.col("n_name").alias("region")).agg(F.avg("c_acctbal").alias("v"))
    return sur.surrogate_maps(maps, region_distances(spark, sf_dir), SURROGATES, SEED, resample=True).withColumn("v", r6("v"))


#: A feature is a brand, an edge the quantity that goes from a nation's suppliers to another's customers.
FLOWS = """li AS (SELECT p_brand AS feature, sn.n_name AS src, cn.n_name AS tgt, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey WHERE sn.n_nationkey <> cn.n_nationkey),
    fl AS MATERIALIZED (SELECT b.feature, a.n_name AS src, c.n_name AS tgt, coalesce(x, 0) AS x FROM (SELECT DISTINCT p_brand AS feature FROM part) b CROSS JOIN nation a CROSS JOIN nation c LEFT JOIN (SELECT feature, src, tgt, sum(l_quantity) AS x FROM li GROUP BY ALL) f ON f.feature = b.feature AND f.src = a.n_name AND f.tgt = c.n_name WHERE a.n_name <> c.n_name),
    mv AS (SELECT feature AS map, 'source' AS side, src AS region, round(avg(ln(greatest(x, 0.001))), 9) AS v FROM fl GROUP BY 1, 3 UNION ALL SELECT feature, 'target', tgt, round(avg(ln(greatest(x, 0.001))), 9) FROM fl GROUP BY 1, 3),
    ba AS (SELECT feature, round(avg(ln(greatest(x, 0.001))), 9) AS b FROM fl GROUP BY 1),
    yc AS (SELECT src, tgt, y, d AS c FROM (SELECT src, tgt, round(avg(l_extendedprice), 4) AS y FROM li GROUP BY 1, 2) JOIN ds USING (src, tgt))"""


def _null_alignment() -> str:
    rank = lambda v, out: f"rank() OVER (PARTITION BY s, feature ORDER BY {v}) + (count(*) OVER (PARTITION BY s, feature, {v}) - 1) / 2.0 AS {out}"
    return f"""{SPACE}, {DISTANCES}, {FLOWS}, {_surrogates()},
    al AS (SELECT -1 AS s, feature, src, tgt, x FROM fl UNION ALL SELECT a.s, a.map, a.region, b.region, round(exp(a.v + b.v - ba.b), 9) FROM su a JOIN su b ON a.side = 'source' AND b.side = 'target' AND a.map = b.map AND a.s = b.s AND a.region <> b.region JOIN ba ON ba.feature = a.map),
    a2 AS (SELECT s, feature, x, y, c FROM al JOIN yc USING (src, tgt)), k AS (SELECT s, feature, {rank('x', 'rx')}, {rank('y', 'ry')}, {rank('c', 'rc')} FROM a2),
    r AS (SELECT s, feature, {_corr('rx', 'ry')} AS xy, {_corr('rx', 'rc')} AS xc, {_corr('ry', 'rc')} AS yc FROM k GROUP BY 1, 2),
    v AS (SELECT s, avg(abs({_partial('xy', 'xc', 'yc')})) AS v, count(*) AS features FROM r GROUP BY 1),
    t AS (SELECT (SELECT v FROM v WHERE s = -1) AS real, (SELECT features FROM v WHERE s = -1) AS features, (sum(CASE WHEN v >= (SELECT v FROM v WHERE s = -1) THEN 1 ELSE 0 END) + 1) / (count(*) + 1.0) AS p, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS median, count(*) AS surrogates FROM v WHERE s >= 0)
    SELECT round(real, 6) AS real, features, round(CAST(p AS DOUBLE), 6) AS p, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round((real - mean) / sd, 4) AS z, surrogates FROM t"""


def flows(spark, sf_dir):
    """(rows, edges, y): quantities by brand and edge, zeros included; the edges; price and distance of each edge."""
    t = lambda name: domain.table(spark, sf_dir, name)
    nation = t("nation").select("n_nationkey", "n_name")
    named = lambda table, key, id, out: table.join(nation, F.col(key) == F.col("n_nationkey")).select(id, F.col("n_name").alias(out))
    buyers = t("orders").join(named(t("customer"), "c_nationkey", "c_custkey", "tgt_region"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "tgt_region")
    sellers, brands = named(t("supplier"), "s_nationkey", "s_suppkey", "src_region"), t("part").select("p_partkey", F.col("p_brand").alias("feature"))
    lines = t("lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).filter("src_region <> tgt_region")
    sums = cut(lines.groupBy("feature", "src_region", "tgt_region").agg(F.sum("l_quantity").alias("value"), F.sum("l_extendedprice").alias("price"), F.count("*").alias("n")))
    names = nation.select("n_name")
    edges = names.select(F.col("n_name").alias("src_region")).join(names.select(F.col("n_name").alias("tgt_region")), F.col("src_region") != F.col("tgt_region")).withColumn("edge_idx", F.concat_ws(">", "src_region", "tgt_region"))
    rows = cut(brands.select("feature").distinct().crossJoin(edges).join(sums.drop("price", "n"), ["feature", "src_region", "tgt_region"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))))
    prices = sums.groupBy("src_region", "tgt_region").agg(F.round(F.sum("price") / F.sum("n"), 4).alias("y"))
    far = region_distances(spark, sf_dir).select(F.col("src").alias("src_region"), F.col("tgt").alias("tgt_region"), F.col("d").alias("c"))
    return rows, edges, prices.join(far, ["src_region", "tgt_region"]).select(F.concat_ws(">", "src_region", "tgt_region").alias("edge_idx"), "y", "c")


@query("feature_null_alignment", _null_alignment())
def feature_null_alignment(spark, sf_dir):
    rows, edges, y = flows(spark, sf_dir)
    marginals = cut(spatial.log_marginals(rows, edges.select(F.col("src_region").alias("region"))).withColumn("v", F.round("v", 9)))
    maps = marginals.filter("side <> 'all'").withColumnRenamed("feature", "map")
    sets = sur.surrogate_sets(maps, region_distances(spark, sf_dir), SURROGATES, f"{shared_folder(spark)}/nulls-{uuid.uuid4().hex}", SEED, resample=True)
    made = sur.null_features(sets, marginals, edges).select("s", "feature", "edge_idx", F.round("value", 9).alias("x"))
    out = assoc.null_alignment(rows.select("feature", "edge_idx", F.col("value").alias("x")), made, y, "edge_idx", ["c"])
    return out.select(*(r6(c).alias(c) for c in ("real", "p", "mean", "sd", "median")), "features", F.round("z", 4).alias("z"), "surrogates")
