"""The network of types: degrees, page rank, hubs and their tests, shortest paths, communities. Everything is joins and
aggregations of edges and nodes, in rounds that are cut from those before them; no task holds a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resample import shuffled_labels
from ..functions.special import chi2_upper, fisher_two_sided
from ..functions.stats import hash_key
from ..sources.work import cut, stored


def type_network(features: DataFrame, percentile: float = 80.0) -> DataFrame:
    """(sender, receiver, weight): summed importance of the ordered types, edges at or above the 100 - percentile
    quantile of weights (so the heaviest `percentile` per cent stay). features: (ct_l, ct_r, importance)."""
    sums = features.groupBy(F.col("ct_l").alias("sender"), F.col("ct_r").alias("receiver")).agg(F.sum("importance").alias("weight"))
    limit = sums.agg(F.percentile("weight", (100 - percentile) / 100).alias("limit"))
    return sums.join(F.broadcast(limit)).filter("weight >= limit").drop("limit")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, in_strength, out_strength, total_strength)."""
    ends = edges.select(F.col("sender").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("ow"), F.lit(0.0).alias("iw"))
    ends = ends.unionByName(edges.select(F.col("receiver").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("ow"), F.col("weight").alias("iw")))
    out = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("iw").alias("in_strength"), F.sum("ow").alias("out_strength"))
    return out.withColumn("total_strength", F.col("in_strength") + F.col("out_strength"))


def compared_nodes(first: DataFrame, second: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(node, strength_sc, strength_fc, rank_sc, rank_fc, log2_strength, log2_rank) of two networks' nodes (node,
    total_strength, rank); a node that one of them lacks has zeros there."""
    side = lambda own, name: own.select("node", F.col("total_strength").alias(f"strength_{name}"), F.col("rank").alias(f"rank_{name}"))
    both = side(first, "sc").join(side(second, "fc"), "node", "full_outer").fillna(0.0, ["strength_sc", "strength_fc", "rank_sc", "rank_fc"])
    ratio = lambda c: F.log2((F.col(f"{c}_sc") + eps) / (F.col(f"{c}_fc") + eps))
    return both.select("node", "strength_sc", "strength_fc", "rank_sc", "rank_fc", ratio("strength").alias("log2_strength"), ratio("rank").alias("log2_rank"))


def page_rank(edges: DataFrame, tolerance: float = 1e-6, damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """(node, rank): weighted page rank, in rounds until the ranks' summed change falls below the number of nodes times
    tolerance; more than `rounds` raise. What dead ends hold is shared by all. A round is one join and one aggregation."""
    edges = stored(edges)
    nodes = stored(edges.select(F.col("sender").alias("node")).union(edges.select("receiver")).distinct())
    n = nodes.count()
    total = edges.groupBy("sender").agg(F.sum("weight").alias("total"))
    share = stored(edges.join(total, "sender").select("sender", "receiver", (F.col("weight") / F.col("total")).alias("share")))
    dead = stored(nodes.join(total.withColumnRenamed("sender", "node"), "node", "left_anti"))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for _ in range(rounds if n else 0):
        moved = share.join(rank.withColumnRenamed("node", "sender"), "sender").groupBy(F.col("receiver").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        loose = rank.join(dead, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        new = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        step = stored(rank.join(moved, "node", "left").join(F.broadcast(loose)).select("node", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        rank = step.select("node", "rank")
        if step.agg(F.sum("change")).first()[0] < n * tolerance:
            break
    else:
        if n:
            raise RuntimeError(f"page rank did not settle in {rounds} rounds")
    return rank


def hubs(metrics: DataFrame, percentile: float = 80.0) -> DataFrame:
    """Nodes at or above the percentile of total strength or of rank, with which of the two."""
    limits = metrics.agg(F.percentile("total_strength", percentile / 100).alias("ls"), F.percentile("rank", percentile / 100).alias("lr"))
    out = metrics.join(F.broadcast(limits)).withColumns({"strength_hub": F.col("total_strength") >= F.col("ls"), "rank_hub": F.col("rank") >= F.col("lr")})
    return out.filter("strength_hub OR rank_hub").drop("ls", "lr")


def hub_class_test(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """(cell_class, observed, null_mean, null_sd, p): share of hubs in each class against n shuffles of the classes; p is
    two-sided about the null's mean, one added above and below. nodes: (node, cell_class, is_hub)."""
    nodes = cut(nodes)
    flags = nodes.select("node", F.col("is_hub").cast("int").alias("hub"))
    total = flags.agg(F.sum("hub").alias("hubs"))
    classes = nodes.select("cell_class").distinct()
    per = lambda df, by: df.groupBy(*by, "cell_class").agg(F.sum("hub").alias("k"))
    share = F.when(F.col("hubs") > 0, F.coalesce("k", F.lit(0)) / F.col("hubs")).otherwise(0.0)
    seen = classes.join(per(nodes.select("cell_class", F.col("is_hub").cast("int").alias("hub")), []), "cell_class", "left").join(F.broadcast(total)).select("cell_class", share.alias("observed"))
    drawn = shuffled_labels(nodes, "node", "cell_class", n, seed).join(F.broadcast(flags), "node")
    grid = drawn.select("perm").distinct().join(F.broadcast(classes))
    null = grid.join(per(drawn, ["perm"]), ["perm", "cell_class"], "left").join(F.broadcast(total)).select("perm", "cell_class", share.alias("x"))
    null = null.join(F.broadcast(seen), "cell_class").withColumn("mean", F.avg("x").over(Window.partitionBy("cell_class")))
    far = F.abs(F.col("x") - F.col("mean")) >= F.abs(F.col("observed") - F.col("mean")) - 1e-12
    return null.groupBy("cell_class", "observed").agg(F.avg("x").alias("null_mean"), F.stddev_pop("x").alias("null_sd"), ((F.sum(far.cast("long")) + 1) / (F.lit(n) + 1.0)).alias("p"))


def contingency(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """(column, a, b, expected_a, expected_b): counts in two sets of hubs and what equal shares would give."""
    counts = first.groupBy(column).agg(F.count("*").alias("a")).join(second.groupBy(column).agg(F.count("*").alias("b")), column, "full_outer").fillna(0, ["a", "b"])
    everything = Window.partitionBy()
    both, all_a, all_b = F.col("a") + F.col("b"), F.sum("a").over(everything), F.sum("b").over(everything)
    return counts.withColumns({"expected_a": both * all_a / (all_a + all_b), "expected_b": both * all_b / (all_a + all_b)})


def contingency_test(table: DataFrame) -> dict[str, float | None]:
    """chi2, its degrees of freedom and p, and Fisher's exact p where there are two classes; on the driver, from one row a
    class."""
    rows = [(r["a"], r["b"], r["expected_a"], r["expected_b"]) for r in table.select("a", "b", "expected_a", "expected_b").collect()]
    df = len(rows) - 1
    yates = 0.5 if df == 1 else 0.0
    chi2 = sum((max(0.0, abs(o - e) - min(yates, abs(o - e)))) ** 2 / e for a, b, ea, eb in rows for o, e in ((a, ea), (b, eb)) if e)
    fisher = fisher_two_sided(rows[0][0], rows[1][0], rows[0][1], rows[1][1]) if len(rows) == 2 else None
    return {"chi2": chi2, "dof": df, "p": chi2_upper(chi2, df) if df > 0 else 1.0, "p_fisher": fisher}


def _lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, node, d): the length of the shortest way from each source to each node that it reaches, itself included. A
    round lets the ways that got shorter in the last one go on by an edge each."""
    near = stored(nodes.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("d")))
    new = near
    while not new.isEmpty():
        on = new.join(edges, F.col("node") == F.col("sender")).groupBy("source", F.col("receiver").alias("node")).agg(F.min(F.col("d") + F.col("weight")).alias("to"))
        both = stored(near.join(on, ["source", "node"], "full_outer").withColumn("shorter", F.col("to").isNotNull() & (F.col("d").isNull() | (F.col("to") < F.col("d") * (1 - 1e-12)))))
        near = both.select("source", "node", F.when(F.col("shorter"), F.col("to")).otherwise(F.col("d")).alias("d"))
        new = both.filter("shorter").select("source", "node", F.col("to").alias("d"))
    return near


def _spread(start: DataFrame, links: DataFrame, at: str, to: str, value: str) -> DataFrame:
    """(source, node, value): start and all that links (source, at, to, share) hand on of it, round by round, until nothing
    moves; the links of a source have no circles."""
    out, moving = start, stored(start)
    while True:
        handed = moving.withColumnRenamed("node", at).join(links, ["source", at]).select("source", F.col(to).alias("node"), (F.col(value) * F.col("share")).alias(value))
        moving = stored(handed.groupBy("source", "node").agg(F.sum(value).alias(value)))
        if moving.isEmpty():
            return stored(out.groupBy("source", "node").agg(F.sum(value).alias(value)))
        out = out.unionByName(moving)


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness): share of the shortest ways between others that lead through a node, normalised by (n - 1)(n - 2).
    Edge weights are lengths and must be above zero; ways whose lengths differ by under 1e-12 of them are equally short.

    All sources advance together: lengths by rounds of relaxation, numbers of ways by handing them along the edges that
    lie on shortest ways, dependencies by handing them back. State is a row for each source and node that it reaches."""
    edges = stored(edges.groupBy("sender", "receiver").agg(F.min("weight").cast("double").alias("weight")))
    if not edges.filter("weight <= 0 OR weight IS NULL").isEmpty():
        raise ValueError("lengths must be above zero")
    nodes = stored(edges.select(F.col("sender").alias("node")).union(edges.select("receiver")).distinct())
    n = nodes.count()
    near = _lengths(edges, nodes)
    far = near.select("source", F.col("node").alias("receiver"), F.col("d").alias("far"))
    ways = near.join(edges, F.col("node") == F.col("sender")).join(far, ["source", "receiver"]).filter("d + weight <= far * (1 + 1e-12)")
    links = stored(ways.select("source", "sender", "receiver", F.lit(1.0).alias("share")))
    count = _spread(nodes.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("k")), links, "sender", "receiver", "k")
    ends = [count.select("source", F.col("node").alias(c), F.col("k").alias(f"k_{c}")) for c in ("sender", "receiver")]
    shares = stored(links.drop("share").join(ends[0], ["source", "sender"]).join(ends[1], ["source", "receiver"]).select("source", "sender", "receiver", (F.col("k_sender") / F.col("k_receiver")).alias("share")))
    first = stored(shares.groupBy("source", F.col("sender").alias("node")).agg(F.sum("share").alias("owed")))
    owed = _spread(first, shares, "receiver", "sender", "owed").filter("source <> node").groupBy("node").agg(F.sum("owed").alias("owed"))
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(owed, "node", "left").select("node", (F.coalesce("owed", F.lit(0.0)) * scale).alias("betweenness"))


def global_measures(edges: DataFrame) -> DataFrame:
    """(nodes, edges, density): one row."""
    n = edges.select("sender").union(edges.select("receiver")).distinct().agg(F.count("*").alias("nodes"))
    return n.join(F.broadcast(edges.agg(F.count("*").alias("edges")))).withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def clustering(edges: DataFrame) -> DataFrame:
    """(clustering): mean over nodes of the weighted clustering coefficient of the undirected graph, by joining edges into
    triangles: cube roots of products of weights over the greatest, per pair of neighbours."""
    pairs = edges.filter("sender <> receiver").select(F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    most = pairs.agg(F.max("weight").alias("most"))
    und = pairs.join(F.broadcast(most)).select("a", "b", (F.col("weight") / F.col("most")).alias("w"))
    both = und.unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    one = both.select(F.col("a").alias("v"), F.col("b").alias("x"), F.col("w").alias("w1"))
    two = both.select(F.col("a").alias("v"), F.col("b").alias("y"), F.col("w").alias("w2"))
    tri = one.join(two, "v").filter("x < y").join(und.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("w").alias("w3")), ["x", "y"]).groupBy("v").agg(F.sum(F.cbrt(F.col("w1") * F.col("w2") * F.col("w3"))).alias("t"))
    deg = both.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("k"))
    alone = edges.select(F.col("sender").alias("v")).union(edges.select("receiver")).distinct()
    c = alone.join(deg, "v", "left").join(tri, "v", "left").select(F.when(F.col("k") > 1, 2 * F.coalesce("t", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("c"))
    return c.agg(F.avg("c").alias("clustering"))


def modularity(edges: DataFrame, found: DataFrame) -> float:
    """Of communities (node, community) of the undirected graph that edges (sender, receiver, weight) make."""
    both = edges.select(F.col("sender").alias("u"), F.col("receiver").alias("v"), "weight").union(edges.select("receiver", "sender", "weight"))
    return _modularity(both.groupBy("u", "v").agg(F.sum("weight").alias("w")), found.select("node", F.col("community").alias("com")))


def _modularity(both: DataFrame, own: DataFrame) -> float:
    ends = both.join(own.select(F.col("node").alias("u"), F.col("com").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("com").alias("b")), "v")
    per = ends.groupBy(F.col("a").alias("com")).agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = per.agg(F.sum("tot").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("tot") * F.col("tot")).alias("squares")).first()
    return r["inside"] / r["all"] - r["squares"] / r["all"] ** 2 if r["all"] else 0.0


def _moves(both: DataFrame, own: DataFrame, degree: DataFrame, total: float) -> DataFrame:
    """(node, com, to, gain): the nodes that another community beside them suits better, the best one and by how much; the
    lesser name of equals."""
    held = own.join(degree, "node").groupBy("com").agg(F.sum("k").alias("tot"))
    beside = both.filter("u <> v").join(own.select(F.col("node").alias("v"), "com"), "v").select(F.col("u").alias("node"), "com", "w")
    tied = beside.unionByName(own.select("node", "com", F.lit(0.0).alias("w"))).groupBy("node", "com").agg(F.sum("w").alias("w"))
    rows = tied.join(held, "com").join(own.select("node", F.col("com").alias("cur")), "node").join(degree, "node")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("com") == F.col("cur"), F.col("k")).otherwise(0.0)) / total
    best = rows.withColumn("g", F.round(gain, 12)).groupBy("node", F.col("cur").alias("com")).agg(F.min(F.struct((-F.col("g")).alias("loss"), F.col("com").alias("to"))).alias("b"), F.max(F.when(F.col("com") == F.col("cur"), F.col("g"))).alias("stay"))
    return best.select("node", "com", F.col("b.to").alias("to"), (-F.col("b.loss") - F.col("stay")).alias("gain")).filter("gain > 1e-11")


def _apart(moves: DataFrame) -> DataFrame:
    """The moves that are the best of all that touch either of their two communities: none of them changes another's gain."""
    rank = F.struct(F.col("gain"), F.col("node"))
    best = moves.select(F.explode(F.array("com", "to")).alias("c"), rank.alias("rank")).groupBy("c").agg(F.max("rank").alias("most"))
    one, two = (best.select(F.col("c").alias(c), F.col("most").alias(f"most_{c}")) for c in ("com", "to"))
    return moves.join(one, "com").join(two, "to").filter((F.col("most_com.node") == F.col("node")) & (F.col("most_to.node") == F.col("node"))).select(*moves.columns)


def communities(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(node, community): multilevel modularity communities of the undirected graph, each named by its least node.

    A level starts with every node by itself. In a round all nodes find the neighbouring community that suits them best; a
    half of those who would move, dealt by hash, move at once. If that doesn't raise the modularity, only moves that
    can't disturb each other are made, which always raises it. When nobody would move, each community becomes one node,
    its inner edges a loop, and the next level starts; a level without a move is the last."""
    both = edges.select(F.col("sender").alias("u"), F.col("receiver").alias("v"), F.col("weight").cast("double").alias("w")).union(edges.select("receiver", "sender", F.col("weight").cast("double")))
    both = stored(both.groupBy("u", "v").agg(F.sum("w").alias("w")))
    total = both.agg(F.sum("w")).first()[0] or 1.0
    found = stored(both.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node")))
    while True:
        degree = stored(both.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")))
        own = stored(degree.select("node", F.col("node").alias("com")))
        quality, turn = _modularity(both, own), 0
        while not (moves := stored(_moves(both, own, degree, total))).isEmpty():
            half = moves.filter(F.substring(hash_key(seed, turn, "node"), 1, 1) < "8")
            for chosen in (half, _apart(moves)):
                tried = stored(own.join(chosen.select("node", "to"), "node", "left").select("node", F.coalesce("to", "com").alias("com")))
                better = _modularity(both, tried)
                if better > quality + 1e-12:
                    break
            else:  # what is left to gain is below what sums of weights can tell
                break
            own, quality, turn = tried, better, turn + 1
        if not turn:
            return found.select("node", F.min("node").over(Window.partitionBy("community")).alias("community"))
        found = stored(found.join(own.select(F.col("node").alias("community"), "com"), "community").select("node", F.col("com").alias("community")))
        a, b = (own.select(F.col("node").alias(c), F.col("com").alias(f"com_{c}")) for c in ("u", "v"))
        both = stored(both.join(a, "u").join(b, "v").groupBy(F.col("com_u").alias("u"), F.col("com_v").alias("v")).agg(F.sum("w").alias("w")))
