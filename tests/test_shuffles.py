"""Shuffles counted by blocks against shuffles as rows, and plans that keep to what they need."""

import random

import pytest
from pyspark.sql import functions as F

from cytoloom.functions import stats as S
from cytoloom.operators import infer, shuffles


def cells_and_values(spark, continuous):
    draw = random.Random(5)
    labels = [(f"s{i % 2}", i, f"n{draw.randrange(4)}") for i in range(700)] + [("s2", 900, "n1")]
    values = [(c, g, draw.random() if continuous else float(draw.randrange(4))) for _, c, _ in labels for g in ("a", "b", "c") if draw.random() < 0.6]
    values.append((900, "rare", 2.0))
    return spark.createDataFrame(values, "cell_id long, gene string, value double"), spark.createDataFrame(labels, "subject string, cell_id long, node string")


@pytest.mark.parametrize("by", [[], ["subject"]])
@pytest.mark.parametrize("how, continuous, senders, receivers", [("triquartile", False, None, None), ("triquartile", True, ["n0", "n1"], ["n1", "n2"]), ("mean", True, None, ["n1", "n3"])])
def test_blocks_count_what_rows_give(spark, monkeypatch, by, how, continuous, senders, receivers):
    monkeypatch.setattr(shuffles, "BLOCK", 40)  # several blocks and buckets
    expr, labels = cells_and_values(spark, continuous)
    labels = labels.select(*by, "cell_id", "node")
    rows = infer.permuted_labels(labels, 7, 3, senders, receivers, by)
    keys = [*by, "perm", "node"]
    want = {tuple(r)[:-1]: r.value for r in infer.group_expression(expr, rows, how, [*by, "perm"]).select(*keys, "gene", "value").collect()}
    sizes = {tuple(r) for r in rows.groupBy(*keys).count().collect()}
    got = shuffles.shuffled_expression(expr, labels, 7, infer._trades(3, senders, receivers), how, by)
    found = {tuple(r)[:-1]: r.value for r in got.filter("gene IS NOT NULL").select(*keys, "gene", "value").collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert {tuple(r) for r in got.filter("gene IS NULL").select(*keys, F.col("value").cast("long")).collect()} == sizes


def test_p_values_make_no_row_of_a_cell_and_a_shuffle(spark, monkeypatch):
    expr, labels = cells_and_values(spark, False)
    rules = spark.createDataFrame([("r", ["a"], [1], [1.0], ["b"], [1], [1.0])], "lr_name string, lig_contributor array<string>, lig_contributor_group array<int>, lig_contributor_coeff array<double>, receptor_subunit array<string>, receptor_subunit_group array<int>, receptor_subunit_coeff array<double>")
    labels = labels.select("cell_id", "node")
    seen = infer.observed_network(infer.side_scores(infer.group_expression(expr, labels, "mean"), rules))
    monkeypatch.setattr(infer, "shuffled_labels", lambda *a: pytest.fail("labels as rows"))
    p = infer.permutation_pvalues(expr, labels, rules, seen, 9, 1, "mean")
    assert p.filter("pvalue BETWEEN 0 AND 1").count() == 16


def test_adjusted_p_over_ranges(spark):
    """Ranges of rows give what one ordered list gives, groups without a name, ties and missing p included; no frame is
    taken anew for each row."""
    draw = random.Random(8)
    data = [(draw.choice(["x", "y", None]), i, draw.choice([None, 0.0, 0.5, 1.0, draw.random(), draw.random() ** 4])) for i in range(900)]
    got = S.bh_adjusted(spark.createDataFrame(data, "g string, i long, p double"), "p", ["g"], "q", ["i"])
    want = {}
    for g in ("x", "y", None):
        rows = sorted((p, i) for h, i, p in data if h == g and p is not None)
        least = 1.0
        for rank in range(len(rows), 0, -1):
            p, i = rows[rank - 1]
            least = min(least, p * len(rows) / rank)
            want[i] = least
    found = {r.i: r.q for r in got.collect()}
    assert len(found) == 900 and all(found[i] is None if i not in want else abs(found[i] - want[i]) < 1e-12 for i in found)
    assert "currentrow$(), unboundedfollowing$()" not in got._jdf.queryExecution().optimizedPlan().toString()
