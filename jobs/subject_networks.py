"""Interaction networks subject by subject, incrementally.

Cohorts grow: new subjects' cells arrive while earlier subjects' networks are in use. The job reads the star schema as cells
and expression, takes the subjects that have cells enough and no finished run under these settings, infers and tests their
networks in one plan, and writes them under `<output>/networks`, a partition a subject. `<output>/finished` is its mark: a
row for each finished subject, with its cells, its groups and a digest of the settings. The networks are written first, the
mark last, both by replacing whole partitions: a run that broke off is done again by the next with the same result, and
a finished subject is never computed twice. Subjects whose cells grew since are left alone, as finished, unless `refresh`
is set. Other settings or rules count as not run, and their results replace the earlier ones.

A subject's result depends on its own cells, the rules and the genes of the part table, so neither the order of runs nor
the company a subject runs in matters.

    python -m jobs.subject_networks --tables DIR --output DIR [--config FILE]"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.operators import infer
from cytoloom.sources import domain
from cytoloom.sources.readers import read_rules
from cytoloom.sources.work import cut

from .common import ensured, main, replace_partitions, told

NETWORKS = "lr_name string, sender string, receiver string, prob double, pvalue double, net double, subject string"
FINISHED = "cells long, groups long, settings string, subject string"
DEFAULTS = {"rules": None, "permutations": 100, "fdr": 0.05, "seed": 42, "min_cells": 10, "min_groups": 2, "refresh": False}


def networks(spark: SparkSession, output: str) -> DataFrame:
    """What the job has written so far."""
    return spark.read.schema(NETWORKS).parquet(f"{output}/networks").select("subject", "lr_name", "sender", "receiver", "prob", "pvalue", "net")


def _digest(rules: DataFrame, config: dict) -> str:
    """The settings that results depend on; rules are at most some thousands."""
    rows = sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in rules.collect())
    return hashlib.sha256(json.dumps([config["permutations"], config["fdr"], config["seed"], rows]).encode()).hexdigest()


def run(spark: SparkSession, config: dict) -> int:
    """Bring the output up to date; the number of subjects done in this run."""
    config = {**DEFAULTS, **config}
    tables, output = config["tables"].rstrip("/"), config["output"].rstrip("/")
    cells = domain.cells(spark, tables).select("subject", "cell_id", "node")
    rules = read_rules(spark, config["rules"]).drop("lr_index") if config["rules"] else domain.rule_table(spark)
    settings = _digest(rules, config)
    finished = ensured(spark, f"{output}/finished", FINISHED, "subject").filter(F.col("settings") == settings)
    ensured(spark, f"{output}/networks", NETWORKS, "subject")
    if config["refresh"]:
        sizes = infer.subjects_to_run(cells, finished.limit(0), 0, 0)
        finished = finished.join(sizes.select("subject", F.col("cells").alias("now")), "subject").filter("cells = now").drop("now")
    due = cut(infer.subjects_to_run(cells, finished, config["min_cells"], config["min_groups"]))
    n, n_cells = due.agg(F.count("*"), F.coalesce(F.sum("cells"), F.lit(0))).first()
    told("subject_networks", "read", tables=tables, subjects_due=n, cells_due=n_cells, settings=settings)
    if n:
        panel = domain.table(spark, tables, "part").select(F.col("p_brand").alias("gene")).distinct()
        own = cells.join(due.select("subject"), "subject", "left_semi")
        found = infer.run_by_subject(domain.expression(spark, tables), own, rules, panel, m=config["permutations"], fdr=config["fdr"], seed=config["seed"])
        # by subject and rule: a subject with many nodes is several tasks' work
        replace_partitions(found.select(*(c.split()[0] for c in NETWORKS.split(", "))).repartition("subject", "lr_name"), f"{output}/networks", "subject")
        replace_partitions(due.select("cells", "groups", F.lit(settings).alias("settings"), "subject").coalesce(1), f"{output}/finished", "subject")
    written = networks(spark, output).join(due.select("subject"), "subject", "left_semi").count() if n else 0
    told("subject_networks", "written", output=output, subjects=n, edges=written)
    return n


if __name__ == "__main__":
    main("subject_networks", run, {"tables": "folder of the parquet tables", "output": "folder of the result and the mark", "rules": "a JSON file of rules"})
