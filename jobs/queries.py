"""The jobs as queries: each runs twice over the whole tables into one new folder and returns what is there after the second
run, beside the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.functions.stats import r6
from cytoloom.plans.subjects import BY_SUBJECT, rounded
from cytoloom.sources.work import shared_folder

from . import subject_networks, text_profiles


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_subject_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "job1")
    for _ in range(2):
        subject_networks.run(spark, {"tables": sf_dir, "output": output})
    return rounded(subject_networks.networks(spark, output))


def job2_text_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "job2")
    for _ in range(2):
        text_profiles.run(spark, {"documents": f"{sf_dir}/documents.parquet", "output": f"{base}/out", "checkpoint": f"{base}/checkpoint"})
    return text_profiles.result(spark, f"{base}/out").withColumns({"mean": r6("mean"), "entropy": r6(F.col("entropy") + 1e-10)})


QUERIES = {"job1_subject_networks": job1_subject_networks, "job2_text_profiles": job2_text_profiles}

ORACLE_SQL = {
    "job1_subject_networks": BY_SUBJECT,
    "job2_text_profiles": rf"""
        WITH d AS (SELECT row_number() OVER () AS cell_id, coalesce(source, 'unknown') AS region, coalesce(lang, 'unknown') AS cell_type,
                          list_filter(string_split_regex(translate(text, '{text_profiles.UPPER}', '{text_profiles.LOWER}'), '[ \t-\r]+'), lambda w: w <> '') AS words FROM documents),
        k AS (SELECT cell_id, region, cell_type, len(words) AS n, unnest(words) AS gene FROM d),
        c AS (SELECT cell_id, region, cell_type, gene, ln(1 + count(*) / any_value(n) * 10000.0) AS value FROM k GROUP BY 1, 2, 3, 4),
        s AS (SELECT region, cell_type, count(*) AS cells FROM d GROUP BY 1, 2),
        m AS (SELECT region, cell_type, gene, any_value(cells) AS cells, count(*) AS detected, sum(value) / any_value(cells) AS mean FROM c JOIN s USING (region, cell_type) GROUP BY 1, 2, 3),
        p AS (SELECT *, mean / sum(mean) OVER (PARTITION BY region, gene) AS p FROM m)
        SELECT region, cell_type, gene, cells, detected, round(mean, 6) AS mean, round(-sum(p * log2(p)) OVER (PARTITION BY region, gene) + 1e-10, 6) AS entropy FROM p""",
}
