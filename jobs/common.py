"""What the jobs share: configuration, session, log, and tables that are there from the first run on."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def told(job: str, event: str, **what: object) -> None:
    """One line of JSON in the log."""
    log.info(json.dumps({"job": job, "event": event, **what}, sort_keys=True, default=str))


def ensured(spark: SparkSession, path: str, schema: str, partition: str) -> DataFrame:
    """The table at path, partitioned by `partition`, as empty as it may be: made where there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(partition).parquet(path)
    return spark.read.schema(schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Write df; partitions that it has rows for are replaced, others stay. Doing it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def settings(path: str, given: dict) -> dict:
    """The JSON config file with what the command line gives in place of its values."""
    return {**json.loads(Path(path).read_text()), **{k: v for k, v in given.items() if v is not None}}


def main(name: str, run: Callable[[SparkSession, dict], object], options: dict[str, str]) -> None:
    """Command line: --config and the options (name: help), each of which replaces a value of the config file."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")))
    for option, about in options.items():
        parser.add_argument(f"--{option}", help=about)
    given = vars(parser.parse_args())
    config = settings(given.pop("config"), given)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()
