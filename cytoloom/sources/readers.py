"""Sources and sinks: rule databases, text tables with a preamble, labels, ids in file names, configuration, upserts."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .domain import RULE_SCHEMA

_RULE_JSON = "lig_contributor array<string>, receptor_subunit array<string>, lig_contributor_group array<int>, lig_contributor_coeff array<double>, receptor_subunit_group array<int>, receptor_subunit_coeff array<double>, interaction_type string, ligand_type string"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a JSON object of rules by name, with lr_index from 0 in name order."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string, struct<{_RULE_JSON}>>")).alias("lr_name", "r")).select("lr_name", "r.*")
    return rows.withColumn("lr_index", F.row_number().over(Window.orderBy("lr_name")) - 1)


def rules_to_json(rules: DataFrame) -> str:
    """A rule table (at most some thousands of rules) as one JSON object."""
    return json.dumps({r["lr_name"]: {k: v for k, v in r.asDict(recursive=True).items() if k not in ("lr_name", "lr_index")} for r in rules.collect()}, sort_keys=True)


def read_after_preamble(spark: SparkSession, path: str, schema: str, lines: int) -> DataFrame:
    """A CSV file whose first `lines` lines (the header last among them) are no data. Line numbers come from the file's own
    text, so the file is read whole by one task; such result files are small."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).filter((F.col("at") >= lines) & (F.col("line") != ""))
    return text.select(F.from_csv("line", schema).alias("r")).select("r.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label, name) from lines of a number and a name; a line that is neither empty nor such raises."""
    parts = F.regexp_extract_all("value", F.lit(r"^\s*(\d+)\s+(\S.*?)\s*$"), F.lit(0))
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumn("fine", F.size(parts) == 1)
    name = F.regexp_extract("value", r"^\s*(\d+)\s+(\S.*?)\s*$", 2)
    return rows.select(F.when(F.col("fine"), F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), "value")).cast("int")).alias("label"), name.alias("name"))


def with_file_id(df: DataFrame, pattern: str, column: str = "subject") -> DataFrame:
    """df read from files, with the id that the pattern's group finds in each file's path."""
    return df.withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(src, tgt, v) from a square CSV with names in its first row and column."""
    wide = spark.read.csv(path, header=True)
    first = wide.columns[0]
    return wide.unpivot([first], [c for c in wide.columns if c != first], "tgt", "v").select(F.col(first).alias("src"), "tgt", F.col("v").cast("double").alias("v"))


def safe_name(column: str):
    """Runs of what isn't a word character, a dot or a hyphen become one underscore."""
    return F.regexp_replace(column, r"[^\w.\-]+", "_")


def stable_hash(column: str):
    """A long that is the same everywhere, from the first 15 hexadecimal digits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.col(column), 256), 1, 15), 16, 10).cast("long")


def index_list(spec: str) -> list[int]:
    """'0,1', '0..9' or '0-9', ends included."""
    out: list[int] = []
    for part in filter(None, map(str.strip, spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:\.\.|-)(\d+)", part)
        out += range(int(m[1]), int(m[2]) + 1) if m else [int(part)]
    return out


def expand(value: Any, env: dict[str, str]) -> Any:
    """${NAME} in every text of a nested configuration replaced; a missing name raises."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env[m[1]], value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    return [expand(v, env) for v in value] if isinstance(value, list) else value


def load_config(path: str, env: dict[str, str] | None = None) -> dict:
    """A YAML configuration with its variables filled in."""
    import yaml

    return expand(yaml.safe_load(Path(path).read_text()), {**os.environ, **(env or {})})


def missing_keys(df: DataFrame, required: DataFrame, key: str) -> DataFrame:
    return required.select(key).join(df.select(key), key, "left_anti")


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows that new replaces, and new: re-running a step leaves no second copy."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


__all__ = ["RULE_SCHEMA", "expand", "first_by_key", "index_list", "load_config", "missing_keys", "read_after_preamble", "read_labels", "read_matrix", "read_rules", "rules_to_json", "safe_name", "stable_hash", "upsert", "with_file_id"]
