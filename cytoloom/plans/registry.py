"""Queries by name, each with the SQL that must give the same rows (None where SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


#: Views that oracle statements start from.
CELLS = "cells AS (SELECT c_custkey AS cell_id, r_name AS region, c_mktsegment AS cell_type, r_name || '::' || c_mktsegment AS node, n_name AS subject, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
EXPR = "expr AS (SELECT o_custkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
