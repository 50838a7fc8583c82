"""The named queries over the driver's tables and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import landed, landed_oracle, runs, runs_oracle
from .oracle import ORACLES
from .queries import QUERIES, dedup_survivors


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: work items without the rows that repeat an earlier one."""
    return dedup_survivors(spark, sf_dir)


def queries() -> dict:
    return QUERIES | landed.QUERIES | runs.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | landed_oracle.ORACLES | runs_oracle.ORACLES
