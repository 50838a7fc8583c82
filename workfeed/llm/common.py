"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..state import checkpoint

__all__ = ["checkpoint", "free_name", "partitions", "sha256_of", "small_batches", "small_broadcasts", "table"]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands texts to Python workers in batches of at most `rows`, where the session has more or no bound.

    A batch is in memory several times over, as Arrow, as pandas and as results; texts
    are long, so the default of 10,000 rows takes hundreds of megabytes in each worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def small_broadcasts(spark: SparkSession, most: int = 256 << 10) -> None:
    """Lets Spark broadcast by itself only what it takes to be of at most `most` bytes, where the session allows more.

    It counts neither the rows that an explode makes nor the length of an array, so a table
    may be a hundred times as large as it is taken to be, and a broadcast is whole in the driver.
    """
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        allowed = str(spark.conf.get(name, None) or "-1").strip()
        if not allowed.startswith("-") and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(allowed) > most:
            spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name starting with stem that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def partitions(rows: int, each: int = 50_000) -> int:
    """In how many partitions a table of that many rows of a few numbers each is kept, `each` in one, whatever number the session's shuffles have; for coalesce()."""
    return -(-rows // each) or 1


def sha256_of(column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes; of the empty text for null."""
    return F.sha2(F.coalesce(column.cast("string"), F.lit("")), 256)
