"""Intermediate and versioned results on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where there is none, a temporary one on a single machine, and an error on a cluster, whose executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="workfeed-")


def new_folder(spark: SparkSession, stem: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names; one is set only where there is none."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder; for wide tables, of which a checkpoint's files would be several times as large."""
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop has them."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions of a table kept under root, oldest first."""
    fs, path = hadoop_path(spark, root)
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in found if p.getName().startswith("v=") and fs.exists(hadoop_path(spark, f"{p}/_SUCCESS")[1])]
    return sorted(int(p.getName()[2:]) for p in done)


def read_latest(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The latest complete version; without one an empty table of the schema."""
    have = versions(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/v={have[-1]}") if have else spark.createDataFrame([], schema)


def write_next(df: DataFrame, root: str, keep: int = 3) -> int:
    """Writes a new version beside the others, so that what is being read is never overwritten; readers see it once complete. The last `keep` versions stay."""
    spark = df.sparkSession
    n = (versions(spark, root) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{root}/v={n}")
    for old in versions(spark, root)[:-keep]:
        fs, path = hadoop_path(spark, f"{root}/v={old}")
        fs.delete(path, True)
    return n


def read_map(spark: SparkSession, path: str, row: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a state kept as JSON objects from a key to a row: the key and the fields of row, its DDL.

    A file that is missing, cut off or no such object gives no rows, as if the state
    were empty, and one row of errors (file, error); other files are read. Of a key that several files
    have each row is there.
    """
    errors = "file STRING, error STRING"
    shape = f"m MAP<STRING, STRUCT<{row}>>, _corrupt STRING"
    try:
        files = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    except AnalysisException:
        none = spark.createDataFrame([], f"{key} STRING, {row}")
        return none, spark.createDataFrame([(path, "missing")], errors)
    told = F.from_json(F.concat(F.lit('{"m": '), "value", F.lit("}")), shape, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = files.select("file", told.alias("p"))
    broken = F.col("p").isNull() | F.col("p._corrupt").isNotNull() | F.col("p.m").isNull()
    rows = parsed.where(~broken).select(F.explode("p.m").alias(key, "_row")).select(key, "_row.*")
    return rows, parsed.where(broken).select("file", F.lit("malformed").alias("error"))
