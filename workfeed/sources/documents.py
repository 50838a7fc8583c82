"""Texts of documents, landed by the day they were fetched, of which only those that must be read again are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.memo import reread_due, text_version


def land_texts(docs: DataFrame, path: str) -> None:
    """Adds documents (doc_id, landed_on, text) to the folder of their day."""
    docs.select("doc_id", "landed_on", "text").write.mode("append").partitionBy("landed_on").parquet(path)


def due_documents(metadata: DataFrame, memo: DataFrame, now: Column) -> DataFrame:
    """metadata (doc_id, version, interval_seconds, landed_on) without the documents that need no reading.

    memo (doc_id, version, parsed_at) is what earlier runs have read. A document
    is due unless its version stands, or it was read within its interval.
    """
    known = memo.select("doc_id", F.col("version").alias("_version"), "parsed_at")
    joined = metadata.join(known, "doc_id", "left")
    return joined.where(reread_due(F.col("version"), F.col("_version"), F.col("parsed_at"), F.col("interval_seconds"), now)).select(metadata.columns)


def texts_of(due: DataFrame, path: str) -> DataFrame:
    """due documents (doc_id, landed_on, ...) with the text of their day; a document whose text is missing goes.

    The days of due documents are found first, as few as the folders, so that the files of
    all other days are left alone however large they are; of a folder's row groups those
    that hold none of the ids are passed over where the ids are few.
    """
    spark: SparkSession = due.sparkSession
    days = [r[0] for r in due.select("landed_on").distinct().collect()]
    # The schema is given, so that no file is opened for it.
    shape = T.StructType([due.schema["doc_id"], T.StructField("text", T.StringType()), due.schema["landed_on"]])
    texts = spark.read.schema(shape).parquet(path).where(F.col("landed_on").isin(days) if days else F.lit(False))
    return due.join(texts, ["doc_id", "landed_on"])


def with_text_version(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) whose version is that of their text, for sources that tell none of their own."""
    return docs.withColumn("version", text_version(F.col("text")))
