from datetime import date, datetime

from pyspark.sql import functions as F
from workfeed.sources import documents


def test_only_days_with_due_documents_are_read(spark, tmp_path):
    day = lambda n: date(2026, 1, 1 + n)
    rows = [(f"d{n}", day(n % 5), f"text {n}") for n in range(40)]
    texts = documents.with_text_version(spark.createDataFrame(rows, "doc_id string, landed_on date, text string"))
    documents.land_texts(texts, str(tmp_path / "t"))
    at = datetime(2026, 2, 1)
    memo = texts.where("doc_id <> 'd7'").select("doc_id", F.when(F.col("doc_id").isin("d12", "d2"), "old").otherwise(F.col("version")).alias("version"), F.when(F.col("doc_id") == "d2", F.lit(at)).otherwise(F.lit(datetime(2026, 1, 1))).alias("parsed_at"))
    metadata = texts.select("doc_id", "version", F.lit(3600).alias("interval_seconds"), "landed_on", F.lit("x").alias("course"))
    due = documents.due_documents(metadata, memo, F.lit(at).cast("timestamp"))
    for other in (tmp_path / "t" / "landed_on=2026-01-04").glob("*.parquet"):
        other.write_bytes(b"no such file is opened")
    got = documents.texts_of(due, str(tmp_path / "t"))
    # d2 has changed but was read within its interval.
    assert sorted((r.doc_id, r.text, r.course) for r in got.collect()) == [("d12", "text 12", "x"), ("d7", "text 7", "x")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2026-01-03" in plan and "2026-01-04" not in plan
    assert documents.texts_of(due.limit(0), str(tmp_path / "t")).count() == 0


def test_null_versions_and_unknown_documents_are_due(spark):
    metadata = spark.createDataFrame([("a", None, 0, None), ("b", "v", 0, None)], "doc_id string, version string, interval_seconds int, landed_on date")
    memo = spark.createDataFrame([("a", None, datetime(2026, 1, 1))], "doc_id string, version string, parsed_at timestamp")
    assert sorted(r.doc_id for r in documents.due_documents(metadata, memo, F.lit(datetime(2026, 2, 1)).cast("timestamp")).collect()) == ["a", "b"]
