"""Registered queries read whole texts and bounded groups."""

from pyspark.sql import functions as F
from workfeed.functions import text
from workfeed.plans import queries
from workfeed.sources import ics


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_strip_images_gets_whole_texts_with_data(spark, tmp_path, monkeypatch):
    given, real = [], text.strip_image_data
    monkeypatch.setattr(text, "strip_image_data", lambda c: given.append(c) or real(c))
    body = "word " * 100
    path = documents(spark, tmp_path, [(1, body), (2, body), (3, ""), (4, "short")])
    got = {r.doc_id: r.stripped for r in queries.strip_images(spark, path).collect()}
    want = {1: body, 2: f"{body}\n![x]((image)) end\nlast", 3: "", 4: "short\n![x]((image)) end\nlast"}
    frame = spark.createDataFrame(list(want.items()), "doc_id long, text string")
    assert got == {r.doc_id: r.d for r in frame.select("doc_id", F.md5("text").alias("d")).collect()}
    for r in spark.read.parquet(f"{path}/documents.parquet").select("text", given[0].alias("given")).collect():
        assert r.text in r.given and ";base64," in r.given


def test_plain_text_reads_all_rows_to_the_default_limit(spark, tmp_path):
    path = documents(spark, tmp_path, [(i, f"x{i} " * 5000) for i in range(3)])
    rows = queries.plain_text(spark, path).collect()
    assert len(rows) == 3 and all(r.format == "text" and r.error is None and not r.truncated for r in rows)


def test_ics_files_of_a_hot_feed_are_bounded(spark, monkeypatch):
    sizes, real = [], ics.events
    monkeypatch.setattr(queries, "FILE_EVENTS", 20)
    monkeypatch.setattr(ics, "events", lambda feeds: sizes.append(feeds.select(F.size(F.split("body", "BEGIN:VEVENT")).alias("n"))) or real(feeds))
    rows = spark.range(1000).select(F.lit("hot").alias("feed"), F.col("id").alias("ordinal"), F.lit("s").alias("summary"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("start_at"), F.expr("TIMESTAMP_NTZ '2024-01-01 01:00:00'").alias("end_at"))
    monkeypatch.setattr(queries.b, "bound", lambda *_: rows)
    assert sorted(r.uid for r in queries.ics_events(spark, "").collect()) == list(range(1000))
    assert max(r.n for r in sizes[0].collect()) < 60
