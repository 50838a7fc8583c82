import json

import pytest
from pyspark.sql import functions as F
from workfeed.schema import WORK_ITEM
from workfeed.sources import fetch

ROW = "id STRING, title STRING, points DOUBLE"


def landed(path, **pages):
    path.mkdir()
    for name, text in pages.items():
        (path / f"{name}.json").write_text(text)
    return str(path)


def test_a_broken_page_takes_nothing_from_the_others(spark, tmp_path):
    whole = json.dumps([{"id": "a", "title": "A"}, {"id": "b", "points": 2}])
    path = landed(tmp_path / "in", one=whole, two='[{"id": "c", "title"', three="<html>", four="[]", five=json.dumps([{"id": "d", "points": "x"}, {"id": "e"}]))
    rows, errors = fetch.landed_pages(spark, path, ROW)
    assert sorted((r.id, r.ordinal) for r in rows.collect()) == [("a", 0), ("b", 1)]
    assert sorted(r.file.rsplit("/", 1)[1] for r in errors.collect()) == ["five.json", "three.json", "two.json"]
    under, _ = fetch.landed_pages(spark, landed(tmp_path / "under", one='{"items": [{"id": "z"}], "next": 1}'), ROW, "items")
    assert [r.id for r in under.collect()] == ["z"]


def test_rows_are_aligned_by_name(spark):
    rows = spark.range(2).select(
        F.col("id").cast("int").alias("course_id"), F.lit("t").alias("title"), F.lit(1).alias("other"), F.lit("done").alias("state"), F.lit(True).alias("late"),
        F.when(F.col("id") == 1, F.array(F.struct(F.lit("u").alias("url"), F.lit("n").alias("name")))).alias("attachments"),
    )
    got = fetch.aligned(fetch.with_progress(rows))
    assert got.schema.simpleString() == WORK_ITEM.simpleString()
    none, one = sorted(got.collect(), key=lambda r: r.course_id)
    assert (none.course_id, none.title, none.attachments, none.enrichment) == ("0", "t", None, None)
    assert (one.attachments[0].name, one.attachments[0].content, one.progress.state, one.progress.late, one.progress.grade) == ("n", None, "done", True, None)


def test_a_feed_that_fails_contributes_nothing(spark, tmp_path):
    good = lambda: (spark.createDataFrame([("x", "t")], "id string, title string"), None)
    missing = lambda: fetch.landed_pages(spark, str(tmp_path / "none"), ROW)

    def broken():
        raise ValueError("no token")

    feeds = [fetch.Feed("canvas", good), fetch.Feed("gcal", missing), fetch.Feed("gdoc", broken)]
    items, errors = fetch.gathered(spark, feeds)
    assert [(r.id, r.source) for r in items.collect()] == [("x", "canvas")]
    assert sorted((r.source, r.error) for r in errors.collect()) == [("gcal", "AnalysisException"), ("gdoc", "ValueError")]
    assert fetch.gathered(spark, feeds, ("canvas",))[1].count() == 0
    with pytest.raises(RuntimeError):
        fetch.gathered(spark, feeds, ("gcal", "gdoc"))
    with pytest.raises(ValueError):
        fetch.gathered(spark, feeds, ("classroom",))
