"""Exports: what is shuffled for them, and how they are written."""

from pyspark.sql import functions as F
from workfeed.operators import sinks
from workfeed.plans import queries


def test_texts_of_files_are_made_after_the_shuffles(spark):
    plan = queries._with_attachments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, x in enumerate(plan.splitlines()) if "Join LeftOuter, (ordinal" in x)
    assert "files.example" in "\n".join(plan.splitlines()[:join]) and "files.example" not in "\n".join(plan.splitlines()[join:])


def test_an_export_is_packed_and_made_of_rows_in_order(spark, tmp_path):
    rows = [(f"i{n}", (7 * n) % 50) for n in range(50)]
    items = spark.createDataFrame(rows, "id string, day int").select("id", F.date_add(F.lit("2026-01-01").cast("date"), F.col("day")).alias("due_at"), F.lit("c").alias("course"), F.lit("t").alias("title"))
    empty = F.lit(None).cast("array<struct<name:string>>").alias("attachments")
    sinks.write_json(items.repartition(3), str(tmp_path / "out"), lambda rows: rows.select("id", F.concat("id", F.lit("!")).alias("made"), empty), "gzip")
    files = sorted((tmp_path / "out").glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    back = [r for f in files for r in spark.read.json(str(f)).collect()]
    assert [r.id for r in back] == [i for i, _ in sorted(rows, key=lambda r: r[1])] and all(r.made == r.id + "!" and r.attachments == [] for r in back)
