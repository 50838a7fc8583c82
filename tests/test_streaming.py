import time

from workfeed.keyed import KeyedTable
from workfeed.streaming import streams

ROW = "id string, hash string, n int"


def test_upsert_stream_equals_the_batch_and_a_rerun_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 5), f"h{i}", i) for i in range(23)], ROW)
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    table = KeyedTable(str(tmp_path / "table"), rows.schema, ("id",), "n", buckets=4)
    for _ in range(2):
        feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        streams.upsert_stream(feed, table, str(tmp_path / "cp")).awaitTermination()
        assert sorted(r.n for r in table.read(spark).collect()) == [18, 19, 20, 21, 22]
    assert table.manifests(spark) == [1, 2, 3]  # one for each micro-batch of the first run


def emitted(spark, tmp_path, changed):
    query = changed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()), query


def landed(spark, tmp_path, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_changed_only_across_runs(spark, tmp_path):
    out = []
    for rows in ([("a", "1", 1), ("b", "1", 2)], [("b", "2", 4), ("a", "1", 3), ("c", "1", 5)], [("d", "2", 9), ("d", "1", 8), ("a", "1", 6), ("d", "1", 7)]):
        out.append(emitted(spark, tmp_path, streams.changed_only(landed(spark, tmp_path, rows), "n"))[0])
    # Within a micro-batch the order column decides, not the order of arrival.
    assert out == [[1, 2], [1, 2, 4, 5], [1, 2, 4, 5, 7, 9]]


def test_a_stream_begins_with_the_last_snapshot(spark, tmp_path):
    known = spark.createDataFrame([("a", "1"), ("b", "1"), ("z", None)], "id string, hash string")
    feed = landed(spark, tmp_path, [("a", "1", 1), ("b", "2", 2), ("z", None, 3), ("new", None, 4)])
    assert emitted(spark, tmp_path, streams.changed_only(feed, "n", known=known))[0] == [2, 4]


def test_what_is_unseen_for_the_ttl_counts_as_new(spark, tmp_path):
    run = lambda rows, ttl: emitted(spark, tmp_path, streams.changed_only(landed(spark, tmp_path, rows), "n", ttl))[0]
    assert run([("a", "1", 1), ("b", "1", 2)], "4 seconds") == [1, 2]
    time.sleep(5)
    assert run([("a", "1", 3)], "4 seconds") == [1, 2, 3]


def test_replay_is_several_micro_batches_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("a", str(i // 10), i) for i in range(100)], ROW).repartition(7)
    got, query = emitted(spark, tmp_path, streams.changed_only(streams.replay(rows, str(tmp_path / "in"), "n"), "n"))
    assert got == [0, 10, 20, 30, 40, 50, 60, 70, 80, 90]
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4
    empty, _ = emitted(spark, tmp_path / "none", streams.changed_only(streams.replay(rows.limit(0), str(tmp_path / "e"), "n"), "n"))
    assert empty == []
