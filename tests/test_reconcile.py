from datetime import datetime

from pyspark.sql import functions as F
from workfeed.operators import memo, reconcile, render, sinks
from workfeed.state import read_latest, write_next

AT = datetime(2026, 9, 22, 17)
ITEM = "external_id string, title string, description string, notes string, state string, due_at timestamp, url string, homework boolean, content_hash string"
LISTING = "id long, external_id string, title string, description string, notes string, state string, due_at timestamp, url string, parent_id long"
STATE = "external_id string, note_id long, created_at string, last_pushed_state string, hash string"


def item(i, title="T", state="open", homework=None):
    return (f"s:{i}", title, "d", f"n\nx-id: s:{i}", state, AT, "u", homework, f"h{i}")


def row(i, ext, title="T", notes=None, state="open", due=AT, parent=None):
    return (i, ext, title, "d", notes or f"n\nx-id: s:{i}", state, due, "u", parent)


def test_actions_fields_and_a_second_run_without_any(spark):
    items = spark.createDataFrame([item(1), item(2, "New"), item(3, state="done"), item(4), item(5), item(6, homework=False), item(7, state="done"), item(8), item(9)], ITEM)
    listing = spark.createDataFrame([
        row(1, "s:1"), row(2, "s:2", due=None, parent=9), row(3, "s:3", state="dropped"), row(5, "", notes="edited\nx-id: s:5"), row(80, "", notes="none"), row(9, "s:9", state="done"),
    ], LISTING)
    state = spark.createDataFrame([("s:1", 1, "", "open", ""), ("s:4", 4, "", "open", ""), ("s:8", 80, "", "open", "")], STATE)
    actions = reconcile.task_actions(items, listing, state)
    got = {r.external_id: (r.action, r.fields, r.migrated) for r in actions.collect()}
    assert got == {
        "s:1": ("unchanged", "", False), "s:2": ("update", "title", False), "s:3": ("unchanged", "", False), "s:4": ("declined", "", False), "s:5": ("update", "notes,external_id", True),
        "s:6": ("skip_other", "", False), "s:7": ("skip_done", "", False), "s:8": ("update", "notes,external_id", True), "s:9": ("unchanged", "", False),
    }
    kept = {r.external_id for r in reconcile.next_state(state, actions, F.lit("now")).collect()}
    assert kept == {"s:1", "s:2", "s:3", "s:4", "s:5", "s:8", "s:9"}
    dry = reconcile.next_state(state, actions, F.lit("now"), dry_run=True)
    assert sorted(map(tuple, dry.collect())) == sorted(map(tuple, state.collect()))
    # Dates as text in other zones are the same instants; a description of another writer's is not compared.
    told = listing.withColumn("due_at", F.when(F.col("id") == 1, F.lit("2026-09-23T02:00:00+09:00")).otherwise(F.date_format("due_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).withColumn("description", F.lit("theirs"))
    other = {r.external_id: r.fields for r in reconcile.task_actions(items, told, state, owns_description=False).collect()}
    assert (other["s:1"], other["s:5"]) == ("", "notes,external_id")
    same = spark.createDataFrame([row(i, f"s:{i}") for i in range(3)], LISTING)
    again = reconcile.task_actions(spark.createDataFrame([item(i) for i in range(3)], ITEM), same, state.limit(0))
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_calendar_actions(spark):
    entries = spark.createDataFrame([(f"e{i}", "2026-01-01", f"0{i}:00", "h", i != 6) for i in range(7)], "external_id string, on_date string, start_time string, entry_hash string, valid boolean")
    state = spark.createDataFrame([("e0", "h", False), ("e1", "old", False), ("e2", "h", True), ("e3", "h", False), ("x1", "h", False), ("x2", "h", False), ("x3", "h", True)], "external_id string, hash string, declined boolean")
    there = spark.createDataFrame([("e0",), ("e1",), ("x1",)], "external_id string")
    got = {r.external_id: r.action for r in reconcile.calendar_actions(entries, state, there, 2).collect()}
    assert got == {"e0": "unchanged", "e1": "write", "e2": "declined", "e3": "declined", "e4": "write", "e5": "deferred", "x1": "withdraw", "x2": "forget"}
    # Without a listing, what is remembered counts as there.
    blind = {r.external_id: r.action for r in reconcile.calendar_actions(entries, state, None, 2).collect()}
    assert blind == {"e0": "unchanged", "e1": "write", "e2": "declined", "e3": "unchanged", "e4": "write", "e5": "deferred", "x1": "withdraw", "x2": "withdraw"}


def test_pressing_refusals_and_known_tasks(spark):
    now = F.lit(AT).cast("timestamp")
    rows = spark.createDataFrame([(1, "open", datetime(2026, 9, 20)), (2, "in_progress", datetime(2026, 9, 24, 16)), (3, "open", datetime(2026, 9, 24, 17)), (4, "done", AT), (5, "open", None)], "id int, state string, due_at timestamp")
    assert {r.id: r.pressing for r in reconcile.pressing(rows, now).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    calls = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(5)], "g string, n int")
    got = {(r.g, r.n): r.attempted for r in reconcile.stop_after_refusal(calls, (F.col("n") == 2) & ~F.col("g").eqNullSafe(F.lit("b")), ["g"], [F.col("n")]).collect()}
    assert got == {(g, n): g == "b" or n <= 2 for g in ("a", "b", None) for n in range(5)}
    items = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    listing, state = spark.createDataFrame([("x",), ("",)], "external_id string"), spark.createDataFrame([("y",)], "external_id string")
    assert {r.id: r.is_task for r in reconcile.is_task(items, listing, state).collect()} == {"x": True, "y": True, "z": False}


def test_spans_are_clamped_to_the_day(spark):
    rows = [("gcal:1", "gcal", " Late ", datetime(2026, 1, 1, 23, 30), datetime(2026, 1, 2, 1)), ("gcal:2", "gcal", "", datetime(2026, 1, 1, 9), None), ("gcal:3", "gcal", "All day", datetime(2026, 1, 1, 23, 59), None)]
    got = {r.external_id: (r.title, r.start_time, r.end_time, r.valid) for r in reconcile.calendar_entries(spark.createDataFrame(rows, "id string, source string, title string, due_at timestamp, ends_at timestamp")).collect()}
    assert got == {"gcal:1": ("Late", "23:30", "23:59", True), "gcal:2": ("Event", "09:00", "10:00", True), "gcal:3": ("All day", "23:59", "23:59", False)}


def test_tree_goes_flat_and_back(spark):
    flat = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (4, "d", None)], "id long, title string, parent_id long")
    tree = reconcile.rebuilt(flat, ["id", "title"])
    assert sorted(map(tuple, reconcile.flattened(tree).collect()), key=str) == sorted(map(tuple, flat.collect()), key=str)


def test_memo_hits_touches_and_prunes(spark):
    now = datetime(2026, 6, 1)
    table = spark.createDataFrame([("a", "1", "A", None, datetime(2026, 5, 1)), ("b", "", "B", None, datetime(2026, 5, 20)), ("c", "1", "C", None, datetime(2026, 1, 1))], "key string, version string, content string, content_error string, seen_at timestamp")
    wanted = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", ""), ("z", "1")], "key string, version string")
    assert [(r.key, r.version, r.hit) for r in memo.split(wanted, table).orderBy("key", "version").collect()] == [("a", "1", True), ("a", "2", False), ("b", "", False), ("z", "1", False)]
    fresh = spark.createDataFrame([("z", "1", "Z", None, now)], table.schema)
    left = memo.touched(table, wanted, fresh, F.lit(now), "'30' DAY")
    assert sorted((r.key, r.seen_at) for r in left.collect()) == [("a", now), ("b", now), ("z", now)]


def test_versions_are_never_overwritten(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "n int")
    assert read_latest(spark, root, df.schema).count() == 0
    assert (write_next(df, root), write_next(read_latest(spark, root, df.schema).union(df), root)) == (1, 2)
    assert read_latest(spark, root, df.schema).count() == 2


def test_rendering_and_export(spark, tmp_path):
    kind = "id string, source string, kind string, course string, title string, url string, assigned_at timestamp, due_at timestamp, points double, state string, submitted_at timestamp, grade string, late boolean, description string, attachments array<struct<name string, url string, content string>>".replace(" string,", " string,")
    schema = kind.replace("struct<name string, url string, content string>", "struct<name: string, url: string, content: string>")
    rows = [("s:1", "canvas", "quiz", "Bio", " Two\nlines ", "http://u", None, AT, 2.5, "graded", AT, "8/10", True, " Do it. ", [("a.pdf", "http://f", " body "), ("", "http://g", None)]), ("s:2", "gdoc", "material", "", "", None, None, None, None, "missing", None, None, False, None, [])]
    items = spark.createDataFrame(rows, schema)
    got = {r.external_id: r for r in render.rendered(items).collect()}
    assert got["s:1"].title == "Bio — Two lines" and got["s:2"].title == "(untitled)"
    assert got["s:1"].description == "Due: Tue Sep 22 17:00\nCourse: Bio\nKind: quiz · 2.5 pts\nLink: http://u\n\nDo it.\n\nAttachments:\n- a.pdf (http://f)\n- http://g"
    assert got["s:1"].notes == "Progress: graded, grade 8/10, submitted Tue Sep 22 17:00, late\n\n--- Handout: a.pdf ---\nbody\nx-id: s:1"
    assert got["s:2"].description == "Due: none\nKind: material" and got["s:2"].notes == "Progress: missing\nx-id: s:2"
    assert (got["s:1"].state, got["s:2"].state) == ("done", "open")
    sinks.write_csv(items, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\"").csv(str(tmp_path / "csv")).collect()
    assert {r.id: (r.due_at, r.attachment_count, r.attachment_names) for r in back} == {"s:1": ("2026-09-22T17:00:00Z", "2", "a.pdf, http://g"), "s:2": (None, "0", None)}
    columns = "id source kind course title url assigned_at due_at points state grade submitted_at late attachment_count attachment_names description"
    assert sinks.flat(items).columns == columns.split()
    other = {r.external_id: r for r in render.rendered(items, owned=False).collect()}
    assert other["s:1"].description == "" and other["s:1"].notes.startswith("Due: Tue Sep 22 17:00\n") and "Handout" not in other["s:1"].notes
    sinks.write_json(items, str(tmp_path / "json"))
    assert [r.id for r in spark.read.json(str(tmp_path / "json")).orderBy("id").collect()] == ["s:1", "s:2"]
