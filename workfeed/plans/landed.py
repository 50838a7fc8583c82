"""Named queries over landed files: the given tables are written as the feeds' JSON, in pages as a feed serves them, and read back; and over texts, stores and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import extract, memo, reconcile, render, sinks
from ..sources import classroom, legacy, planner, schedule
from ..sources import events as calendar
from ..state import new_folder
from . import bindings as b
from . import queries as q

BASE = "https://lms.example"
#: Rows of a landed page, about.
PAGE_ROWS = 1000


def _pick(values: list, number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _landed(spark: SparkSession, rows: DataFrame, by: str, order: list[str], field: str | None = None) -> str:
    """The path of a new folder with rows (json, ...) as pages of JSON: arrays, or under a field; rows alike in `by` share a page, in order."""
    path = new_folder(spark, "landed")
    pages = max(1, -(-rows.count() // PAGE_ROWS))
    dealt = rows.withColumn("page", F.pmod(F.xxhash64(by), F.lit(pages)))
    held = dealt.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(F.struct(*order, "json")))["json"], ",").alias("j"))
    start, end = (f'{{"{field}": [', "]}") if field else ("[", "]")
    held.select(F.concat(F.lit(start), "j", F.lit(end)).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _z(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# -- first feed ------------------------------------------------------------------------------

CODES = ["assignment", "sub_assignment", "assessment_request", "quiz", "discussion_topic", "wiki_page", "announcement", "planner_note", "other_thing"]


def _planner_path(spark, sf_dir) -> str:
    items = q._items(spark, sf_dir).where("source = 'canvas'")
    n = F.col("ordinal")
    m = F.floor(n / 4)
    plannable = F.struct(
        F.when(n % 5 != 0, F.col("title")).alias("title"), F.concat(F.lit("Named "), n.cast("string")).alias("name"), _z(F.col("due_at")).alias("due_at"),
        F.when(n % 20 == 0, F.date_format("assigned_at", "yyyy-MM-dd")).alias("todo_date"), _z(F.col("assigned_at")).alias("created_at"), F.col("points").alias("points_possible"),
    )
    url = F.when(n % 3 == 1, F.concat(F.lit("/courses/"), "course_id", F.lit("/x/"), n.cast("string"))).when(n % 3 == 2, F.col("url"))
    fields = F.struct(
        F.when(n % 50 != 0, F.col("course_id").cast("bigint")).alias("course_id"), F.concat(F.lit("Context "), "course").alias("context_name"), _pick(CODES, n).alias("plannable_type"),
        n.alias("plannable_id"), url.alias("html_url"), plannable.alias("plannable"),
    )
    flags = F.concat(F.lit('{"excused": '), (n % 7 == 0).cast("string"), F.lit(', "submitted": '), (n % 3 == 0).cast("string"), F.lit(', "missing": '), (m % 2 == 0).cast("string"), F.lit("}"))
    told = F.concat(F.lit('{"submissions": '), F.when(m % 4 == 0, F.lit("false")).otherwise(flags), F.lit(", "), F.substring(F.to_json(fields), 2, 1_000_000))
    rows = items.select("ordinal", told.alias("json"))
    return _landed(spark, rows, "ordinal", ["ordinal"])


def _planner_rows(spark, sf_dir) -> DataFrame:
    return planner.read_rows(spark, _planner_path(spark, sf_dir), planner.PLANNER)


def _courses(spark, sf_dir) -> DataFrame:
    return q._table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE concat('Course ', c_custkey) END").alias("name"), F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("course_code")
    )


def planner_feed(spark, sf_dir):
    """Landed planner rows as work items with the names of their courses."""
    rows = planner.with_course_names(planner.planner_stubs(_planner_rows(spark, sf_dir), BASE), _courses(spark, sf_dir))
    return rows.withColumns({c: times.rfc3339(F.col(c)) for c in ("due_at", "assigned_at")})


def listing_feed(spark, sf_dir):
    """Landed course listings: undated rows and those from a date on."""
    parts = q._table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    due = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00' + INTERVAL '1' DAY * CAST(p_partkey % 300 AS INT)")
    fields = F.struct(
        n.alias("id"), F.col("p_size").cast("bigint").alias("course_id"), F.when(n % 6 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("name"), F.when(n % 4 != 0, _z(due)).alias("due_at"),
        _z(due).alias("created_at"), F.col("p_retailprice").alias("points_possible"), F.concat(F.lit(BASE + "/a/"), n.cast("string")).alias("html_url"),
        F.when(n % 9 == 0, n).alias("quiz_id"), F.when(n % 10 == 0, F.struct(n.alias("id"))).alias("discussion_topic"),
    )
    path = _landed(spark, parts.select(n.alias("n"), F.to_json(fields).alias("json")), "n", ["n"])
    rows = planner.listing_stubs(planner.read_rows(spark, path, planner.LISTING), F.lit("1998-06-01T00:00:00Z").cast("timestamp"))
    return rows.withColumns({c: times.rfc3339(F.col(c)) for c in ("due_at", "assigned_at")})


# -- second feed -----------------------------------------------------------------------------


def _work_rows(spark, sf_dir) -> DataFrame:
    items = q._items(spark, sf_dir).where("source = 'classroom'")
    n, due = F.col("ordinal"), F.col("due_at")
    m = F.floor(n / 4)
    part = lambda unit: F.date_part(F.lit(unit), due).cast("int")
    fields = F.struct(
        F.col("course_id").alias("courseId"), n.cast("string").alias("id"), "title", "description", F.concat(F.lit("\n First line of "), "title", F.lit("\nmore")).alias("text"),
        _pick(["PUBLISHED", "PUBLISHED", "DRAFT", None], m).alias("state"), F.col("url").alias("alternateLink"), _z(F.col("assigned_at")).alias("creationTime"),
        F.when(n % 6 == 1, _z(F.expr("assigned_at + INTERVAL '2' DAY"))).alias("scheduledTime"),
        F.when(due.isNotNull(), F.struct(part("YEAR").alias("year"), part("MONTH").alias("month"), (part("DAY") + F.when(n % 11 == 0, 31).otherwise(0)).cast("int").alias("day"))).alias("dueDate"),
        F.when(m % 2 == 1, F.struct(part("HOUR").alias("hours"), F.lit(30).alias("minutes"))).alias("dueTime"), F.coalesce("points", F.lit(0.0)).alias("maxPoints"),
        _pick(["ASSIGNMENT", "SHORT_ANSWER_QUESTION", "MULTIPLE_CHOICE_QUESTION", "X"], m).alias("workType"),
        F.array(F.struct(F.struct("url", "title").alias("link"))).alias("materials"),
    )
    return items.select("ordinal", "kind", F.to_json(fields).alias("json"))


def _hand_in_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    items = q._items(spark, sf_dir).where("source = 'classroom'").select("ordinal", "course_id")
    lines = q._table(spark, sf_dir, "lineitem").join(items, F.col("l_orderkey") == F.col("ordinal"))
    history = F.array(
        F.struct(F.struct(F.lit("TURNED_IN").alias("state"), _z(F.col("l_shipdate")).alias("stateTimestamp")).alias("stateHistory"), F.lit(None).cast("struct<gradeChangeType:string,pointsEarned:double>").alias("gradeHistory")),
        F.struct(
            F.lit(None).cast("struct<state:string,stateTimestamp:string>").alias("stateHistory"),
            F.when(F.col("l_returnflag") == "A", F.struct(F.lit("ASSIGNED_GRADE_POINTS_EARNED_CHANGE").alias("gradeChangeType"), F.col("l_quantity").alias("pointsEarned"))).alias("gradeHistory"),
        ),
    )
    files = F.struct(F.array(F.struct(F.struct(F.concat(F.lit("u/"), F.col("l_partkey").cast("string")).alias("url"), F.lit("mine").alias("title")).alias("link"))).alias("attachments"))
    fields = F.struct(
        F.col("course_id").alias("courseId"), F.col("ordinal").cast("string").alias("courseWorkId"), F.col("l_linenumber").cast("string").alias("id"),
        F.when(F.col("l_returnflag") == "A", "RETURNED").when(F.col("l_returnflag") == "R", "TURNED_IN").otherwise("CREATED").alias("state"), (F.col("l_linestatus") == "O").alias("late"),
        _z(F.col("l_shipdate")).alias("updateTime"), F.when(F.col("l_returnflag") != "N", files).alias("assignmentSubmission"), history.alias("submissionHistory"),
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return lines.select("ordinal", *order, F.to_json(fields).alias("json")), order


def _handed(spark, sf_dir) -> DataFrame:
    rows, order = _hand_in_rows(spark, sf_dir)
    return classroom.read_list(spark, _landed(spark, rows, "ordinal", ["ordinal", *order], "studentSubmissions"), "studentSubmissions")


def classroom_feed(spark, sf_dir):
    """Landed course work with the first hand-in of each, materials and announcements."""
    rows = _work_rows(spark, sf_dir)
    read = lambda part, field: classroom.read_list(spark, _landed(spark, part, "ordinal", ["ordinal"], field), field)
    work = classroom.with_progress(classroom.coursework(read(rows.where("kind NOT IN ('material', 'announcement')"), "courseWork")), classroom.hand_ins(_handed(spark, sf_dir)), q._now())
    told = classroom.materials(read(rows.where("kind = 'material'"), "courseWorkMaterial")).unionByName(classroom.announcements(read(rows.where("kind = 'announcement'"), "announcements")))
    both = work.unionByName(told, allowMissingColumns=True)
    return both.select(
        "id", "kind", "course_id", "title", "url", times.rfc3339(F.col("due_at")).alias("due_at"), times.rfc3339(F.col("assigned_at")).alias("assigned_at"), "points", "state", "grade",
        times.rfc3339(F.col("turned_in_at")).alias("turned_in_at"), F.coalesce("late", F.lit(False)).alias("late"), F.array_join(F.transform(F.concat("attachments", F.coalesce("files", F.array().cast("array<struct<name:string,url:string>>"))), lambda a: a["url"]), " ").alias("urls"),
    )


def legacy_feed(spark, sf_dir):
    """Both feeds in the earlier flat table's shape."""
    courses = _courses(spark, sf_dir)
    first = legacy.planner_homework(_planner_rows(spark, sf_dir), courses, BASE, F.lit("1998-06-01T00:00:00Z"))
    rows = _work_rows(spark, sf_dir).where("kind NOT IN ('material', 'announcement')")
    work = classroom.read_list(spark, _landed(spark, rows, "ordinal", ["ordinal"], "courseWork"), "courseWork")
    names = courses.select(F.col("id").cast("string").alias("id"), F.col("course_code").alias("name"))
    second = legacy.classroom_homework(work, _handed(spark, sf_dir), names, q._now(), F.lit("1998-06-01T00:00:00Z"))
    return first.unionByName(second)


def feed_counts(spark, sf_dir):
    """What a fetch of each feed brought: rows by source and kind, dated ones and files."""
    first = planner.planner_stubs(_planner_rows(spark, sf_dir), BASE).select(F.lit("canvas").alias("source"), "kind", "due_at", F.lit(0).alias("n_files"))
    rows = _work_rows(spark, sf_dir).where("kind NOT IN ('material', 'announcement')")
    work = classroom.coursework(classroom.read_list(spark, _landed(spark, rows, "ordinal", ["ordinal"], "courseWork"), "courseWork"))
    second = work.select(F.lit("classroom").alias("source"), "kind", "due_at", F.size("attachments").alias("n_files"))
    return planner.fetch_counts(first.unionByName(second))


def _calendar_path(spark, sf_dir) -> str:
    e = b.bound(spark, sf_dir, b.EVENTS)
    n = F.col("ordinal")
    when = lambda c: F.when(n % 7 == 0, F.struct(F.lit(None).cast("string").alias("dateTime"), F.date_format(c, "yyyy-MM-dd").alias("date"))).otherwise(F.struct(_z(c).alias("dateTime"), F.lit(None).cast("string").alias("date")))
    person = lambda own, answer: F.struct(own.alias("self"), answer.alias("responseStatus"))
    fields = F.struct(
        "feed", "label", n.alias("ordinal"), F.col("event_id").alias("id"), F.col("series_id").alias("recurringEventId"), "summary", "status", F.col("url").alias("htmlLink"), when(F.col("start_at")).alias("start"),
        F.when(F.col("end_at").isNotNull(), when(F.col("end_at"))).alias("end"), F.array(person(F.lit(False), F.lit("declined")), person(F.lit(True), F.when(F.col("declined"), "declined").otherwise("accepted"))).alias("attendees"),
    )
    return _landed(spark, e.select("ordinal", "feed", F.to_json(fields).alias("json")), "ordinal", ["ordinal"])


def _occurrences(rows: DataFrame) -> DataFrame:
    low, high = (F.lit(t).cast("timestamp") for t in ("2024-01-03T00:00:00Z", "2024-01-25T00:00:00Z"))
    return calendar.occurrences(calendar.listed_events(rows), low, high)


def calendar_feed(spark, sf_dir):
    """Landed pages of a calendar's listing, timed and all-day, as occurrences."""
    rows = planner.read_rows(spark, _calendar_path(spark, sf_dir), calendar.LISTED)
    return _occurrences(rows).select("id", "title", "course", times.rfc3339(F.col("due_at")).alias("due_at"), times.rfc3339(F.col("ends_at")).alias("ends_at"), "url")


# -- documents -------------------------------------------------------------------------------


def _answered_documents(spark, sf_dir) -> DataFrame:
    """Schedule documents with what an answer says of them."""
    docs = q._table(spark, sf_dir, "documents")
    answer = F.when(F.col("doc_id") % 3 == 0, F.lit('{"entries": [{"date": "1998-06-01", "title": "Read on", "kind": "exam"}, {"date": "none", "title": "x"}]}')).otherwise(F.lit("nothing here"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("course"), F.lit("u").alias("url"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).otherwise(" ").alias("name"), (F.col("doc_id") % 5 == 0).alias("truncated"), answer.alias("answer"))


def whole_documents(spark, sf_dir):
    """Schedule documents as their rows, and as one item where they have none."""
    shaped = _answered_documents(spark, sf_dir).withColumn("entries", schedule.parsed_entries(F.col("answer")))
    rows = schedule.rows_of(shaped)
    whole = schedule.whole_documents(shaped, rows)
    return rows.select("id", "kind", "title", times.rfc3339(F.col("due_at")).alias("due_at"), F.lit(None).cast("string").alias("said")).unionByName(
        whole.select("id", "kind", "title", F.lit(None).cast("string").alias("due_at"), F.md5("description").alias("said"))
    )


def json_export(spark, sf_dir):
    """The unified table exported as JSON, packed, and read back under its schema."""
    progress = F.struct("state", "submitted_at", "late", "grade").alias("progress")
    columns = ["id", "source", "kind", "course", "course_id", "title", "url", "assigned_at", "due_at", "ends_at", "points", "description"]
    path = new_folder(spark, "export")
    made = lambda rows: rows.select(*columns, F.expr(q._files("lines")).alias("attachments"), progress)
    sinks.write_json(q._with_lines(spark, sf_dir), path, made, "gzip")
    back = planner.read_items(spark, path)
    return back.select("id", "source", "kind", "course", "title", times.rfc3339(F.col("due_at")).alias("due_at"), "points", "progress.state", "progress.grade", F.size("attachments").cast("bigint").alias("n_files"))


def schedule_texts(spark, sf_dir):
    """What rows and parts of schedule documents are told with."""
    docs = extract.chunks(q._table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", 6144).withColumn("parts", F.count("*").over(Window.partitionBy("doc_id")))  # a document's own parts
    today = F.expr(f"CAST({b.NOW} AS TIMESTAMP) + INTERVAL '1' DAY * CAST(doc_id % 30 AS INT)")
    prompt = schedule.chunk_prompt(F.col("source"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.col("chunk"), F.col("part"), F.col("parts"), F.col("doc_id") % 5 == 0, today)
    said = schedule.row_description(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" Read "), "source")), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(""), today)
    return docs.select("doc_id", "part", F.md5("chunk").alias("chunk"), F.md5(F.replace(prompt, F.col("chunk"), F.lit("*"))).alias("prompt"), said.alias("said"))


# -- texts and dates -------------------------------------------------------------------------


def instants(spark, sf_dir):
    """Dates as texts of several forms, read strictly and leniently and compared."""
    e = q._table(spark, sf_dir, "events")
    n, z = F.col("event_id"), _z(F.col("ts"))
    east = F.concat(F.date_format(F.expr("ts + INTERVAL '330' MINUTE"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    s = F.when(n % 5 == 0, z).when(n % 5 == 1, F.date_format("ts", "yyyy-MM-dd")).when(n % 5 == 2, east).when(n % 5 == 3, F.lit("")).otherwise(F.lit("2024-13-45T00:00:00Z"))
    low, high = times.days_around(F.expr("TIMESTAMP '2024-01-15 00:00:00'"), 10, 0)
    return e.select(
        "event_id", times.rfc3339(times.strict_instant(s)).alias("strict"), times.rfc3339(times.lenient_instant(s)).alias("lenient"), times.same_instant(s, z).alias("same"),
        times.seconds_of(_pick(["36h", "7d", "90m", "2w", "30s", "soon", ""], n)).alias("seconds"), text.lenient_int(_pick(["12", "-3", "1.5", "", "x", "99999999999999999999"], n)).alias("whole"),
        times.due_within(F.col("ts").cast("timestamp"), low, high).alias("inside"),
        memo.reread_due(_pick(["v1", "v2", None], n), F.lit("v1"), F.col("ts").cast("timestamp"), F.lit(86_400 * 5), F.expr("TIMESTAMP '2024-01-15 00:00:00'")).alias("reread"),
        times.rfc3339(times.from_parts(F.lit(2024) - (n % 2).cast("int"), (n % 13).cast("int"), (n % 33).cast("int"), (n % 26).cast("int"), (n % 70).cast("int"))).alias("parts"),
    )


def references(spark, sf_dir):
    """Ids, links, names and versions of files from the references a user or a feed gives."""
    p = q._table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    i = F.concat(F.lit("id"), n.cast("string"))
    shapes = ["{}", "https://d.example/document/d/{}/edit?x=1", "https://d.example/open?a=1&id={}#p", "https://d.example/file/d/{}", "https://d.example/none/{}", "", "http://c.example/ical/{}%40g.example/public/basic.ics",
              "https://c.example/caldav/v2/{}/events/", "https://c.example/embed?src={}%40g.example&x", "https://c.example/{}@h/events", "HTTP://c.example/a.ICS", "http://c.example/a.ICS?k=b.txt"]
    ref = F.replace(_pick(shapes, n), F.lit("{}"), i)
    updated = F.when(n % 3 != 0, F.lit("1998-01-01"))
    return p.select(
        "p_partkey", ref.alias("ref"), text.document_id(ref).alias("document"), text.calendar_id(ref).alias("calendar"), text.is_feed_url(ref).alias("feed"),
        text.absolute_url(_pick(["/x", "http://h/y", "z", ""], n), BASE + "/").alias("absolute"), planner.web_url(BASE, _pick(CODES, n), F.col("p_size"), n).alias("page"),
        planner.file_name(_pick(["a.pdf", "", None], n), _pick(["b.txt", None], n), n).alias("name"), planner.file_version(updated, F.lit(None).cast("string"), F.col("p_size"), 10, 20).alias("version"),
        classroom.file_version(n % 2, updated, F.lit("sum"), 5, 6).alias("drive_version"), classroom.course_name(_pick(["", "N"], n), _pick(["", "S", " "], n), _pick([None, "H"], n), i).alias("course"),
    )


def plain_bodies(spark, sf_dir):
    docs = q._table(spark, sf_dir, "documents")
    messy = F.concat(F.lit(" \r\n"), F.replace("text", F.lit(". "), F.lit(".\r")), F.lit("\r\n \t"))
    return docs.select("doc_id", F.md5(text.plain_text(messy)).alias("plain"))


def list_answers(spark, sf_dir):
    """List responses, bare or under a field."""
    rows = q._table(spark, sf_dir, "labels")
    n = F.col("doc_id")
    bare = F.concat(F.lit('[{"id": '), n.cast("string"), F.lit(', "title": "t'), n.cast("string"), F.lit('", "quiet": true}, {"id": 0}]'))
    answer = F.when(n % 3 == 0, bare).when(n % 3 == 1, F.concat(F.lit('{"entries": '), bare, F.lit("}"))).otherwise(F.lit('{"error": 1}'))
    return rows.select("doc_id", F.explode_outer(text.listed(answer, "STRUCT<id: BIGINT, title: STRING, quiet: BOOLEAN>")).alias("e")).select("doc_id", "e.id", "e.title", "e.quiet")


def inbox_texts(spark, sf_dir):
    return q._with_attachments(spark, sf_dir).select("id", F.md5(render.inbox_context()).alias("told"))


def event_texts(spark, sf_dir):
    e = b.bound(spark, sf_dir, b.EVENTS)
    n = F.col("ordinal")
    place = F.when(n % 3 == 0, F.concat(F.lit(" Room \n "), n.cast("string")))
    return e.select("ordinal", calendar.described(F.col("start_at"), F.col("end_at"), n % 7 == 0, place, F.when(n % 5 != 0, F.col("summary")), F.coalesce("label", F.lit("shared"))).alias("said"))


# -- runs ------------------------------------------------------------------------------------


def state_after(spark, sf_dir):
    """What is remembered after a run, and after a dry one."""
    state, actions = b.bound(spark, sf_dir, b.SYNC_STATE), q._actions(spark, sf_dir)
    run = lambda dry: reconcile.next_state(state, actions, F.lit("1998-06-01T00:00:00Z"), dry).withColumn("dry", F.lit(dry))
    return run(False).unionByName(run(True))


def owned_elsewhere(spark, sf_dir):
    """Rendered rows where another writer owns the descriptions, and their hashes."""
    return render.rendered(q._with_attachments(spark, sf_dir), owned=False).select("external_id", "description", F.md5("notes").alias("notes"), F.length("content_hash").cast("bigint").alias("n_hash"))


def content_hashes(spark, sf_dir):
    return q._rendered(spark, sf_dir).select("external_id", "content_hash")


def handed_notes(spark, sf_dir):
    """Notes with what was handed in: a text and files."""
    items = q._with_attachments(spark, sf_dir)
    return items.select("id", F.md5(render.notes(None, F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit(" My "), "title")), F.filter("attachments", lambda a: a["content"].isNotNull()))).alias("notes"))


def calendar_blind(spark, sf_dir):
    events, state, _ = q._calendar_sides(spark, sf_dir)
    return reconcile.calendar_actions(reconcile.calendar_entries(events.where("ordinal % 17 <> 0")), state, None, 200)


def calendar_needed(spark, sf_dir):
    _, state, _ = q._calendar_sides(spark, sf_dir)
    return reconcile.any_event(q._items(spark, sf_dir), state)


def _inbox(spark, sf_dir) -> DataFrame:
    items = reconcile.is_task(q._items(spark, sf_dir), b.bound(spark, sf_dir, b.LISTING), b.bound(spark, sf_dir, b.SYNC_STATE).where("note_id % 3 = 0"))
    rows = items.withColumn("route", reconcile.route(F.col("source"), F.col("kind"), F.col("due_at"), F.col("is_task"))).where("route = 'inbox'")
    return rows.select("id", "ordinal", memo.input_hash("title").alias("context_hash"), F.when(F.col("ordinal") % 4 == 0, memo.input_hash("title")).alias("sent_hash"), F.when(F.col("ordinal") % 5 == 0, "task").alias("outcome"))


def _sent(spark, sf_dir) -> DataFrame:
    """Inbox calls first, then briefs, under one budget of calls."""
    inbox = _inbox(spark, sf_dir).withColumn("prio", F.lit(1))
    briefs = q._items(spark, sf_dir).where("state = 'not_started' AND ordinal % 9 = 0").select(
        F.concat(F.lit("brief:"), "id").alias("id"), "ordinal", F.lit("x").alias("context_hash"), F.lit(None).cast("string").alias("sent_hash"), F.lit(None).cast("string").alias("outcome"), F.lit(2).alias("prio")
    )
    return reconcile.inbox_actions(inbox.unionByName(briefs), 100, [F.col("prio"), F.col("ordinal")])


def inbox_budget(spark, sf_dir):
    return _sent(spark, sf_dir).select("id", "action")


def run_counters(spark, sf_dir):
    """All counters of a run over its change-sets."""
    actions = q._actions(spark, sf_dir)
    tasks = actions.select(F.lit("task").alias("part"), F.col("action").alias("outcome")).unionByName(actions.where("migrated").select(F.lit("task").alias("part"), F.lit("migrated").alias("outcome")))
    days = q.calendar_actions(spark, sf_dir).select(F.lit("calendar").alias("part"), F.col("action").alias("outcome"))
    sent = _sent(spark, sf_dir)
    brief = F.col("id").startswith("brief:")
    told = F.when(F.col("action") != "send", F.when(F.col("action") == "promote", "task").otherwise(F.col("action"))).otherwise(_pick(["remembered", "nothing", "retry"], F.col("ordinal")))
    inbox = sent.where(~brief).select(F.lit("inbox").alias("part"), told.alias("outcome"))
    briefs = sent.where(brief).select(F.lit("brief").alias("part"), F.col("action").alias("outcome"))
    return reconcile.run_counters(tasks.unionByName(days).unionByName(inbox).unionByName(briefs))


def expansion_tally(spark, sf_dir):
    items, found, configured = q._schedules(spark, sf_dir)
    return schedule.expansion_tally(schedule.expansion(items, found, configured), schedule.expand(items, found, configured)[1])


def memo_counts(spark, sf_dir):
    wanted = q._table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('v', CAST(p_size % 2 AS STRING)) END").alias("version"))
    return memo.hit_counts(memo.split(wanted, q._memo(spark, sf_dir)))


def _asked(spark, sf_dir) -> DataFrame:
    items = q._items(spark, sf_dir).select("id", memo.input_hash("title", "kind").alias("input_hash"), "ordinal", "state")
    known = items.where("ordinal % 3 <> 0").select("id", F.when(F.col("ordinal") % 2 == 0, F.col("input_hash")).otherwise("x").alias("input_hash"), F.concat(F.lit("answer "), "id").alias("answer"))
    rows = memo.answers(items, known)
    return memo.answer_outcomes(rows, F.col("state") == "graded", F.col("ordinal") % 5 != 0, [F.col("ordinal")], 300)


def answer_outcomes(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", "outcome", "answer")


def answer_tally(spark, sf_dir):
    return _asked(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


def answers_kept(spark, sf_dir):
    """The answer memo after a run, unseen answers forgotten."""
    items = q._items(spark, sf_dir)
    seen = F.expr(f"{b.NOW} - INTERVAL '1' DAY * CAST(ordinal % 60 AS INT)").cast("timestamp")
    known = items.where("ordinal % 3 <> 0").select("id", memo.input_hash("kind").alias("input_hash"), F.concat(F.lit("old "), "id").alias("answer"), seen.alias("seen_at"))
    fresh = items.where("ordinal % 4 = 0").select("id", memo.input_hash("title").alias("input_hash"), F.concat(F.lit("new "), "id").alias("answer"), F.expr(b.NOW).cast("timestamp").alias("seen_at"))
    return memo.next_answers(known, fresh, F.expr(b.NOW).cast("timestamp"), "'30' DAY").select("id", "input_hash", "answer", times.rfc3339(F.col("seen_at")).alias("seen_at"))


def chosen_sources(spark, sf_dir):
    """Two of the sources, by their dates alone."""
    low, high = times.days_around(q._now(), 30, 120)
    rows = planner.wanted(q._items(spark, sf_dir), ("gdoc", "gcal"))
    return rows.where(times.due_within(F.col("due_at"), low, high)).select("id", "source", "due_at")


NAMES = [
    "planner_feed", "listing_feed", "classroom_feed", "legacy_feed", "feed_counts", "calendar_feed", "whole_documents", "json_export", "schedule_texts", "instants", "references", "plain_bodies", "list_answers",
    "inbox_texts", "event_texts", "state_after", "owned_elsewhere", "content_hashes", "handed_notes", "calendar_blind", "calendar_needed", "inbox_budget", "run_counters", "expansion_tally", "memo_counts",
    "answer_outcomes", "answer_tally", "answers_kept", "chosen_sources",
]
QUERIES = {name: globals()[name] for name in NAMES}
