import json
from datetime import datetime

from pyspark.sql import functions as F
from workfeed.sources import classroom, events, ics, legacy, planner, schedule

FEED = (
    "BEGIN:VCALENDAR\r\nX-WR-CALNAME:Club\\, one\r\nX-WR-TIMEZONE:America/Los_Angeles\r\n"
    "BEGIN:VEVENT\r\nUID:utc\r\nSUMMARY:Busy\r\nDTSTART:20260922T170000Z\r\nDTEND:20260922T180000Z\r\nEND:VEVENT\r\n"
    "BEGIN:VEVENT\r\nUID:zoned\r\nSUMMARY:Zoned event\r\nDTSTART;TZID=America/New_York:20260922T090000\r\nEND:VEVENT\r\n"
    "BEGIN:VEVENT\r\nUID:allday\r\nSUMMARY:Field trip\r\nDTSTART;VALUE=DATE:20260923\r\nRRULE:FREQ=WEEKLY\r\nDESCRIPTION:Bring lunch\r\nEND:VEVENT\r\n"
    "BEGIN:VEVENT\r\nUID:folded\r\nSUMMARY:A title that was wrapped \r\n onto a second line\r\nDTSTART:20260924T170000Z\r\nDESCRIPTION:Bring a pen\\, a notebook\\; and questions\r\nLOCATION:Room 204\r\nEND:VEVENT\r\n"
    "BEGIN:VEVENT\r\nUID:nodate\r\nSUMMARY:x\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
)


def test_icalendar_dates_folds_and_escapes(spark, tmp_path):
    (tmp_path / "club.ics").write_bytes(FEED.encode())
    found = ics.events(ics.read_feeds(spark, str(tmp_path)))
    rows = {r.event_id: r for r in found.collect()}
    assert {k: r.start_at for k, r in rows.items()} == {
        "utc": datetime(2026, 9, 22, 17), "zoned": datetime(2026, 9, 22, 13), "allday": datetime(2026, 9, 24, 6, 59), "folded": datetime(2026, 9, 24, 17),
    }
    assert rows["folded"].summary == "A title that was wrapped onto a second line"
    assert rows["folded"].description == "Bring a pen, a notebook; and questions" and rows["folded"].location == "Room 204"
    assert rows["allday"].description == "Bring lunch\nRepeats: FREQ=WEEKLY" and rows["allday"].all_day
    titles = {r.id: (r.title, r.ends_at) for r in events.occurrences(found).collect()}
    assert titles["gcal:club.ics:utc"] == ("Club, one", datetime(2026, 9, 22, 18)) and titles["gcal:club.ics:zoned"][0] == "Zoned event"


def test_occurrences_drop_repeats_cancelled_and_declined(spark):
    at = datetime(2026, 9, 22, 17)
    rows = [("u@x", "L", 1, "e", None, "A", "confirmed", False), ("u@x", "L", 2, "e", None, "B", "confirmed", False), ("u@x", "L", 3, "f", None, "C", "cancelled", False),
            ("u@x", "L", 4, "g", None, "D", None, True), ("u@x", "L", 5, "h", "s 1", " free ", None, False), ("u@x", None, 6, None, None, "", None, None)]
    df = spark.createDataFrame([(*r, at, None, None) for r in rows], "feed string, label string, ordinal int, event_id string, series_id string, summary string, status string, declined boolean, start_at timestamp, end_at timestamp, url string")
    got = sorted((r.id, r.title) for r in events.occurrences(df).collect())
    assert got == [("gcal:u::20260922", "(untitled event)"), ("gcal:u:e", "A"), ("gcal:u:s-1:20260922", "L")]


def test_planner_polymorphic_fields_merge_and_shadows(spark, tmp_path):
    rows = [
        {"course_id": 1, "plannable_type": "quiz", "plannable_id": 301, "submissions": {"missing": True}, "plannable": {"title": "Quiz", "due_at": "2026-09-20T00:00:00Z"}},
        {"course_id": 1, "plannable_type": "assignment", "plannable_id": 201, "submissions": False, "plannable": {"title": " ", "name": "Named", "created_at": "2026-09-01"}},
        {"plannable_type": "planner_note", "plannable_id": 9, "plannable": {}}, {"plannable_type": "calendar_event", "plannable_id": 8}, {"plannable_type": "quiz", "plannable_id": 0},
    ]
    listing = [
        {"id": 201, "course_id": 1, "name": "Listed", "points_possible": 4, "due_at": "2026-09-21T00:00:00Z"}, {"id": 203, "name": "Undated"}, {"id": 204, "name": "Old", "due_at": "2020-01-01T00:00:00Z"},
        {"id": 205, "name": "Shadow", "quiz_id": 301, "due_at": "2026-09-20T00:00:00Z"},
    ]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    (tmp_path / "l.json").write_text(json.dumps(listing))
    first = planner.planner_stubs(planner.read_rows(spark, str(tmp_path / "p.json"), planner.PLANNER))
    second = planner.listing_stubs(planner.read_rows(spark, str(tmp_path / "l.json"), planner.LISTING), F.lit("2026-01-01").cast("timestamp"))
    got = {r.id: r for r in planner.merged(first, planner.without_shadows(second, first)).collect()}
    assert set(got) == {"canvas:quiz:301", "canvas:assignment:201", "canvas:assignment:203"}
    assert got["canvas:quiz:301"].state == "missing"
    r = got["canvas:assignment:201"]
    assert (r.title, r.points, r.due_at, r.assigned_at) == ("Named", 4.0, datetime(2026, 9, 21), datetime(2026, 9, 1))


def test_classroom_lists_states_and_grades(spark, tmp_path):
    work = {"courseWork": [
        {"courseId": "c", "id": "1", "title": "One", "state": "PUBLISHED", "workType": "ASSIGNMENT", "dueDate": {"year": 2026, "month": 1, "day": 2}, "dueTime": {"hours": 3}, "maxPoints": 10,
         "creationTime": "2026-01-01T00:00:00Z", "materials": [{"link": {"url": "u", "title": "t"}}, {"driveFile": {"driveFile": {"id": "f", "title": "d", "alternateLink": "a"}}}]},
        {"courseId": "c", "id": "2", "title": "Two", "workType": "MULTIPLE_CHOICE_QUESTION", "maxPoints": 0}, {"courseId": "c", "id": "3", "state": "DRAFT"},
    ]}
    subs = {"studentSubmissions": [{"courseId": "c", "courseWorkId": "1", "state": "RETURNED", "submissionHistory": [
        {"stateHistory": {"state": "TURNED_IN", "stateTimestamp": "2026-01-01T05:00:00Z"}}, {"gradeHistory": {"gradeChangeType": "ASSIGNED_GRADE_POINTS_EARNED_CHANGE", "pointsEarned": 8}},
        {"stateHistory": {"state": "TURNED_IN", "stateTimestamp": "2026-01-01T06:00:00Z"}}],
        "assignmentSubmission": {"attachments": [{"link": {"url": "mine", "title": "m"}}, {"driveFile": {"id": "f", "title": "own", "alternateLink": "o"}}]}},
        {"courseId": "c", "courseWorkId": "1", "id": "0", "state": "CREATED"}]}
    (tmp_path / "w.json").write_text(json.dumps(work))
    (tmp_path / "s.json").write_text(json.dumps(subs))
    raw = classroom.read_list(spark, str(tmp_path / "w.json"), "courseWork")
    handed = classroom.hand_ins(classroom.read_list(spark, str(tmp_path / "s.json"), "studentSubmissions"))
    got = {r.id: r for r in classroom.with_progress(classroom.coursework(raw), handed, F.lit("2026-06-01").cast("timestamp")).collect()}
    assert set(got) == {"classroom:c:1", "classroom:c:2"}
    one, two = got["classroom:c:1"], got["classroom:c:2"]
    assert (one.state, one.grade, one.turned_in_at, one.due_at, [a.name for a in one.attachments]) == ("graded", "8/10", datetime(2026, 1, 1, 6), datetime(2026, 1, 2, 3), ["t", "d"])
    assert [(a.name, a.url) for a in one.files] == [("m", "mine"), ("own", "o")] and two.files == []
    assert (two.state, two.kind, two.points, two.due_at) == ("not_started", "question", None, None)
    assert classroom.announcements(raw.withColumn("text", F.lit("Hello\nall"))).first().title == "Hello"


def test_schedule_rows_and_whole_documents(spark):
    answers = ["```json\n{\"entries\": [{\"date\": \"2026-09-21\", \"kind\": \"Homework\", \"title\": \"Read 1\", \"time\": \"08:30\"}, {\"date\": \"2026-09-21\", \"title\": \"Read 1\", \"time\": \"09:00\"}, {\"date\": \"soon\", \"title\": \"x\"}]}\n```",
               "[{\"date\": \"2026-09-22\", \"due_date\": \"2026-09-25\", \"kind\": \"exam\", \"title\": \"Exam\"}]", "no rows"]
    docs = spark.createDataFrame([(f"d{i}", a) for i, a in enumerate(answers)], "doc_id string, answer string").select("doc_id", F.lit("c").alias("course"), F.lit("u").alias("url"), schedule.parsed_entries(F.col("answer")).alias("entries"))
    rows = schedule.rows_of(docs)
    assert sorted((r.id, r.kind, r.due_at) for r in rows.collect()) == [
        ("gdoc:d0:2026-09-21-read-1", "assignment", datetime(2026, 9, 21, 8, 30)), ("gdoc:d1:2026-09-25-exam", "quiz", datetime(2026, 9, 25, 23, 59)),
    ]
    whole = schedule.whole_documents(docs.select("doc_id", "course", "url", F.lit(" ").alias("name"), F.lit("text").alias("text")), rows).collect()
    assert [(r.id, r.title) for r in whole] == [("gdoc:d2", "Course calendar")]


def test_legacy_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("s", "1", "a", 1), ("s", "2", "b", 1)], "source string, source_id string, status string, fetched_at int")
    new = spark.createDataFrame([("s", "2", "c", 2), ("s", "3", "d", 2), ("s", "1", "z", 0)], old.schema)
    once = legacy.upserted(old, new)
    want = [("s", "1", "a", 1), ("s", "2", "c", 2), ("s", "3", "d", 2)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, legacy.upserted(once, new).collect())) == want
