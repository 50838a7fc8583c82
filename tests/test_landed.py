"""Landed feeds, references and dates: cases that the tables do not have."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from workfeed.functions import text, times
from workfeed.operators import match, memo
from workfeed.sources import events, planner, schedule


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_parts_carry_over_and_no_date_raises(spark):
    at = lambda *p: times.from_parts(*(F.lit(x).cast("int") for x in p))
    got = one(spark, at(2023, 2, 31, 0, 0), at(2024, 2, 30, 24, 61), at(2024, 0, 1, 0, 0), at(2024, 13, 1, None, None), at(None, 1, 1, 1, 1), at(99999, 1, 1, 1, 1))
    assert got == (datetime(2023, 3, 3), datetime(2024, 3, 2, 1, 1), None, datetime(2025, 1, 1), None, None)


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_what_is_printed_and_parsed_is_utc_in_any_session(new_york):
    spark = new_york
    at = times.strict_instant(F.lit("2026-07-01T02:30:00+02:00"))
    parts = times.from_parts(F.lit(2026), F.lit(7), F.lit(1), F.lit(0), F.lit(30))
    local = times.at_time(F.lit("2026-07-01").cast("date"), F.lit("09:15"), "Asia/Tokyo")
    junk = times.at_time(F.lit("2026-07-01").cast("date"), F.lit("25:00"), "UTC")
    assert one(spark, *(times.rfc3339(c) for c in (at, parts, local, junk))) == ("2026-07-01T00:30:00Z", "2026-07-01T00:30:00Z", "2026-07-01T00:15:00Z", "2026-07-01T23:59:00Z")
    feed = "BEGIN:VEVENT\nUID:1\nDTSTART;TZID=Nowhere/Land:20260701T090000\nEND:VEVENT\nBEGIN:VEVENT\nUID:2\nDTSTART;VALUE=DATE:20260701\nEND:VEVENT\n"
    from workfeed.sources import ics

    found = ics.events(spark.createDataFrame([("f", feed)], "feed string, body string"), "Europe/Paris")
    assert [(r.event_id, r.at) for r in found.select("event_id", times.rfc3339(F.col("start_at")).alias("at")).collect()] == [("1", "2026-07-01T07:00:00Z"), ("2", "2026-07-01T21:59:00Z")]


def test_documents_are_found_in_any_url(spark):
    items = spark.createDataFrame(
        [("a", ["http://x/d/abc/edit", None]), ("b", ["u", "http://x/open?id=LONG-id_1&z"]), ("c", ["http://x/ab"]), ("d", []), ("e", None), ("f", ["zzabczz"])], "id string, urls array<string>"
    )
    ids = spark.createDataFrame([("abc",), ("LONG-id_1",), ("",), (None,)], "doc_id string")
    assert sorted(r.id for r in schedule.pointing_at(items, ids).collect()) == ["a", "b", "f"]
    assert schedule.pointing_at(items, ids.limit(0)).count() == 0


def test_ids_of_references(spark):
    doc = {"x": "x", "": None, "http://h/d/": None, "http://h/d/q/r": "q", "http://h/a?id=": None, "http://h/a?id=%20z": " z", "http://h/a?xid=1": None, "?id=k": "k"}
    for ref, want in doc.items():
        assert one(spark, text.document_id(F.lit(ref))) == (want,), ref
    cal = {"me%40h.c": "me@h.c", "http://c/ical/a%2Bb%40h/basic.ics": "a+b@h", "http://c/v2/": None, "http://c/x": None, "http://c/?src=a%zz": "a%zz"}
    for ref, want in cal.items():
        assert one(spark, text.calendar_id(F.lit(ref))) == (want,), ref


def test_lists_bare_wrapped_and_junk(spark):
    rows = [' [{"id": 1}]', '{"entries": [{"id": 2}, {"id": 3}]}', '{"entries": []}', "{}", "junk", None]
    got = spark.createDataFrame([(r,) for r in rows], "a string").select(text.listed(F.col("a"), "STRUCT<id: INT>").alias("l")).collect()
    assert [None if r.l is None else [x.id for x in r.l] for r in got] == [[1], [2, 3], [], None, None, None]


def test_answers_that_left_a_pair_out_failed(spark):
    rows = spark.createDataFrame([("p1", "ask", 0), ("p2", "ask", 0), ("p3", "ask", 1), ("p4", "obvious", None)], "pair_key string, outcome string, batch int")
    answers = spark.createDataFrame([("p1", True), ("p2", False), ("p4", False)], "pair_key string, same boolean")
    got = match.answered(rows, answers)
    assert {r.pair_key: r.outcome for r in got.collect()} == {"p1": "judged_same", "p2": "judged_different", "p3": "failed", "p4": "obvious"}
    tally = match.run_tally(got, spark.createDataFrame([("x",)], "id string")).first().asDict()
    assert tally == {"pairs": 4, "obvious": 1, "cached": 0, "asked": 2, "deferred": 0, "failed": 1, "duplicates": 1}


def test_answers_within_a_budget_keep_what_is_stale(spark):
    rows = spark.createDataFrame([(str(i), memo_, None if memo_ == "missing" else "old") for i, memo_ in enumerate(["missing", "stale", "fresh", "stale", "missing"])], "id string, memo string, answer string")
    got = memo.answer_outcomes(rows, F.col("id") == "4", F.col("id") != "1", [F.col("id")], 2)
    assert {r.id: (r.outcome, r.answer) for r in got.collect()} == {"0": ("enriched", None), "1": ("failed", "old"), "2": ("cached", "old"), "3": ("deferred", "old"), "4": ("skipped", None)}


def test_links_names_and_versions(spark):
    assert one(spark, *(planner.web_url("http://b/", F.lit(k), F.lit(3), F.lit(9)) for k in ("quiz", "wiki_page", "odd"))) == ("http://b/courses/3/quizzes/9", "http://b/courses/3/pages/9", "http://b/courses/3")
    nothing = F.lit(None).cast("string")
    assert one(spark, planner.file_version(nothing, F.lit(""), F.lit(1), 2, 3), planner.file_name(nothing, F.lit(""), F.lit(5))) == ("", "file-5")
    at = F.lit(datetime(2026, 9, 22, 17)).cast("timestamp")
    assert one(spark, events.described(at, nothing.cast("timestamp"), F.lit(False), nothing, F.lit(" "), F.lit("L"))) == ("Tue 22 Sep 2026 17:00\nFrom the L calendar.",)


def test_feeds_by_page_order(spark):
    first = spark.createDataFrame([("w", 2, "b"), ("w", 1, "a"), ("v", 5, "c")], "k string, n int, x string")
    assert sorted(r.x for r in planner.first_of(first, ["k"], [F.col("n")]).collect()) == ["a", "c"]
