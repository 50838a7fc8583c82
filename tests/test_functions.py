import pytest
from pyspark.sql import functions as F
from workfeed.functions import codes, text, times




def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column).first()[0]


@pytest.mark.parametrize("column, value, want", [
    (lambda C: text.norm_title(C), "  Ch. 9 — É/quiz ", "ch 9 — é quiz"),
    (lambda C: text.title_words(C), "The lab, Lab 9 é ab class", ["lab", "9"]),
    (lambda C: text.slug(C), "Read: Ch. 3 & 4!", "read-ch-3-4"),
    (lambda C: text.slug(C), "?!", "row"),
    (lambda C: text.slug(C), "é" * 30, "é" * 20),
    (lambda C: text.cut_bytes(C, 4), "aéé", "aé"),
    (lambda C: text.clip_bytes(C, 6), "aéébcd", "aé…"),
    (lambda C: text.clip_bytes(C, 4, counted=False, trimmed=True), "ab  cd", "ab…"),
    (lambda C: text.clip_chars(C, 4), "ab cdef", "ab…"),
    (lambda C: text.clip_chars(C, 4, False), "abcdef", "abcd…"),
    (lambda C: text.clean_text(C), "\n﻿a \t\r\nb\0 \n\n", "a\nb"),
    (lambda C: text.tidy_text(C), "a b  \n\n\n\nc ", "a b\n\nc"),
    (lambda C: text.strip_image_data(C), "x ![](data:image/png;base64," + "A" * 120 + ") y", "x ![]((image)) y"),
    (lambda C: text.first_line_title(C), " \n First line \nmore", "First line"),
    (lambda C: text.first_line_title(C), "", "Announcement"),
    (lambda C: text.last_sentinel(C), "x-id: a:1\ntext\nx-id: b:2  ", "b:2"),
    (lambda C: text.unfence(C), "Sure\n```json\n{\"a\": 1}\n```", '{"a": 1}'),
    (lambda C: text.unfence(C), "see [1, 2] ok", "[1, 2]"),
    (lambda C: text.text_format(F.lit("Text/HTML; charset=x"), C), "a.pdf", "html"),
    (lambda C: text.text_format(F.lit(None).cast("string"), C), "a.PPTX", "pptx"),
    (lambda C: text.text_format(F.lit("image/png"), C), "a.png", None),
])
def test_text(spark, column, value, want):
    assert one(spark, column(F.col("s")), value) == want


@pytest.mark.parametrize("value, want", [(45, "45 min"), (60, "1 h"), (150, "2.5 h")])
def test_minutes(spark, value, want):
    assert one(spark, text.minutes_text(F.col("s")), value, "int") == want


@pytest.mark.parametrize("value, want", [
    ("2026-09-21T10:00:00Z", "2026-09-21 10:00:00"), ("2026-09-21T10:00:00.5-0700", "2026-09-21 17:00:00.5"), ("2026-09-21", "2026-09-21 00:00:00"), ("soon", None), ("", None), (None, None),
])
def test_lenient_instants(spark, value, want):
    assert one(spark, times.lenient_instant(F.col("s")).cast("string"), value) == want


@pytest.mark.parametrize("due, assigned, want", [
    ("2026-01-10", None, True), ("2026-01-31", None, True), ("2026-02-01", None, False), ("2026-01-01", None, False), (None, None, True), (None, "2026-01-09", False), (None, "2026-03-01", True),
])
def test_window(spark, due, assigned, want):
    low, high = F.lit("2026-01-10").cast("timestamp"), F.lit("2026-01-31").cast("timestamp")
    row = spark.createDataFrame([(due, assigned)], "d string, a string").select(times.in_window(F.col("d").cast("timestamp"), F.col("a").cast("timestamp"), low, high)).first()
    assert row[0] is want


@pytest.mark.parametrize("state, graded, work, past, want", [
    (None, False, False, False, "not_started"), (None, False, False, True, "missing"), ("RETURNED", True, False, False, "graded"), ("RETURNED", False, False, True, "submitted"),
    ("TURNED_IN", False, True, True, "submitted"), ("RECLAIMED_BY_STUDENT", False, True, True, "in_progress"), ("NEW", False, False, True, "missing"),
])
def test_coursework_states(spark, state, graded, work, past, want):
    due = F.lit("2026-01-01" if past else "2026-12-01").cast("timestamp")
    column = codes.coursework_state(F.col("s"), F.lit(graded), F.lit(work), due, F.lit("2026-06-01").cast("timestamp"))
    assert one(spark, column, state) == want


def test_intervals_and_same_instants(spark):
    assert [one(spark, times.seconds_of(F.col("s")), v) for v in ("36h", "2w", "x", "7d")] == [129600, 1209600, None, 604800]
    assert one(spark, times.same_instant(F.col("s"), F.lit("2026-01-01T02:00:00+02:00")), "2026-01-01T00:00:00Z")
    assert one(spark, times.same_instant(F.col("s"), F.lit(None).cast("string")), None)
