"""Work items as the texts a downstream store holds. Dates are absolute, so that hashes stand still."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import downstream_state
from ..functions.text import SENTINEL, attachment_line, clip_bytes, minutes_text, one_line, short_number
from ..functions.times import rfc3339, utc_text

TITLE_BYTES, TEXT_BYTES, ATTACHMENT_BYTES = 480, 15 * 1024, 6 * 1024


def when_text(t: Column) -> Column:
    return utc_text(t, "EEE MMM d HH:mm")


def _given(s: Column) -> Column:
    return F.when(F.coalesce(F.trim(s), F.lit("")) != "", s)


def title(course_prefix: bool = True) -> Column:
    own = F.coalesce(_given(one_line(F.col("title"))), F.lit("(untitled)"))
    course = _given(one_line(F.col("course")))
    return clip_bytes(F.when(course.isNotNull(), F.concat(course, F.lit(" — "), own)).otherwise(own) if course_prefix else own, TITLE_BYTES)


def kind_line() -> Column:
    points = F.when(F.col("points").isNotNull(), F.concat(F.lit(" · "), short_number(F.col("points")), F.lit(" pts")))
    return F.concat(F.lit("Kind: "), "kind", F.coalesce(points, F.lit("")))


def description(brief: bool = True) -> Column:
    """The description block of items with attachments (array of name, url, content) and, with brief, summary and estimate_min."""
    lines = F.transform("attachments", lambda a: F.concat(F.lit("- "), attachment_line(a["name"], a["url"])))
    told = F.concat(F.lit("\n"), F.trim("description"))
    parts = [
        F.concat(F.lit("Due: "), F.coalesce(when_text(F.col("due_at")), F.lit("none"))),
        F.concat(F.lit("Course: "), _given(F.col("course"))),
        kind_line(),
    ]
    if brief:
        parts += [F.concat(F.lit("Estimate: ~"), minutes_text(F.col("estimate_min")))]
    parts += [F.concat(F.lit("Link: "), _given(F.col("url")))]
    if brief:
        parts += [F.concat(F.lit("\n"), _given(F.col("summary")))]
        told = F.when(F.col("summary").isNotNull(), F.concat(F.lit("\nFrom the teacher:\n"), F.trim("description"))).otherwise(told)
    parts += [
        F.when(_given(F.col("description")).isNotNull(), told),
        F.when(F.size("attachments") > 0, F.concat(F.lit("\nAttachments:\n"), F.array_join(lines, "\n"))),
    ]
    return clip_bytes(F.concat_ws("\n", *parts), TEXT_BYTES, "\n…")


def progress_line() -> Column:
    return F.concat_ws(
        ", ",
        F.concat(F.lit("Progress: "), "state"),
        F.concat(F.lit("grade "), _given(F.col("grade"))),
        F.concat(F.lit("submitted "), when_text(F.col("submitted_at"))),
        F.when(F.col("late"), F.lit("late")),
    )


def _texts(files: Column, label: str) -> Column:
    """The extracted texts of files, each under a heading and clipped."""
    return F.transform(
        F.filter(files, lambda a: F.coalesce(F.trim(a["content"]), F.lit("")) != ""),
        lambda a: F.concat(F.lit(f"\n--- {label}: "), a["name"], F.lit(" ---\n"), clip_bytes(F.trim(a["content"]), ATTACHMENT_BYTES, "\n…")),
    )


def notes(description_here: Column | None = None, handed_text: Column | None = None, handed: Column | None = None) -> Column:
    """Progress, what was handed in, texts and, last even where the rest is cut, the line with the id.

    handed_text is the text of a hand-in, handed its files (name, url, content). Where
    another writer owns the description, its text stands here and the handouts are left out.
    """
    parts = [progress_line()] if description_here is None else [F.concat(description_here, F.lit("\n\n"), progress_line())]
    if handed_text is not None:
        parts.append(F.concat(F.lit("Submitted text:\n"), _given(F.trim(handed_text)), F.lit("\n")))
    if handed is not None:
        lines = F.transform(handed, lambda a: F.concat(F.lit("- "), attachment_line(a["name"], a["url"]), F.lit("\n")))
        parts += [F.when(F.size(handed) > 0, F.concat(F.lit("Submitted files:\n"), F.array_join(lines, ""))), _given(F.array_join(_texts(handed, "Your file"), "\n"))]
    if description_here is None:
        parts.append(F.array_join(_texts(F.col("attachments"), "Handout"), "\n"))
    body = F.concat_ws("\n", *parts)
    body = F.regexp_replace(body, "\n+$", "")
    tail = F.concat(F.lit("\n" + SENTINEL), "id")
    # The id's bytes are taken off the limit; ids are ASCII.
    room = F.lit(TEXT_BYTES) - F.octet_length(tail)
    return F.when(F.octet_length(body) <= room, F.concat(body, tail)).otherwise(F.concat(clip_bytes(body, TEXT_BYTES - 256, "\n…"), tail))


def context() -> Column:
    """What an item says apart from what changes without it: no due date, link or progress."""
    texts = F.transform(
        "attachments",
        lambda a: F.when(F.coalesce(F.trim(a["content"]), F.lit("")) == "", F.concat(F.lit("\n--- Attachment (no text extracted): "), a["name"], F.lit(" ---\n"))).otherwise(
            F.concat(F.lit("\n--- Attachment: "), a["name"], F.lit(" ---\n"), clip_bytes(F.trim(a["content"]), 6 * 1024), F.lit("\n"))
        ),
    )
    told = F.when(_given(F.col("description")).isNotNull(), F.concat(F.lit("Description:\n"), clip_bytes(F.trim("description"), 8 * 1024))).otherwise(F.lit("Description: (none)"))
    head = F.concat_ws("\n", F.concat(F.lit("Course: "), _given(F.col("course"))), kind_line(), F.concat(F.lit("Title: "), F.trim("title")), told)
    return clip_bytes(F.concat(head, F.lit("\n"), F.array_join(texts, "")), 32 * 1024)


def inbox_context() -> Column:
    """context() with the date it was posted before the title, so that what the text calls tomorrow can be told."""
    posted = F.concat(F.lit("\nPosted: "), utc_text(F.col("assigned_at"), "EEE MMM d yyyy HH:mm"), F.lit(" UTC"))
    placed = F.regexp_replace(context(), F.lit(r"(?s)^(.*?)\nTitle: "), F.concat(F.lit("$1"), F.coalesce(posted, F.lit("")), F.lit("\nTitle: ")))
    # Bound to a name, so that the long text is made once and not wherever the clip looks at it.
    return F.get(F.transform(F.array(placed), lambda s: clip_bytes(s, 32 * 1024)), F.lit(0))


def rendered(items: DataFrame, owned: bool = True) -> DataFrame:
    """external_id, title, description, notes, state, due_at, url and content_hash of items.

    owned says whether the description is ours; where another writer owns it, it is empty and its text stands in the notes.
    """
    told = description(False)
    out = items.select(
        F.col("id").alias("external_id"), title().alias("title"), (told if owned else F.lit("")).alias("description"), (notes() if owned else notes(told)).alias("notes"),
        downstream_state(F.col("state")).alias("state"), "due_at", F.coalesce("url", F.lit("")).alias("url"),
    )
    return out.withColumn("content_hash", content_hash())


def content_hash() -> Column:
    due = F.coalesce(rfc3339(F.col("due_at")), F.lit(""))
    return F.sha2(F.concat_ws("|", "title", "description", "notes", "state", due, "url"), 256)
