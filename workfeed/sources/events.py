"""Calendar events as work items, one row per occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clip_bytes, one_line
from ..functions.times import at_time, strict_instant, utc_text
from ..state import checkpoint

#: What a calendar published as free/busy calls its events. Fixed values.
PLACEHOLDERS = ("", "busy", "free", "private", "unavailable", "blocked", "(no title)", "untitled")


def event_title(summary: Column, label: Column) -> Column:
    own = F.trim(F.coalesce(summary, F.lit("")))
    named = F.coalesce(blank_to_null(label), F.when(own == "", F.lit("(untitled event)")).otherwise(own))
    return F.when(F.lower(own).isin(*PLACEHOLDERS), named).otherwise(own)


def id_part(key: Column) -> Column:
    """ASCII letters, digits and : - _ @ . stay; anything else is "-"."""
    return F.regexp_replace(F.regexp_replace(key, "[^A-Za-z0-9:_@.-]", "-"), "^-+|-+$", "")


TIME = "STRUCT<dateTime: STRING, date: STRING>"
#: Events as a calendar's listing has them, with the feed they are from.
LISTED = (
    "feed STRING, label STRING, ordinal BIGINT, id STRING, recurringEventId STRING, summary STRING, location STRING, description STRING, status STRING, htmlLink STRING, "
    f"start {TIME}, end {TIME}, attendees ARRAY<STRUCT<self: BOOLEAN, responseStatus: STRING>>"
)


def event_time(t: Column, zone: str = "UTC") -> Column:
    """An instant, or the end of an all-day date in the zone; null where neither can be read."""
    return F.coalesce(strict_instant(t["dateTime"]), at_time(F.try_to_timestamp(t["date"], F.lit("yyyy-MM-dd")).cast("date"), F.lit(""), zone))


def listed_events(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Rows of LISTED as the events that occurrences() takes; declined where the owner's own answer is so."""
    own = F.exists("attendees", lambda a: F.coalesce(a["self"], F.lit(False)) & F.coalesce(a["responseStatus"] == "declined", F.lit(False)))
    all_day = F.coalesce(F.col("start.dateTime"), F.lit("")) == ""
    return rows.select(
        "feed", "label", "ordinal", F.col("id").alias("event_id"), F.col("recurringEventId").alias("series_id"), "summary", "location", "description", "status", F.coalesce(own, F.lit(False)).alias("declined"),
        event_time(F.col("start"), zone).alias("start_at"), event_time(F.col("end"), zone).alias("end_at"), all_day.alias("all_day"), F.col("htmlLink").alias("url"),
    )


def occurrence_key(series: Column, event_id: Column, summary: Column, start: Column) -> Column:
    day = utc_text(start, "yyyyMMdd")
    name = F.lower(F.regexp_replace(F.trim(F.coalesce(summary, F.lit(""))), r"\s+", "-"))
    return F.when(F.coalesce(series, F.lit("")) != "", F.concat(series, F.lit(":"), day)).when(F.coalesce(event_id, F.lit("")) != "", event_id).otherwise(F.concat(name, F.lit(":"), day))


def occurrences(events: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Work items of events that stand: not cancelled, not declined, with a start inside the window.

    events: feed, label, ordinal, event_id, series_id, summary, status, declined,
    start_at, end_at, url. Of rows with the same id the first of the feed counts. By start.
    """
    kept = (F.coalesce("status", F.lit("")) != "cancelled") & ~F.coalesce("declined", F.lit(False)) & F.col("start_at").isNotNull()
    for bound in ([] if low is None else [F.col("start_at") >= low]) + ([] if high is None else [F.col("start_at") <= high]):
        kept = kept & bound
    key = occurrence_key(F.col("series_id"), F.col("event_id"), F.col("summary"), F.col("start_at"))
    rows = events.where(kept).withColumn("id", F.concat(F.lit("gcal:"), F.substring_index("feed", "@", 1), F.lit(":"), id_part(key)))
    first = F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))
    return rows.withColumn("_n", first).where("_n = 1").select(
        "id",
        F.lit("gcal").alias("source"),
        F.lit("announcement").alias("kind"),
        F.col("label").alias("course"),
        F.col("feed").alias("course_id"),
        clip_bytes(event_title(F.col("summary"), F.col("label")), 200, counted=False, trimmed=True).alias("title"),
        "url",
        F.col("start_at").alias("due_at"),
        F.when(F.col("end_at") > F.col("start_at"), F.col("end_at")).alias("ends_at"),
        "ordinal",
    ).orderBy("due_at", "id")


def described(start: Column, end: Column, all_day: Column, location: Column, description: Column, label: Column) -> Column:
    """What an event is, in a line or two: when, where and what it says."""
    clock = F.concat(utc_text(start, " HH:mm"), F.coalesce(F.concat(F.lit("–"), utc_text(end, "HH:mm")), F.lit("")))
    place = F.coalesce(F.concat(F.lit(" · "), clip_bytes(blank_to_null(one_line(location)), 200, counted=False, trimmed=True)), F.lit(""))
    said = F.coalesce(F.concat(clip_bytes(blank_to_null(one_line(description)), 2000, counted=False, trimmed=True), F.lit("\n")), F.lit(""))
    return F.concat(utc_text(start, "EEE d MMM yyyy"), F.when(all_day, F.lit(" (all day)")).otherwise(clock), place, F.lit("\n"), said, F.lit("From the "), label, F.lit(" calendar."))


def capped(rows: DataFrame, per: str, order: list, limit: int) -> DataFrame:
    """rows with act: whether a row is among the first `limit` of its feed; the others are deferred, not dropped.

    order tells the rows of a feed apart, as rows equal to the last one act as well. Each
    task keeps the first `limit` of a feed before they meet, and the last one's place is
    joined back, so that a feed with very many rows is in no single task.
    """
    place = rows.select(F.col(per).alias("_per"), F.struct(*order).alias("_place"))
    n = F.row_number().over(Window.partitionBy("_per").orderBy("_place"))
    last = place.withColumn("_n", n).where(F.col("_n") <= limit).groupBy("_per").agg(F.max("_place").alias("_last"))
    joined = rows.join(checkpoint(last), F.col(per).eqNullSafe(F.col("_per")), "left")
    return joined.withColumn("act", F.when(F.struct(*order) <= F.col("_last"), "act").otherwise("deferred")).drop("_per", "_last")
