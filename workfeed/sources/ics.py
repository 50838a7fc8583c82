"""iCalendar files as event rows, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(feed, body): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("feed"), F.col("value").alias("body"))


def unfolded(body: Column) -> Column:
    """Lines joined with their continuations."""
    return F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), "\n[ \t]", "")


def value_of(block: Column, name: str) -> Column:
    """A property's value, or null."""
    return F.regexp_extract_all(block, F.lit(rf"(?im)^{name}(?:;[^:\n]*)?:([^\n]*)$"), F.lit(1))


def _last(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def unescaped(s: Column) -> Column:
    """Escaped commas, semicolons, line feeds and backslashes as themselves, each escape read once."""
    held = F.replace(s, F.lit("\\\\"), F.lit("\0"))
    for escape, plain in (("\\n", "\n"), ("\\N", "\n"), ("\\,", ","), ("\\;", ";")):
        held = F.replace(held, F.lit(escape), F.lit(plain))
    return F.replace(held, F.lit("\0"), F.lit("\\"))


def _instant(block: Column, name: str, zone: Column) -> Column:
    """struct(at, all_day) of a date-time property: UTC, in a named or the feed's zone (which stands in for an unknown one), or a bare date (its end of day)."""
    value = F.trim(_last(value_of(block, name)))
    params = F.regexp_extract(block, rf"(?im)^{name}(;[^:\n]*)?:", 1)
    named = F.regexp_extract(params, r'(?i);TZID="?([^;:"]+)', 1)
    place = F.when(named != "", named).otherwise(zone)
    local = lambda s, z: F.try_to_timestamp(F.concat(s, F.lit(" "), z), F.lit("yyyyMMdd'T'HHmmss VV"))
    all_day = params.rlike("(?i)VALUE=DATE(;|$)") | value.rlike(r"^\d{8}$")
    at = (
        F.when(all_day, local(F.concat(value, F.lit("T235900")), zone))
        .when(value.endswith("Z"), local(F.regexp_replace(value, "Z$", ""), F.lit("UTC")))
        .otherwise(F.coalesce(local(value, place), local(value, zone)))
    )
    return F.struct(at.alias("at"), F.coalesce(all_day, F.lit(False)).alias("all_day"))


def events(feeds: DataFrame, zone: str = "UTC") -> DataFrame:
    """The events of (feed, body) rows that have a start, by start.

    The feed's time zone applies to the whole file. A recurrence rule is not expanded;
    it is told at the end of the description.
    """
    rows = feeds.select("feed", unfolded(F.col("body")).alias("body"))
    named = _last(value_of(F.col("body"), "X-WR-TIMEZONE"))
    blocks = rows.select(
        "feed",
        F.coalesce(F.trim(named), F.lit(zone)).alias("zone"),
        unescaped(_last(value_of(F.col("body"), "X-WR-CALNAME"))).alias("label"),
        F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))).alias("ordinal", "block"),
    )
    block = F.col("block")
    rule = F.transform(value_of(block, "RRULE"), lambda r: F.concat(F.lit("Repeats: "), unescaped(r)))
    text = F.array_join(F.filter(F.concat(F.array(unescaped(_last(value_of(block, "DESCRIPTION")))), rule), lambda x: x.isNotNull()), "\n")
    found = blocks.select(
        "feed",
        "label",
        "ordinal",
        _last(value_of(block, "UID")).alias("event_id"),
        unescaped(_last(value_of(block, "SUMMARY"))).alias("summary"),
        unescaped(_last(value_of(block, "LOCATION"))).alias("location"),
        F.trim(text).alias("description"),
        F.lower(_last(value_of(block, "STATUS"))).alias("status"),
        _last(value_of(block, "URL")).alias("url"),
        _instant(block, "DTSTART", F.col("zone")).alias("s"),
        _instant(block, "DTEND", F.col("zone")).alias("e"),
    )
    return found.where("s.at IS NOT NULL").select(
        "feed", "label", "ordinal", "event_id", F.lit(None).cast("string").alias("series_id"), "summary", "location", "description", "status", "url",
        F.col("s.at").alias("start_at"), F.col("s.all_day").alias("all_day"), F.col("e.at").alias("end_at"), F.lit(False).alias("declined"),
    ).orderBy("start_at", "feed", "ordinal")
