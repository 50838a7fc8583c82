"""The unified table: one row per work item, from whatever feed."""

from __future__ import annotations

from pyspark.sql import types as T

#: Types by the names that struct() takes.
TYPES = {
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """"a STRING, b INT" as a schema; unlike DDL parsing it needs no session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


ATTACHMENT = struct(
    "name STRING, url STRING, mime_type STRING, size_bytes BIGINT, content STRING, content_error STRING, truncated BOOLEAN"
)
PROGRESS = T.StructType(
    [
        *struct("state STRING, submitted_at TIMESTAMP, late BOOLEAN, grade STRING, text STRING").fields,
        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    ]
)
ENRICHMENT = struct(
    "homework BOOLEAN, skip_reason STRING, summary STRING, deliverable STRING, steps ARRAY<STRING>, requirements ARRAY<STRING>, estimate_min INT, model STRING"
)
WORK_ITEM = T.StructType(
    [
        *struct(
            "id STRING, source STRING, kind STRING, course STRING, course_id STRING, title STRING, url STRING, "
            "assigned_at TIMESTAMP, due_at TIMESTAMP, ends_at TIMESTAMP, points DOUBLE, description STRING"
        ).fields,
        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
        T.StructField("progress", PROGRESS),
        T.StructField("enrichment", ENRICHMENT),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

SOURCES = ("canvas", "classroom", "gdoc", "gcal")
KINDS = ("assignment", "quiz", "discussion", "material", "question", "announcement", "other")
STATES = ("not_started", "in_progress", "submitted", "graded", "missing", "excused")
