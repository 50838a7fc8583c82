"""The earlier flat table: one row per (source, source_id), with its own vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import absolute_url, blank_to_null
from ..functions.times import from_parts, rfc3339
from .planner import first_of, flags_of

COLUMNS = ["source", "source_id", "course", "title", "kind", "due_at", "status", "points", "url", "fetched_at"]
#: What is still owed. Fixed values.
OWED = ("todo", "missing", "late")


def planner_homework(rows: DataFrame, courses: DataFrame, base: str, fetched_at: Column) -> DataFrame:
    """Planner rows flat; a course by its code, else by the row's context name, else by its number."""
    p, flags = F.col("plannable"), flags_of(F.col("submissions"))
    names = courses.select(F.col("id").alias("course_id"), F.coalesce(blank_to_null(F.col("course_code")), "name").alias("course_name"))
    url = absolute_url(F.col("html_url"), base)
    kind = F.coalesce("plannable_type", F.lit("assignment"))
    return rows.join(names, "course_id", "left").select(
        F.lit("canvas").alias("source"),
        F.concat_ws(":", kind, F.col("plannable_id").cast("string")).alias("source_id"),
        F.coalesce("course_name", "context_name", F.col("course_id").cast("string"), F.lit("")).alias("course"),
        F.coalesce(blank_to_null(p["title"]), blank_to_null(p["name"]), F.lit("(untitled)")).alias("title"),
        codes.legacy_kind(kind).alias("kind"),
        F.coalesce(p["due_at"], "plannable_date").alias("due_at"),
        codes.legacy_planner_status(flags["excused"], flags["graded"], flags["submitted"], flags["late"], flags["missing"]).alias("status"),
        p["points_possible"].alias("points"),
        F.when(url != "", url).alias("url"),
        fetched_at.alias("fetched_at"),
    )


def classroom_homework(work: DataFrame, handed: DataFrame, courses: DataFrame, now: Column, fetched_at: Column) -> DataFrame:
    """Course work ⟕ hand-ins, flat. handed: courseWorkId, state, late, assignedGrade; courses: id, name."""
    d, t = F.col("dueDate"), F.col("dueTime")
    due = from_parts(d["year"], d["month"], d["day"], t["hours"], t["minutes"])
    subs = first_of(handed, ["courseWorkId"], [F.col("ordinal") if "ordinal" in handed.columns else F.lit(0), F.col("state")]).select(F.col("courseWorkId").alias("_work"), F.col("state").alias("_state"), F.col("late").alias("_late"), F.col("assignedGrade").alias("_grade"))
    names = courses.select(F.col("id").alias("courseId"), F.col("name").alias("course"))
    joined = work.join(subs, work["id"] == subs["_work"], "left").join(names, "courseId", "left")
    status = codes.legacy_coursework_status(F.col("_state"), F.coalesce("_late", F.lit(False)), F.col("_grade").isNotNull(), due, now)
    return joined.select(
        F.lit("classroom").alias("source"),
        F.concat_ws(":", "courseId", "id").alias("source_id"),
        "course",
        F.coalesce(blank_to_null(F.col("title")), F.lit("(untitled)")).alias("title"),
        codes.legacy_work_kind(F.col("workType")).alias("kind"),
        rfc3339(due).alias("due_at"),
        status.alias("status"),
        F.col("maxPoints").alias("points"),
        F.col("alternateLink").alias("url"),
        fetched_at.alias("fetched_at"),
    )


def upserted(table: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("source", "source_id"), order: str = "fetched_at") -> DataFrame:
    """The last written row of each key as a whole: the largest order value, and of equals the one from rows."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def owed(homework: DataFrame) -> DataFrame:
    """What is still owed, soonest first and undated last."""
    return homework.where(F.col("status").isin(*OWED)).orderBy(F.col("due_at").isNull(), "due_at")
