"""Course work, materials, announcements and hand-ins of a second learning system, as landed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import blank_to_null, first_line_title
from ..functions.times import from_parts, strict_instant
from .planner import first_of

DRIVE = "STRUCT<id: STRING, title: STRING, alternateLink: STRING>"
MATERIALS = (
    f"ARRAY<STRUCT<driveFile: STRUCT<driveFile: {DRIVE}>, link: STRUCT<url: STRING, title: STRING>, youtubeVideo: {DRIVE}, "
    "form: STRUCT<formUrl: STRING, title: STRING>>>"
)
WORK = (
    "courseId STRING, id STRING, title STRING, description STRING, text STRING, state STRING, alternateLink STRING, creationTime STRING, scheduledTime STRING, "
    f"dueDate STRUCT<year: INT, month: INT, day: INT>, dueTime STRUCT<hours: INT, minutes: INT, seconds: INT>, maxPoints DOUBLE, workType STRING, materials {MATERIALS}"
)
ATTACHMENTS = f"ARRAY<STRUCT<driveFile: {DRIVE}, link: STRUCT<url: STRING, title: STRING>, youTubeVideo: {DRIVE}, form: STRUCT<formUrl: STRING, title: STRING>>>"
HAND_IN = (
    "courseId STRING, courseWorkId STRING, id STRING, state STRING, late BOOLEAN, assignedGrade DOUBLE, updateTime STRING, "
    f"assignmentSubmission STRUCT<attachments: {ATTACHMENTS}>, shortAnswerSubmission STRUCT<answer: STRING>, multipleChoiceSubmission STRUCT<answer: STRING>, "
    "submissionHistory ARRAY<STRUCT<stateHistory: STRUCT<state: STRING, stateTimestamp: STRING>, "
    "gradeHistory: STRUCT<gradeChangeType: STRING, pointsEarned: DOUBLE, maxPoints: DOUBLE>>>"
)
#: The wrapping field of each listing.
LISTS = {"courseWork": WORK, "courseWorkMaterial": WORK, "announcements": WORK, "studentSubmissions": HAND_IN}


def read_list(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One row per element of a landed listing, with its place there as ordinal."""
    rows = spark.read.schema(f"{field} ARRAY<STRUCT<{_nested(LISTS[field])}>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode(field).alias("ordinal", "x")).select("x.*", "ordinal")


def _nested(ddl: str) -> str:
    """Top-level "name TYPE" pairs as the fields of a struct."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


def attachments_of(materials: Column) -> Column:
    """Teacher materials as attachments; of each the first shape that is there."""

    def one(m: Column) -> Column:
        drive, video, link, form = m["driveFile"]["driveFile"], m["youtubeVideo"], m["link"], m["form"]
        return F.struct(
            F.coalesce(drive["title"], link["title"], video["title"], form["title"]).alias("name"),
            F.coalesce(drive["alternateLink"], link["url"], video["alternateLink"], form["formUrl"]).alias("url"),
        )

    return F.coalesce(F.transform(materials, one), F.array().cast("array<struct<name:string,url:string>>"))


def handed_files(attachments: Column) -> Column:
    """A hand-in's files in the shape of attachments_of(); they name the same kinds without the materials' wrapping."""
    none = F.lit(None).cast(DRIVE)
    return attachments_of(
        F.transform(attachments, lambda a: F.struct(F.struct(F.coalesce(a["driveFile"], none).alias("driveFile")).alias("driveFile"), a["link"].alias("link"), a["youTubeVideo"].alias("youtubeVideo"), a["form"].alias("form")))
    )


def course_name(name: Column, section: Column, heading: Column, course_id: Column) -> Column:
    return F.coalesce(blank_to_null(name), blank_to_null(section), blank_to_null(heading), course_id)


def file_version(version: Column, modified: Column, checksum: Column, limit: int, most_bytes: int | None = None) -> Column:
    """What a drive file's text is valid for; empty where nothing is known of its version."""
    v, m, c = F.coalesce(version, F.lit(0)), F.coalesce(modified, F.lit("")), F.coalesce(checksum, F.lit(""))
    limits = [F.lit(str(limit))] + ([] if most_bytes is None else [F.lit(str(most_bytes))])
    return F.when((v == 0) & (m == "") & (c == ""), "").otherwise(F.concat_ws("|", v.cast("string"), m, c, *limits))


def _published(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("state", F.lit("PUBLISHED")) == "PUBLISHED")


def _assigned() -> Column:
    return F.coalesce(strict_instant(F.col("scheduledTime")), strict_instant(F.col("creationTime")))


def coursework(rows: DataFrame) -> DataFrame:
    d, t = F.col("dueDate"), F.col("dueTime")
    return _published(rows).select(
        F.concat_ws(":", F.lit("classroom"), "courseId", "id").alias("id"),
        codes.work_kind(F.col("workType")).alias("kind"),
        F.col("courseId").alias("course_id"),
        F.col("id").alias("work_id"),
        "title",
        F.col("alternateLink").alias("url"),
        from_parts(d["year"], d["month"], d["day"], t["hours"], t["minutes"], t["seconds"]).alias("due_at"),
        _assigned().alias("assigned_at"),
        F.when(F.col("maxPoints") > 0, F.col("maxPoints")).alias("points"),
        "description",
        attachments_of(F.col("materials")).alias("attachments"),
    )


def materials(rows: DataFrame) -> DataFrame:
    return _informational(rows, "material", F.col("title"), F.col("description"))


def announcements(rows: DataFrame) -> DataFrame:
    return _informational(rows, "announcement", first_line_title(F.col("text")), F.col("text"))


def _informational(rows: DataFrame, kind: str, title: Column, body: Column) -> DataFrame:
    return _published(rows).select(
        F.concat_ws(":", F.lit("classroom"), "courseId", F.lit(kind), "id").alias("id"),
        F.lit(kind).alias("kind"),
        F.col("courseId").alias("course_id"),
        title.alias("title"),
        F.col("alternateLink").alias("url"),
        F.lit(None).cast("timestamp").alias("due_at"),
        _assigned().alias("assigned_at"),
        F.lit(None).cast("double").alias("points"),
        body.alias("description"),
        attachments_of(F.col("materials")).alias("attachments"),
    )


def hand_ins(rows: DataFrame) -> DataFrame:
    """state, grade, has_work, turned_in_at, late and files of each hand-in, by course and work; of several the first in the listing (ordinal, then id)."""
    short, choice = F.col("shortAnswerSubmission.answer"), F.col("multipleChoiceSubmission.answer")
    files = F.coalesce(F.size("assignmentSubmission.attachments"), F.lit(0))
    grades = F.transform(F.filter("submissionHistory", lambda h: h["gradeHistory"].isNotNull()), lambda h: F.struct(h["gradeHistory"]["gradeChangeType"].alias("type"), h["gradeHistory"]["pointsEarned"].alias("points")))
    states = F.transform(F.filter("submissionHistory", lambda h: h["stateHistory"].isNotNull()), lambda h: F.struct(h["stateHistory"]["state"].alias("type"), strict_instant(h["stateHistory"]["stateTimestamp"]).alias("at")))
    place = F.col("ordinal") if "ordinal" in rows.columns else F.lit(0)
    return first_of(rows, ["courseId", "courseWorkId"], [place, F.col("id")]).select(
        F.col("courseId").alias("course_id"),
        F.col("courseWorkId").alias("work_id"),
        "state",
        F.coalesce("late", F.lit(False)).alias("late"),
        codes.assigned_grade(F.col("assignedGrade"), grades).alias("grade"),
        ((files > 0) | (F.coalesce(short, F.lit("")) != "") | (F.coalesce(choice, F.lit("")) != "")).alias("has_work"),
        codes.last_turned_in(F.col("state"), states, strict_instant(F.col("updateTime"))).alias("turned_in_at"),
        handed_files(F.col("assignmentSubmission.attachments")).alias("files"),
    )


def with_progress(work: DataFrame, handed: DataFrame, now: Column) -> DataFrame:
    """work ⟕ hand-ins (one for each course and work), with state, grade text, turned_in_at, late and the files handed in."""
    joined = work.join(handed, ["course_id", "work_id"], "left")
    state = codes.coursework_state(F.col("state"), F.col("grade").isNotNull(), F.coalesce("has_work", F.lit(False)), F.col("due_at"), now)
    text = F.when(F.col("grade").isNotNull(), codes.grade_text(F.lit(None).cast("string"), F.col("grade"), F.coalesce("points", F.lit(0.0)))).when(F.col("state") == "RETURNED", F.lit("returned"))
    return joined.select(*work.columns, state.alias("state"), text.alias("grade"), "turned_in_at", F.coalesce("late", F.lit(False)).alias("late"), F.coalesce("files", F.array().cast("array<struct<name:string,url:string>>")).alias("files"))
