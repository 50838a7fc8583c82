"""Planner rows, course listings and details of one learning system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import absolute_url, blank_to_null
from ..functions.times import in_window, lenient_instant
from ..schema import WORK_ITEM

FLAGS = "excused BOOLEAN, graded BOOLEAN, submitted BOOLEAN, late BOOLEAN, missing BOOLEAN"
PLANNER = (
    "course_id BIGINT, context_name STRING, plannable_type STRING, plannable_id BIGINT, plannable_date STRING, html_url STRING, submissions STRING, "
    "plannable STRUCT<title: STRING, name: STRING, due_at: STRING, todo_date: STRING, created_at: STRING, unlock_at: STRING, points_possible: DOUBLE>"
)
LISTING = (
    "id BIGINT, course_id BIGINT, name STRING, description STRING, due_at STRING, unlock_at STRING, created_at STRING, points_possible DOUBLE, "
    "html_url STRING, quiz_id BIGINT, discussion_topic STRUCT<id: BIGINT>"
)
COURSE = "id BIGINT, name STRING, course_code STRING"
#: Not work. Fixed values.
SKIPPED = ("planner_note", "calendar_event")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A landed JSON array, or JSON lines of it, under an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The unified table from its JSON export."""
    return spark.read.schema(WORK_ITEM).option("multiLine", False).json(path)


def flags_of(submissions: Column) -> Column:
    """The flags where the field is an object; false, null and other shapes have none."""
    return F.when(F.ltrim(submissions).startswith("{"), F.from_json(submissions, FLAGS))


def display_name(name: Column, code: Column) -> Column:
    return F.coalesce(blank_to_null(name), code)


def planner_stubs(rows: DataFrame, base: str = "") -> DataFrame:
    """id, kind, course_id, title, url, due_at, assigned_at, points and state of the rows that are work; links are under base."""
    p = F.col("plannable")
    flags = flags_of(F.col("submissions"))
    return rows.where(F.col("plannable_id").isNotNull() & (F.col("plannable_id") != 0) & ~F.coalesce("plannable_type", F.lit("")).isin(*SKIPPED)).select(
        F.concat_ws(":", F.lit("canvas"), codes.planner_namespace(F.col("plannable_type")), F.col("plannable_id").cast("string")).alias("id"),
        codes.planner_kind(F.col("plannable_type")).alias("kind"),
        "course_id",
        F.coalesce(blank_to_null(p["title"]), blank_to_null(p["name"])).alias("title"),
        F.coalesce(F.when(F.col("html_url") != "", absolute_url(F.col("html_url"), base)), web_url(base, F.col("plannable_type"), F.col("course_id"), F.col("plannable_id"))).alias("url"),
        F.coalesce(lenient_instant(p["due_at"]), lenient_instant(p["todo_date"]), lenient_instant(F.col("plannable_date"))).alias("due_at"),
        F.coalesce(lenient_instant(p["unlock_at"]), lenient_instant(p["created_at"])).alias("assigned_at"),
        p["points_possible"].alias("points"),
        codes.planner_state(flags["excused"], flags["graded"], flags["submitted"], flags["missing"]).alias("state"),
    )


def listing_stubs(rows: DataFrame, low: Column) -> DataFrame:
    """The same of a course's listing: undated rows stay, dated ones from low on; quiz_id and topic_id as well."""
    due = lenient_instant(F.col("due_at"))
    return rows.where(due.isNull() | (due >= low)).select(
        F.concat_ws(":", F.lit("canvas"), F.lit("assignment"), F.col("id").cast("string")).alias("id"),
        F.lit("assignment").alias("kind"),
        "course_id",
        blank_to_null(F.col("name")).alias("title"),
        F.col("html_url").alias("url"),
        due.alias("due_at"),
        F.coalesce(lenient_instant(F.col("unlock_at")), lenient_instant(F.col("created_at"))).alias("assigned_at"),
        F.col("points_possible").alias("points"),
        F.lit("not_started").alias("state"),
        "quiz_id",
        F.col("discussion_topic.id").alias("topic_id"),
    )


def without_shadows(listing: DataFrame, planner: DataFrame) -> DataFrame:
    """listing without the rows that stand for a quiz or a discussion which planner has itself."""
    ids = planner.select(F.col("id").alias("other"))
    quiz = F.concat(F.lit("canvas:quiz:"), F.col("quiz_id").cast("string"))
    topic = F.concat(F.lit("canvas:discussion:"), F.col("topic_id").cast("string"))
    return listing.join(ids, quiz == ids["other"], "left_anti").join(ids, topic == ids["other"], "left_anti")


def merged(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Full outer join on the key; the first's values stand and the second's fill its nulls."""
    a, b = first.alias("a"), second.alias("b")
    columns = [c for c in first.columns if c != key]
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return joined.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in second.columns else F.col(f"a.{c}") for c in columns),
    )


def overlaid(stubs: DataFrame, details: DataFrame) -> DataFrame:
    """stubs ⟕ details on id: title and url replaced where the detail has one, due_at and points filled,
    assigned_at replaced for assignments and quizzes and filled for the rest."""
    s, d = stubs.alias("s"), details.alias("d")
    own = F.col("s.kind").isin("assignment", "quiz")
    new = {
        "title": F.coalesce(blank_to_null(F.col("d.title")), F.col("s.title")),
        "url": F.coalesce(blank_to_null(F.col("d.url")), F.col("s.url")),
        "due_at": F.coalesce("s.due_at", "d.due_at"),
        "points": F.coalesce("s.points", "d.points"),
        "assigned_at": F.when(own, F.coalesce("d.assigned_at", "s.assigned_at")).otherwise(F.coalesce("s.assigned_at", "d.assigned_at")),
    }
    return s.join(d, F.col("s.id") == F.col("d.id"), "left").select(*(new.get(c, F.col(f"s.{c}")).alias(c) for c in stubs.columns))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_course_names(rows: DataFrame, courses: DataFrame) -> DataFrame:
    """rows ⟕ courses (id, name, course_code) on course_id: course is the display name, else the id."""
    names = courses.select(F.col("id").alias("_c"), display_name(F.col("name"), F.col("course_code")).alias("_name"))
    joined = rows.join(names, rows["course_id"] == names["_c"], "left")
    return joined.select(*(rows[c] for c in rows.columns), F.coalesce("_name", F.col("course_id").cast("string")).alias("course"))


def web_url(base: str, kind: Column, course_id: Column, native_id: Column) -> Column:
    """The page of an object by its type code, for rows without a link."""
    part = (
        F.when(kind == "quiz", "/quizzes/").when(kind.isin("discussion_topic", "announcement"), "/discussion_topics/").when(kind == "wiki_page", "/pages/")
        .when(kind.isin("assignment", "sub_assignment", "assessment_request"), "/assignments/")
    )
    course = F.concat(F.lit(base.rstrip("/") + "/courses/"), F.coalesce(course_id, F.lit(0)).cast("string"))
    return F.coalesce(F.concat(course, part, native_id.cast("string")), course)


def file_name(display: Column, name: Column, file_id: Column) -> Column:
    """A file's display name, else its name, else one of its id."""
    return F.coalesce(F.when(display != "", display), F.when(name != "", name), F.concat(F.lit("file-"), file_id.cast("string")))


def file_version(updated: Column, modified: Column, size: Column, most_text: int, most_bytes: int) -> Column:
    """What a file's extracted text is valid for; empty where there is no time stamp, so that it is never reused."""
    u, m = F.coalesce(updated, F.lit("")), F.coalesce(modified, F.lit(""))
    return F.when((u == "") & (m == ""), "").otherwise(F.concat_ws("|", u, m, F.coalesce(size, F.lit(0)).cast("string"), F.lit(str(most_text)), F.lit(str(most_bytes))))


def wanted(rows: DataFrame, sources: tuple[str, ...] = ()) -> DataFrame:
    """rows of the given sources; of all if none is given."""
    return rows.where(F.col("source").isin(*sources)) if sources else rows


def fetch_counts(rows: DataFrame) -> DataFrame:
    """(source, kind, n, n_dated, n_files): what a fetch brought. rows: source, kind, due_at, n_files."""
    return rows.groupBy("source", "kind").agg(F.count("*").alias("n"), F.count("due_at").alias("n_dated"), F.sum("n_files").cast("bigint").alias("n_files"))


def windowed(rows: DataFrame, low: Column | None, high: Column | None) -> DataFrame:
    return rows.where(in_window(F.col("due_at"), F.col("assigned_at"), low, high))
