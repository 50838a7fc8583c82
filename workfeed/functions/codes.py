"""Code to vocabulary maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _looked_up, short_number

#: The feeds' codes and the unified vocabulary.
PLANNER_KINDS = {
    "assignment": "assignment", "sub_assignment": "assignment", "assessment_request": "assignment", "quiz": "quiz",
    "discussion_topic": "discussion", "wiki_page": "material", "announcement": "announcement",
}
PLANNER_NAMESPACES = {
    "assignment": "assignment", "sub_assignment": "assignment", "assessment_request": "assignment", "quiz": "quiz",
    "discussion_topic": "discussion", "wiki_page": "page", "announcement": "announcement",
}
WORK_KINDS = {"ASSIGNMENT": "assignment", "SHORT_ANSWER_QUESTION": "question", "MULTIPLE_CHOICE_QUESTION": "question"}
LOOSE_KINDS = {
    "assignment": "assignment", "homework": "assignment", "task": "assignment", "quiz": "quiz", "test": "quiz", "exam": "quiz",
    "discussion": "discussion", "announcement": "announcement", "event": "announcement", "note": "announcement",
}
LEGACY_KINDS = {
    "assignment": "assignment", "quiz": "quiz", "discussion_topic": "discussion", "wiki_page": "page", "planner_note": "note",
    "calendar_event": "event", "announcement": "announcement",
}
FINISHED = ("submitted", "graded", "excused")
INFORMATIONAL = ("material", "announcement")


def planner_kind(code: Column) -> Column:
    return F.coalesce(_looked_up(code, PLANNER_KINDS), F.lit("other"))


def planner_namespace(code: Column) -> Column:
    """Its id namespace; "item" for none and itself for an unknown one."""
    given = F.when(F.coalesce(code, F.lit("")) == "", F.lit("item")).otherwise(code)
    return F.coalesce(_looked_up(code, PLANNER_NAMESPACES), given)


def work_kind(code: Column) -> Column:
    return F.coalesce(_looked_up(code, WORK_KINDS), F.lit("other"))


def loose_kind(label: Column) -> Column:
    return F.coalesce(_looked_up(F.lower(F.trim(label)), LOOSE_KINDS), F.lit("material"))


def legacy_kind(code: Column) -> Column:
    return F.coalesce(_looked_up(code, LEGACY_KINDS), code)


def legacy_work_kind(code: Column) -> Column:
    return F.coalesce(_looked_up(code, WORK_KINDS), F.lit("assignment"))


def submission_state(workflow: Column, excused: Column, missing: Column, submitted_at: Column, due: Column, now: Column) -> Column:
    """The state that a submission record says; the date decides only where there is no record."""
    no_record = F.coalesce(workflow, F.lit("")) == ""
    return (
        F.when(excused, "excused")
        .when(workflow == "graded", "graded")
        .when(workflow.isin("submitted", "pending_review"), "submitted")
        .when(missing, "missing")
        .when(submitted_at.isNotNull(), "submitted")
        .when(no_record & (due < now), "missing")
        .otherwise("not_started")
    )


def planner_state(excused: Column, graded: Column, submitted: Column, missing: Column) -> Column:
    return F.when(excused, "excused").when(graded, "graded").when(submitted, "submitted").when(missing, "missing").otherwise("not_started")


def coursework_state(state: Column, graded: Column, has_work: Column, due: Column, now: Column) -> Column:
    """The state of a hand-in; a null state is one that does not exist."""
    return (
        F.when((state == "RETURNED") & graded, "graded")
        .when(state.isin("RETURNED", "TURNED_IN"), "submitted")
        .when(state.isNotNull() & has_work, "in_progress")
        .when(due < now, "missing")
        .otherwise("not_started")
    )


def downstream_state(state: Column) -> Column:
    return F.when(state.isin(*FINISHED), "done").when(state == "in_progress", "in_progress").otherwise("open")


def state_rank(state: Column) -> Column:
    return F.when(state == "in_progress", 1).when(state == "done", 2).otherwise(0)


def legacy_planner_status(excused: Column, graded: Column, submitted: Column, late: Column, missing: Column) -> Column:
    """The flat vocabulary, where lateness takes the place of submitted."""
    return (
        F.when(excused, "excused").when(graded, "graded").when(submitted & late, "late").when(submitted, "submitted").when(missing, "missing").otherwise("todo")
    )


def legacy_coursework_status(state: Column, late: Column, has_grade: Column, due: Column, now: Column) -> Column:
    """The flat vocabulary; a null state is a hand-in that does not exist."""
    return (
        F.when(state.isNull(), "todo")
        .when(state == "RETURNED", F.when(has_grade, "graded").otherwise("submitted"))
        .when(state == "TURNED_IN", F.when(late, "late").otherwise("submitted"))
        .when(due < now, "missing")
        .otherwise("todo")
    )


def grade_text(given: Column, score: Column, points: Column) -> Column:
    """The given grade, else score/points, else the score."""
    both = F.when(points > 0, F.concat(short_number(score), F.lit("/"), short_number(points))).otherwise(short_number(score))
    return F.coalesce(F.when(F.trim(given) != "", given), both)


def assigned_grade(grade: Column, history: Column) -> Column:
    """A grade other than zero, else the points of the latest grade change in history."""
    changes = F.filter(history, lambda h: h["type"] == "ASSIGNED_GRADE_POINTS_EARNED_CHANGE")
    return F.coalesce(F.when(grade != 0, grade), F.when(F.size(changes) > 0, F.element_at(changes, -1)["points"]))


def last_turned_in(state: Column, history: Column, updated: Column) -> Column:
    """The latest hand-in of history, else the last update of what is handed in or returned."""
    times = F.transform(F.filter(history, lambda h: h["type"] == "TURNED_IN"), lambda h: h["at"])
    return F.coalesce(F.array_max(times), F.when(state.isin("TURNED_IN", "RETURNED"), updated))
