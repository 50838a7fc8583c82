"""Change-sets: what a consumer's store must do to hold what the feeds say.

Each is one plan of joins that ends in an action column; nothing is sent. Budgets
keep their remainder as deferred rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.codes import FINISHED, INFORMATIONAL, state_rank
from ..functions.text import clip_chars, last_sentinel
from ..functions.times import day_span, rfc3339, same_instant
from ..state import checkpoint


def flattened(tree: DataFrame) -> DataFrame:
    """Both levels of a listing (row fields and children) as rows; a child has its parent's id."""
    fields = [c for c in tree.columns if c not in ("children", "parent_id")]
    top = tree.select(*fields, F.lit(None).cast("bigint").alias("parent_id"))
    below = tree.select(F.col("id").alias("parent_id"), F.explode("children").alias("c")).select(*(F.col(f"c.{f}").alias(f) for f in fields), "parent_id")
    return top.unionByName(below)


def rebuilt(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Top rows with the array of their children, ordered by id."""
    kids = rows.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("children"))
    top = rows.where("parent_id IS NULL")
    return top.join(kids.withColumnRenamed("parent_id", "_p"), F.col("id") == F.col("_p"), "left").select(*(top[f] for f in fields), "children")


def located(items: DataFrame, listing: DataFrame, state: DataFrame) -> DataFrame:
    """items ⟕ state ⟕ listing row: by external id, else by the sentinel in its notes, else by the remembered number.

    Adds remembered (struct of the state row) and existing (struct of the listing row).
    """
    row = F.struct(*listing.columns)
    keyed = listing.where("coalesce(external_id, '') <> ''").select(F.col("external_id").alias("k"), F.lit(1).alias("prio"), row.alias("existing"))
    keyed = keyed.unionByName(listing.select(last_sentinel(F.col("notes")).alias("k"), F.lit(2).alias("prio"), row.alias("existing")).where("k IS NOT NULL"))
    numbered = state.select(F.col("external_id").alias("k"), F.col("note_id").alias("_n")).join(listing.select(F.col("id").alias("_n"), row.alias("existing")), "_n").select("k", F.lit(3).alias("prio"), "existing")
    best = keyed.unionByName(numbered).groupBy("k").agg(F.min(F.struct("prio", "existing.id", "existing")).alias("m")).select("k", "m.existing")
    known = state.select(F.col("external_id").alias("_id"), F.struct(*state.columns).alias("remembered"))
    return items.join(known, F.col("external_id") == F.col("_id"), "left").join(best, F.col("external_id") == F.col("k"), "left").drop("_id", "k")


def task_actions(
    items: DataFrame, listing: DataFrame, state: DataFrame, include_done: bool = False, include_other: bool = False, owns_description: bool = True
) -> DataFrame:
    """external_id, action, fields, migrated: create, update, unchanged, skip_done, skip_other or declined.

    items: rendered() plus homework. fields names what an update changes; the description
    only where it is owned, external_id where the row was found by its notes. A listing
    whose due_at is text is compared as instants. A row that was pushed and is in the
    listing no longer was declined, and is left so.
    """
    as_text = isinstance(listing.schema["due_at"].dataType, StringType)
    rows = located(items, listing, state)
    e = lambda c: F.col(f"existing.{c}")
    differs = {
        "title": ~e("title").eqNullSafe(F.col("title")),
        "description": F.lit(owns_description) & ~e("description").eqNullSafe(F.col("description")),
        "notes": ~e("notes").eqNullSafe(F.col("notes")),
        "state": ~e("state").isin("done", "dropped") & (state_rank(F.col("state")) > state_rank(e("state"))),
        "due_at": e("parent_id").isNull() & ~(same_instant(e("due_at"), rfc3339(F.col("due_at"))) if as_text else e("due_at").eqNullSafe(F.col("due_at"))),
        "url": ~e("url").eqNullSafe(F.col("url")),
        "external_id": F.coalesce(e("external_id"), F.lit("")) == "",
    }
    changed = F.filter(F.array(*(F.when(d, F.lit(c)) for c, d in differs.items())), lambda c: c.isNotNull())
    found, known = F.col("existing").isNotNull(), F.col("remembered").isNotNull()
    create = F.when((F.col("state") == "done") & F.lit(not include_done), "skip_done").when(F.col("homework").eqNullSafe(F.lit(False)) & F.lit(not include_other), "skip_other").otherwise("create")
    action = F.when(found, F.when(F.size(changed) > 0, "update").otherwise("unchanged")).when(known, "declined").otherwise(create)
    return rows.select(
        "external_id",
        action.alias("action"),
        F.when(found, F.array_join(changed, ",")).otherwise("").alias("fields"),
        (found & (F.coalesce(e("external_id"), F.lit("")) == "")).alias("migrated"),
        e("id").alias("note_id"),
        "content_hash",
        "state",
    )


def next_state(state: DataFrame, actions: DataFrame, stamp: Column, dry_run: bool = False) -> DataFrame:
    """The state after the actions were carried out: created and found rows with their hash, others as they were; as it was after a dry run."""
    if dry_run:
        return state
    done = actions.where(F.col("action").isin("create", "update", "unchanged")).select(
        "external_id", "note_id", stamp.alias("created_at"), F.col("state").alias("last_pushed_state"), F.col("content_hash").alias("hash")
    )
    return state.join(done.select("external_id"), "external_id", "left_anti").select(done.columns).unionByName(done)


def tally(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"), F.count_if("migrated").alias("n_migrated"))


#: The counters of a run by the change-set they come from and its outcomes. Fixed values.
COUNTERS = {
    "task": {"create": "created", "update": "updated", "unchanged": "unchanged", "skip_done": "skipped_done", "skip_other": "skipped_not_homework", "declined": "skipped_declined"},
    "brief": {"send": "briefed", "unchanged": "brief_unchanged", "dropped": "brief_dropped", "failed": "brief_failed", "deferred": "brief_deferred"},
    "calendar": {"write": "calendar_written", "unchanged": "calendar_unchanged", "withdraw": "calendar_removed", "declined": "calendar_declined", "deferred": "calendar_deferred"},
    "inbox": {
        "remembered": "inbox_remembered", "nothing": "inbox_nothing", "task": "inbox_task", "unchanged": "inbox_unchanged", "retry": "inbox_failed", "deferred": "inbox_deferred",
    },
}


def run_counters(outcomes: DataFrame) -> DataFrame:
    """(counter, n) of a run's outcomes (part, outcome), each counter once, 0 where nothing was counted; migrated is an outcome of tasks as well."""
    names = [(part, o, c) for part, table in COUNTERS.items() for o, c in table.items()] + [("task", "migrated", "migrated")]
    counters = outcomes.sparkSession.createDataFrame(names, "part string, outcome string, counter string")
    # As many rows as there are counters.
    counted = outcomes.join(F.broadcast(counters), ["part", "outcome"]).groupBy("counter").agg(F.count("*").alias("n"))
    return counters.select("counter").join(counted, "counter", "left").select("counter", F.coalesce("n", F.lit(0)).alias("n"))


def pressing(rows: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """rows with pressing: live (open or in progress) and overdue or due within so many hours of now."""
    soon = F.col("due_at") < now + F.expr(f"INTERVAL '{hours}' HOUR")
    return rows.withColumn("pressing", F.coalesce(F.col("state").isin("open", "in_progress") & soon, F.lit(False)))


def is_task(items: DataFrame, listing: DataFrame, state: DataFrame, key: str = "id") -> DataFrame:
    """items with is_task: whether the listing or the state has them by their external id."""
    there = listing.select(F.col("external_id").alias("_t")).unionByName(state.select(F.col("external_id").alias("_t"))).where("_t <> ''").distinct()
    return items.join(there, items[key] == there["_t"], "left").withColumn("is_task", F.col("_t").isNotNull()).drop("_t")


def any_event(items: DataFrame, state: DataFrame) -> DataFrame:
    """One row: whether a run has any dated event, or remembers any, so that the calendar is read at all."""
    event = (F.col("source") == "gcal") & F.col("due_at").isNotNull()
    both = items.select(event.alias("e"), F.lit(False).alias("r")).unionByName(state.select(F.lit(False).alias("e"), F.lit(True).alias("r")))
    found = both.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for c, name in (("e", "any_event"), ("r", "any_remembered"))))
    return found.withColumn("reads_calendar", F.col("any_event") | F.col("any_remembered"))


def inbox_actions(rows: DataFrame, most: int, order: list) -> DataFrame:
    """rows (id, context_hash, sent_hash, outcome) with action: promote what was answered as a task, unchanged where the text is, send within the budget, else deferred."""
    promote, same = F.coalesce(F.col("outcome") == "task", F.lit(False)), F.col("context_hash").eqNullSafe(F.col("sent_hash"))
    sent = budgeted(rows, ~promote & ~same, order, most, "_act")
    return sent.withColumn("action", F.when(promote, "promote").when(same, "unchanged").otherwise(F.col("_act"))).drop("_act")


def route(source: Column, kind: Column, due: Column, is_task: Column) -> Column:
    """Where an item goes: calendar for dated events, inbox for information that is no task yet, else task."""
    return F.when((source == "gcal") & due.isNotNull(), "calendar").when(kind.isin(*INFORMATIONAL) & ~is_task, "inbox").otherwise("task")


def budgeted(rows: DataFrame, wants: Column, order: list, limit: int, action: str = "action") -> DataFrame:
    """rows with action: send for the first `limit` that want to, deferred for the others that do, else skip.

    The first are found by a top-k, so no single task sees all rows.
    """
    tagged = rows.withColumn("_w", F.coalesce(wants, F.lit(False)))
    head = tagged.where("_w").orderBy(*order).limit(limit).select(F.col("id").alias("_id"))
    # At most `limit` rows.
    joined = tagged.join(F.broadcast(head), F.col("id") == F.col("_id"), "left")
    out = F.when(~F.col("_w"), "skip").when(F.col("_id").isNotNull(), "send").otherwise("deferred")
    return joined.withColumn(action, out).drop("_w", "_id")


def stop_after_refusal(rows: DataFrame, refused: Column, per: list[str], order: list) -> DataFrame:
    """rows with attempted: false for all that come after the first refusal of their group.

    The first refusals are pre-aggregated minima, one row a group that has any.
    """
    place = F.struct(*order)
    first = checkpoint(rows.where(refused).groupBy(*(F.col(c).alias(f"_{c}") for c in per)).agg(F.min(place).alias("_first")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in per]
    joined = rows.join(first, reduce(lambda a, b: a & b, same), "left")
    return joined.withColumn("attempted", F.col("_first").isNull() | (place <= F.col("_first"))).drop("_first", *(f"_{c}" for c in per))


def brief_wanted(state: Column, note_state: Column, context_hash: Column, brief_hash: Column) -> Column:
    """A row in the store that is done in neither place and whose context has moved."""
    return note_state.isNotNull() & ~state.isin(*FINISHED) & (note_state != "done") & ~context_hash.eqNullSafe(brief_hash)


def inbox_wanted(context_hash: Column, sent_hash: Column, outcome: Column) -> Column:
    return ~context_hash.eqNullSafe(sent_hash) & ~F.coalesce(outcome == "task", F.lit(False))


#: What an answered call leaves in the state. Fixed values.
def outcome_state(status: Column, outcome: Column) -> Column:
    return (
        F.when(status.between(200, 299) & (outcome == "task"), "task")
        .when(status.between(200, 299), "remembered")
        .when(status.isin(409, 410, 422), "rejected")
        .otherwise("retry")
    )


def calendar_entries(items: DataFrame, kind: str = "busy") -> DataFrame:
    """external_id, title, kind, on_date, start_time, end_time, entry_hash and valid of dated events.

    An entry lives on the day it starts; valid is false where nothing is left of its time.
    """
    start, end = day_span(F.col("due_at"), F.col("ends_at"))
    title = clip_chars(F.coalesce(F.when(F.trim("title") != "", F.trim("title")), F.lit("Event")), 120)
    rows = items.where("source = 'gcal' AND due_at IS NOT NULL").select(
        F.col("id").alias("external_id"), title.alias("title"), F.lit(kind).alias("kind"), F.date_format(start, "yyyy-MM-dd").alias("on_date"),
        F.date_format(start, "HH:mm").alias("start_time"), F.date_format(end, "HH:mm").alias("end_time"),
    )
    joined = F.concat_ws("\0", "title", "kind", F.lit("false"), "start_time", "end_time", "on_date", F.lit(""), F.lit(""))
    return rows.withColumns({"entry_hash": F.substring(F.sha2(joined, 256), 1, 32), "valid": F.col("start_time") < F.col("end_time")})


def calendar_actions(entries: DataFrame, state: DataFrame, listing: DataFrame | None, most: int) -> DataFrame:
    """external_id, action over live and remembered entries: write, unchanged, declined, deferred, withdraw or forget.

    entries without any time left (not valid) are not live. state: external_id, hash,
    declined; listing: external_id of entries that are there. Without a listing, where it
    could not be read, remembered entries count as there.
    """
    live = entries.where("valid").select("external_id", "on_date", "start_time", "entry_hash")
    known = state.select(F.col("external_id").alias("_s"), "hash", "declined")
    all_ = live.join(known, F.col("external_id") == F.col("_s"), "full").withColumn("id", F.coalesce("external_id", "_s"))
    if listing is not None:
        there = listing.select(F.col("external_id").alias("_l"))
        all_ = all_.join(there, F.col("id") == F.col("_l"), "left")
    is_live, is_known = F.col("external_id").isNotNull(), F.col("_s").isNotNull()
    is_there = is_known if listing is None else F.col("_l").isNotNull()
    base = (
        F.when(is_live & is_known & (F.col("declined") | ~is_there), "declined")
        .when(is_live & is_known & (F.col("hash") == F.col("entry_hash")), "unchanged")
        .when(is_live, "write")
        .when(F.col("declined"), "keep")
        .when(is_there, "withdraw")
        .otherwise("forget")
    )
    capped = budgeted(all_.withColumn("base", base), F.col("base") == "write", [F.col("on_date"), F.col("start_time"), F.col("id")], most, "_cap")
    action = F.when((F.col("base") == "write") & (F.col("_cap") == "deferred"), "deferred").otherwise(F.col("base"))
    return capped.where("base <> 'keep'").select(F.col("id").alias("external_id"), action.alias("action"))
