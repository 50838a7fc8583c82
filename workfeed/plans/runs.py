"""Named queries over whole runs: feeds gathered, kept, answered and sent, with what a later run finds of an earlier one."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import state
from ..functions import text, times
from ..keyed import KeyedTable
from ..operators import briefs, extract, memo, render, sinks
from ..sources import classroom, documents, fetch, ics, planner, schedule
from ..sources import events as calendar
from ..state import new_folder
from ..streaming import streams
from . import bindings as b
from . import landed
from . import queries as q

# -- feeds -------------------------------------------------------------------------------------


def _planner_feed(spark, sf_dir):
    rows, errors = fetch.landed_pages(spark, landed._planner_path(spark, sf_dir), planner.PLANNER)
    return fetch.with_progress(planner.with_course_names(planner.planner_stubs(rows, landed.BASE), landed._courses(spark, sf_dir))), errors


def _classroom_feed(spark, sf_dir):
    """Course work and what is told beside it; one page of the announcements is cut off."""
    rows = landed._work_rows(spark, sf_dir)
    parts = {
        "courseWork": rows.where("kind NOT IN ('material', 'announcement')"), "courseWorkMaterial": rows.where("kind = 'material'"), "announcements": rows.where("kind = 'announcement'"),
    }
    paths = {field: landed._landed(spark, part, "ordinal", ["ordinal"], field) for field, part in parts.items()}
    spark.range(1).select(F.lit('{"announcements": [{"courseId": "1", "id": "2", "text": "cut').alias("value")).write.mode("append").text(paths["announcements"])
    handed, order = landed._hand_in_rows(spark, sf_dir)
    paths["studentSubmissions"] = landed._landed(spark, handed, "ordinal", ["ordinal", *order], "studentSubmissions")
    read = {field: fetch.landed_pages(spark, path, classroom.LISTS[field], field) for field, path in paths.items()}
    work = classroom.with_progress(classroom.coursework(read["courseWork"][0]), classroom.hand_ins(read["studentSubmissions"][0]), q._now())
    told = classroom.materials(read["courseWorkMaterial"][0]).unionByName(classroom.announcements(read["announcements"][0]))
    errors = None
    for _, found in read.values():
        errors = found if errors is None else errors.unionByName(found)
    return fetch.with_progress(work.unionByName(told, allowMissingColumns=True)), errors


def _calendar_feed(spark, sf_dir):
    rows, errors = fetch.landed_pages(spark, landed._calendar_path(spark, sf_dir), calendar.LISTED, place="place")
    return landed._occurrences(rows), errors


def _document_feed(spark, sf_dir):
    docs = landed._answered_documents(spark, sf_dir)
    path = landed._landed(spark, docs.select("doc_id", F.to_json(F.struct(*docs.columns)).alias("json")), "doc_id", ["doc_id"])
    rows, errors = fetch.landed_pages(spark, path, ", ".join(f"{c} {kind}" for c, kind in docs.dtypes))
    shaped = rows.withColumn("entries", schedule.parsed_entries(F.col("answer")))
    found = schedule.rows_of(shaped)
    return found.unionByName(schedule.whole_documents(shaped, found), allowMissingColumns=True), errors


def _gathered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Four feeds, one with a broken page, and a fifth that is not there."""
    gone = new_folder(spark, "landed")
    feeds = [
        fetch.Feed("canvas", lambda: _planner_feed(spark, sf_dir)),
        fetch.Feed("classroom", lambda: _classroom_feed(spark, sf_dir)),
        fetch.Feed("gdoc", lambda: _document_feed(spark, sf_dir)),
        fetch.Feed("gcal", lambda: _calendar_feed(spark, sf_dir)),
        fetch.Feed("canvas", lambda: fetch.landed_pages(spark, gone, planner.COURSE)),
    ]
    return fetch.gathered(spark, feeds)


def fetched_table(spark, sf_dir):
    """What all landed feeds have, as one table of work items."""
    items, _ = _gathered(spark, sf_dir)
    return items.select(
        "id", "source", "kind", "course", "course_id", "title", "url", times.rfc3339(F.col("due_at")).alias("due_at"), times.rfc3339(F.col("assigned_at")).alias("assigned_at"), "points",
        F.md5(F.coalesce("description", F.lit(""))).alias("description"), F.coalesce(F.size("attachments"), F.lit(0)).cast("bigint").alias("n_files"), "progress.state", "progress.grade",
    )


def fetch_errors(spark, sf_dir):
    """What of the feeds could not be read."""
    _, errors = _gathered(spark, sf_dir)
    return errors.select("source", F.col("file").isNotNull().alias("one_file"), "error")


# -- stores ------------------------------------------------------------------------------------


def homework_store(spark, sf_dir):
    """The earlier flat table kept in buckets: a first load, changes to a few keys, and the same changes once more."""
    old = q._homework(spark, sf_dir)
    few = F.col("source_id").cast("bigint") % 997 == 0
    changed = old.where(few).withColumns({"status": F.lit("submitted"), "fetched_at": F.expr("fetched_at + INTERVAL '1' DAY")})
    stale = old.where("CAST(source_id AS BIGINT) % 991 = 0").withColumns({"status": F.lit("old"), "fetched_at": F.expr("fetched_at - INTERVAL '1' DAY")})
    table = KeyedTable(new_folder(spark, "homework"), old.schema, ("source", "source_id"), "fetched_at", buckets=64)
    for rows in (old, changed.unionByName(stale), changed):
        table.merge(rows)
    return table.read(spark).select("source", "source_id", "title", "status", "due_at", "fetched_at")


def stream_from_snapshot(spark, sf_dir):
    """Rows of a stream whose hash differs from the user's last one, the first of each user's compared with an earlier run's table."""
    root, rows = new_folder(spark, "stream"), q._event_rows(spark, sf_dir)
    half = rows.agg(F.floor((F.min("n") + F.max("n")) / 2)).first()[0] or 0
    before, after = rows.where(F.col("n") < half), rows.where(F.col("n") >= half)
    known = KeyedTable(f"{root}/known", rows.schema, ("id",), "n", buckets=8)
    known.merge(before)
    changed = streams.changed_only(streams.replay(after, f"{root}/in", "n"), "n", ttl="30 days", known=known.read(spark)).select("id", "hash", "n")
    changed.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType(changed.schema.fields)).parquet(f"{root}/out")


def state_import(spark, sf_dir):
    """What the last run remembered, kept as JSON maps; one file is cut off, and a second state is missing."""
    root = new_folder(spark, "state")
    rows = b.bound(spark, sf_dir, b.SYNC_STATE)
    held = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("external_id", F.struct("note_id", "created_at", "last_pushed_state", "hash"))))))
    pages = max(1, -(-rows.count() // landed.PAGE_ROWS))
    rows.groupBy(F.pmod(F.xxhash64("external_id"), F.lit(pages))).agg(held.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/a")
    spark.range(1).select(F.lit('{"canvas:0": {"note_id": 7').alias("value")).write.mode("append").text(f"{root}/a")
    shape = "note_id BIGINT, created_at STRING, last_pushed_state STRING, hash STRING"
    known, errors = state.read_map(spark, f"{root}/a", shape, "external_id")
    none, missing = state.read_map(spark, f"{root}/b", shape, "external_id")
    told = errors.unionByName(missing).select(F.concat(F.lit("error: "), "error").alias("external_id"), F.lit(None).cast("long").alias("note_id"), F.lit("").alias("created_at"), F.lit("").alias("last_pushed_state"))
    return known.unionByName(none).select("external_id", "note_id", "created_at", "last_pushed_state").unionByName(told)


# -- change-sets -------------------------------------------------------------------------------


def action_log(spark, sf_dir):
    """Change-sets of tasks and of the calendar, filed by run and action; the tasks' run is written twice, the second time without what it would leave as it is."""
    path = new_folder(spark, "actions")
    tasks = q._actions(spark, sf_dir).select("external_id", "action")
    sinks.write_actions(tasks, path, "tasks")
    sinks.write_actions(q.calendar_actions(spark, sf_dir).select("external_id", "action"), path, "calendar")
    sinks.write_actions(tasks.where("action <> 'unchanged'"), path, "tasks")
    return sinks.read_actions(spark, path).select("run", "action", "external_id")


# -- answers -----------------------------------------------------------------------------------


def _shout(run: int):
    """A function as a user gives it: it answers in capitals and its run's number, and cannot take some prompts."""

    def call(prompts: pd.Series) -> pd.Series:
        if prompts.str.endswith("13").any():
            raise ValueError("unlucky")
        return f"{run}:" + prompts.str.upper()

    return call


def answer_cycle(spark, sf_dir):
    """Two runs of a user's function over the items' titles: the second asks what the first left, what has changed and is due, and nothing that stands."""
    items = q._items(spark, sf_dir).select("id", "ordinal", F.col("title").alias("prompt"), memo.input_hash("title").alias("input_hash"), F.lit(True).alias("due"))
    now, later = F.expr(b.NOW).cast("timestamp"), F.expr(f"{b.NOW} + INTERVAL '2' DAY").cast("timestamp")
    none = spark.createDataFrame([], "id string, input_hash string, answer string, seen_at timestamp")
    _, known = memo.completed(items, none, _shout(1), now, "'30' DAY", [F.col("ordinal")], 2000)
    known = state.checkpoint(known)
    changed = F.col("ordinal") % 3 == 0
    parsed_at = F.expr(f"{b.NOW} - INTERVAL '1' HOUR * CAST(ordinal % 5 AS INT)").cast("timestamp")
    due = memo.reread_due(F.col("input_hash"), memo.input_hash("prompt"), parsed_at, F.lit(50 * 3600), later)
    moved = items.withColumn("prompt", F.when(changed, F.concat("prompt", F.lit(" again"))).otherwise(F.col("prompt"))).withColumn("due", due)
    moved = moved.withColumn("input_hash", memo.input_hash("prompt"))
    out, _ = memo.completed(moved, known, _shout(2), later, "'30' DAY", [F.col("ordinal")], 3000)
    return out.select("id", "outcome", "answer", "error")


def briefed_tasks(spark, sf_dir):
    """Descriptions with what a validated brief says of the item."""
    n = F.col("ordinal")
    answer = F.concat(F.lit('```json\n{"homework": true, "summary": "'), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("Do "), "title")), F.lit('", "steps": "one", "estimate_min": "'), (n % 700).cast("string"), F.lit('"}\n```'))
    brief = briefs.validated(answer)
    items = q._with_attachments(spark, sf_dir).withColumns({"summary": F.when(brief["valid"], brief["summary"]), "estimate_min": F.when(brief["valid"], brief["estimate_min"])})
    return items.select("id", F.md5(render.description()).alias("description"), text.minutes_text(F.col("estimate_min")).alias("estimate"))


# -- files -------------------------------------------------------------------------------------


def _office(kind: str, lines: list[str], whole: bool) -> bytes:
    """A text document with a paragraph a line, or slides of ten lines each, or of more where that would be over 20 slides; the last part of one that is not whole breaks off after its last line."""
    out = io.BytesIO()
    coded = [escape(x) for x in lines]
    with zipfile.ZipFile(out, "w") as z:
        # A ZipInfo of its own, for its fixed date, would be stored unpacked.
        put = lambda name, body: z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
        if kind == "docx":
            body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{x}</w:t></w:r></w:p>' for x in coded)
            put("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}' + ("</w:body></w:document>" if whole else "<w:p><w:r &"))
        else:
            step = max(10, -(-len(coded) // 20))
            for n in range(0, len(coded), step):
                body = "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in coded[n : n + step])
                put(f"ppt/slides/slide{n}.xml", f'<p:sld xmlns:p="p" xmlns:a="a">{body}</p:sld>')
    return out.getvalue()


#: Files of a folder, about.
FOLDER_FILES = 1000


def office_files(spark, sf_dir):
    """Documents written as text documents, slides, plain and unknown files and read back from their bytes, some of them damaged or too large."""
    docs = q._table(spark, sf_dir, "documents").select("doc_id", "text")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, body in zip(batch["doc_id"], batch["text"], strict=True):
                # Long ones are plain, so that which files are too large is told by their texts.
                kind = ("docx", "pptx", "txt", "bin")[i % 4 if len((body or "").encode()) <= 20_000 else 2 + i % 2]
                lines = (body or "").split("\n")
                half = lines[: len(lines) // 2] if i % 7 == 0 else lines
                rows.append((f"{i}.{kind}", _office(kind, half, i % 7 != 0) if kind in ("docx", "pptx") else (body or "").encode()))
            yield pd.DataFrame(rows, columns=["name", "content"])

    # Some 1,000 files a folder, each of which one task lists: a list of all of them would be in the driver's memory.
    folder, n = new_folder(spark, "files"), max(1, -(-docs.count() // FOLDER_FILES))
    place = F.concat(F.pmod(F.xxhash64("name"), F.lit(n)).cast("string"), F.lit("/"), "name")
    sinks.write_files(docs.mapInPandas(made, "name string, content binary").withColumn("name", place), folder)
    read = extract.read_folders(spark.range(0, n, 1, n).select(F.concat(F.lit(f"{folder}/"), F.col("id").cast("string")).alias("folder")), ceiling=30_000)
    found = extract.files_to_text(read, limit=1 << 20, ceiling=30_000)
    name = F.substring_index("path", "/", -1)
    return found.select(name.alias("name"), "format", F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text"), "error", "truncated")


def due_texts(spark, sf_dir):
    """Documents that have changed since an earlier run and are past their interval, read from the days on which they landed."""
    path = new_folder(spark, "texts")
    n = F.col("doc_id")
    docs = q._table(spark, sf_dir, "documents").select("doc_id", F.date_add(F.lit("1998-05-01").cast("date"), (n % 20).cast("int")).alias("landed_on"), "text")
    documents.land_texts(docs, path)
    versioned = documents.with_text_version(docs)
    known = versioned.where(n % 7 > 0).select("doc_id", F.when((n % 20 == 4) | (n % 20 == 9), "older").otherwise(F.col("version")).alias("version"), F.expr(f"{b.NOW} - INTERVAL '1' HOUR * CAST(doc_id % 11 AS INT)").cast("timestamp").alias("parsed_at"))
    listed = versioned.where((n % 7 > 0) | (n % 20 == 2)).select("doc_id", "version", F.lit(4 * 3600).alias("interval_seconds"), "landed_on")
    due = state.checkpoint(documents.due_documents(listed, known, F.expr(b.NOW).cast("timestamp")))
    return documents.texts_of(due, path).select("doc_id", "version", F.date_format("landed_on", "yyyy-MM-dd").alias("landed_on"), F.md5("text").alias("digest"))


def zoned_events(spark, sf_dir):
    """iCalendar events with a named zone, without one in a feed that has one, and all-day ones."""
    rows = b.bound(spark, sf_dir, b.EVENTS)
    n, local = F.col("ordinal"), F.date_format("start_at", "yyyyMMdd'T'HHmmss")
    start = F.when(n % 3 == 0, F.concat(F.lit(";TZID=America/New_York:"), local)).when(n % 3 == 1, F.concat(F.lit(";VALUE=DATE:"), F.date_format("start_at", "yyyyMMdd"))).otherwise(F.concat(F.lit(":"), local))
    body = F.concat(F.lit("BEGIN:VCALENDAR\nX-WR-TIMEZONE:Europe/Paris\nBEGIN:VEVENT\nUID:"), n.cast("string"), F.lit("\nDTSTART"), start, F.lit("\nEND:VEVENT\nEND:VCALENDAR\n"))
    found = ics.events(rows.select("feed", body.alias("body")))
    return found.select(F.col("event_id").cast("bigint").alias("uid"), times.rfc3339(F.col("start_at")).alias("start_at"), "all_day")


NAMES = ["fetched_table", "fetch_errors", "homework_store", "stream_from_snapshot", "state_import", "action_log", "answer_cycle", "briefed_tasks", "office_files", "due_texts", "zoned_events"]
QUERIES = {name: globals()[name] for name in NAMES}
