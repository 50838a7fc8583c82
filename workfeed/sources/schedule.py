"""Schedule documents: parsed rows as work items, whole documents else, and expansion of schedule-like items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..functions.text import blank_to_null, clip_bytes, slug, unfence
from ..functions.times import at_time, utc_text
from ..schema import struct
from ..state import checkpoint
from .planner import first_of

ENTRIES = T.ArrayType(struct("date STRING, due_date STRING, time STRING, kind STRING, title STRING, description STRING"))


def parsed_entries(answer: Column) -> Column:
    """The rows of an answer, fenced or not, as an array or under "entries"; null for junk."""
    plain = unfence(answer)
    wrapped = F.from_json(plain, T.StructType([T.StructField("entries", ENTRIES)]))["entries"]
    return F.when(plain.startswith("["), F.from_json(plain, ENTRIES)).otherwise(wrapped)


def rows_of(docs: DataFrame, zone: str = "UTC") -> DataFrame:
    """Work items of docs (doc_id, course, url, entries): rows with a date and a title, the first of each id."""
    rows = docs.select("doc_id", "course", "url", F.posexplode("entries").alias("ordinal", "e")).select("doc_id", "course", "url", "ordinal", "e.*")
    day = F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date")
    due_day = F.coalesce(F.try_to_timestamp("due_date", F.lit("yyyy-MM-dd")).cast("date"), day)
    title = clip_bytes(F.trim("title"), 200, counted=False, trimmed=True)
    kept = rows.withColumns({"day": day, "due_day": due_day, "title": title}).where("day IS NOT NULL AND title <> ''")
    made = kept.select(
        F.concat(F.lit("gdoc:"), "doc_id", F.lit(":"), F.date_format("due_day", "yyyy-MM-dd"), F.lit("-"), slug(F.col("title"))).alias("id"),
        "doc_id", "ordinal", codes.loose_kind(F.col("kind")).alias("kind"), "course", "title", "url",
        at_time(F.col("due_day"), F.col("time"), zone).alias("due_at"), "description",
    )
    return first_of(made, ["id"], [F.col("ordinal")])


#: What is said of a document that is told as a whole, and of one that was cut.
WHOLE = "Course calendar document, not broken into rows.\n\n"
CUT_OFF = "\n\n[cut off at the extraction size limit]"


def whole_documents(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One item for each document (doc_id, name, course, url, text, truncated) that gave no row; without the last column no document counts as cut."""
    notice = F.when(F.col("truncated"), F.lit(CUT_OFF)).otherwise("") if "truncated" in docs.columns else F.lit("")
    return docs.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select(
        F.concat(F.lit("gdoc:"), "doc_id").alias("id"),
        F.lit("material").alias("kind"),
        "course",
        F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.lit("Course calendar")).alias("title"),
        "url",
        F.concat(F.lit(WHOLE), clip_bytes(F.trim("text"), 6000, counted=False, trimmed=True), notice).alias("description"),
    )


def looks_like_schedule(kind: Column, title: Column) -> Column:
    return kind.isin(*codes.INFORMATIONAL) & F.contains(F.lower(title), F.lit("calendar"))


def joined_text(description: Column, contents: Column) -> Column:
    """Description and attachment texts as one document."""
    texts = F.filter(F.concat(F.array(description), contents), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    return F.array_join(texts, "\n\n")


def row_description(description: Column, document: Column, due: Column) -> Column:
    """A row's own words, and which document and date they come from."""
    own = F.concat(clip_bytes(blank_to_null(description), 2000, counted=False, trimmed=True), F.lit("\n\n"))
    name = F.coalesce(F.when(document != "", document), F.lit("the course calendar"))
    return F.concat(F.coalesce(own, F.lit("")), F.lit("From "), name, F.lit(", row dated "), utc_text(due, "EEE d MMM yyyy"), F.lit("."))


def chunk_prompt(course: Column, name: Column, text: Column, part: Column, parts: Column, truncated: Column, today: Column) -> Column:
    """What a part of a document is asked with."""
    several = F.when(parts > 1, F.concat(F.lit("This is part "), (part + 1).cast("string"), F.lit(" of "), parts.cast("string"), F.lit(" of the document.\n")))
    short = F.when(truncated, F.lit("The document was cut off at a size limit; parse what is here.\n"))
    head = F.concat(F.lit("Course: "), F.coalesce(course, F.lit("")), F.lit("\nDocument: "), F.coalesce(name, F.lit("")), F.lit("\nToday: "), utc_text(today, "yyyy-MM-dd (EEEE)"), F.lit("\n"))
    return F.concat(head, F.coalesce(several, F.lit("")), F.coalesce(short, F.lit("")), F.lit("\nCalendar document:\n---\n"), text, F.lit("\n---\n"))


def pointing_at(items: DataFrame, configured: DataFrame) -> DataFrame:
    """(id): items (id, urls) of which some URL contains a doc_id of configured.

    A seed of each id, as long as the shortest id, meets the pieces of that length of a URL by
    equality, and what met is looked through for the whole id. Of an id's pieces the seed is the one
    that fewest ids have, so that a common beginning joins nothing.
    """
    ids = configured.select("doc_id").where("doc_id <> ''").distinct()
    n = ids.agg(F.min(F.length("doc_id"))).first()[0] or 1

    def pieces(c: str) -> Column:
        last = F.length(c) - (n - 1)
        return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    cut = ids.select("doc_id", F.explode(pieces("doc_id")).alias("seed"))
    shared = cut.groupBy("seed").agg(F.count("*").alias("n_ids"))
    seeds = checkpoint(cut.join(shared, "seed").groupBy("doc_id").agg(F.min_by("seed", F.struct("n_ids", "seed")).alias("seed")))
    urls = items.select("id", F.explode(F.array_distinct(F.filter("urls", lambda u: u.isNotNull()))).alias("u"))
    met = urls.select("id", "u", F.explode(pieces("u")).alias("seed")).join(seeds, "seed")
    return met.where(F.contains("u", F.col("doc_id"))).select("id").distinct()


def expand(items: DataFrame, found: DataFrame, configured: DataFrame, least_bytes: int = 200) -> tuple[DataFrame, DataFrame]:
    """(kept, rows): schedule-like items replaced by the rows found in them.

    items: id, kind, title, description, contents, urls (its own and its attachments');
    found: id (of the item) and the columns of its rows; configured: doc_id of documents
    that are read for themselves. An item long enough to hold rows, one of whose URLs
    contains such an id, goes; one without rows, or too short to hold any, stays.
    """
    outcomes = expansion(items, found, configured, least_bytes)
    kept = outcomes.where("outcome NOT IN ('expanded', 'configured')").select("id")
    expanded = outcomes.where("outcome = 'expanded'").select("id")
    return items.join(kept, "id", "left_semi"), found.join(expanded, "id", "left_semi")


def expansion(items: DataFrame, found: DataFrame, configured: DataFrame, least_bytes: int = 200) -> DataFrame:
    """(id, outcome): other for items that are no schedule, else short, configured, expanded or failed. See expand()."""
    text = joined_text(F.col("description"), F.col("contents"))
    like = F.coalesce(looks_like_schedule(F.col("kind"), F.col("title")), F.lit(False))
    tagged = items.select("id", "urls", like.alias("_like"), F.coalesce(F.octet_length(text) >= least_bytes, F.lit(False)).alias("_long"))
    ours = pointing_at(tagged.where("_like AND _long"), configured).select("id", F.lit(True).alias("_ours"))
    rows = found.select("id").distinct().withColumn("_rows", F.lit(True))
    outcome = F.when(~F.col("_like"), "other").when(~F.col("_long"), "short").when(F.col("_ours"), "configured").when(F.col("_rows"), "expanded").otherwise("failed")
    return tagged.join(ours, "id", "left").join(rows, "id", "left").select("id", outcome.alias("outcome"))


def expansion_tally(outcomes: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: found, expanded, rows, skipped and failed of expansion() and the rows of expand()."""
    return outcomes.select("outcome").unionByName(rows.select(F.lit("row").alias("outcome"))).agg(
        F.count_if(~F.col("outcome").isin("other", "row")).alias("found"), F.count_if(F.col("outcome") == "expanded").alias("expanded"), F.count_if(F.col("outcome") == "row").alias("rows"),
        F.count_if(F.col("outcome").isin("short", "configured")).alias("skipped"), F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
