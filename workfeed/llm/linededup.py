"""Line dedup by winnowing over line hashes.

A document is a sequence of lines. The unit of repetition is a run: consecutive
lines with at least `min_words` words together. Around every line there are two
shortest such runs, one that starts and one that ends with it; these are the
windows. A line that has the words by itself is a window of its own, and a text with
fewer words, but not none, is one window as a whole. Each window selects its smallest
line hash (the last of equals) as its fingerprint, so two places that repeat a run
always select the same line in it.

Selected positions meet by an equality join on the line hash; what occurs once ends
there, which is most of a corpus. From each position that met, the match is extended
to both sides as far as its windows reach: windows that are equal line by line (by a
128-bit digest) are one repeated run, whose earliest place stays, and all later
places are deleted. Windows of a longer repeat overlap, so together they extend it
to its ends. Positions meet their earliest alone, as minima that are pre-aggregated
in each task: no pair of later places is formed, and a passage in a third of all
documents is one row per task before it is shuffled, and split by size where it is
joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, free_name

#: Words that a run has at least; shorter lines recur in natural text by chance.
MIN_WORDS = 6


def windows(counts: list[int], min_words: int) -> list[tuple[int, int]]:
    """The shortest runs (first, last line) of at least min_words words that start or end with each line; all lines where all have fewer."""
    if 0 < sum(counts) < min_words:
        return [(0, len(counts) - 1)]
    out: set[tuple[int, int]] = set()
    end, total = 0, 0
    for start, n in enumerate(counts):
        while end < len(counts) and total < min_words:
            total += counts[end]
            end += 1
        if total < min_words:
            break
        out.add((start, end - 1))
        total -= n
    start, total = len(counts), 0
    for end in range(len(counts) - 1, -1, -1):
        while start > 0 and total < min_words:
            start -= 1
            total += counts[start]
        if total < min_words:
            break
        out.add((start, end))
        total -= counts[end]
    return sorted(out)


def _places(min_words: int, digests: bool):
    """Rows of selected positions (mark, key, tag, at), or with digests of the windows that select them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        line_hash, wide_hash = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            owner, marks, ats, firsts, lasts, digest = [], [], [], [], [], []
            for row, text in enumerate(batch["body"]):
                lines = (text or "").split("\n")
                coded = [x.encode("utf-8", "replace") for x in lines]
                hashes = [line_hash(x) - (1 << 63) for x in coded]
                seen = -1
                for first, last in windows([len(x.split()) for x in lines], min_words):
                    pick = first if first == last else min(range(first, last + 1), key=lambda i: (hashes[i], -i))
                    if digests:
                        firsts.append(first)
                        lasts.append(last)
                        digest.append(wide_hash(coded[first] if first == last else b"\n".join(coded[first : last + 1])))
                    elif pick == seen:
                        continue
                    seen = pick
                    owner.append(row)
                    marks.append(hashes[pick])
                    ats.append(pick)
            out = batch[["key", "tag"]].iloc[owner].reset_index(drop=True).assign(mark=marks)
            yield out.assign(first=firsts, last=lasts, digest=digest) if digests else out.assign(at=ats)

    return run


def repeated_lines(documents: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, groups: DataFrame | None = None) -> DataFrame:
    """(key, tag, first, last): line ranges, from 0 and inclusive, that repeat an earlier run.

    tag is the XXH64 of the row's text (a null one as empty), so rows that share a key
    and differ in text are told apart. A place is later than another if (key, tag, line
    number) is larger, nulls first; rows that repeat a key and a text are one document.
    A null or empty text has no runs. Words are cut at white space. A run inside one
    document that repeats an earlier one of it is reported as well, but for the lines
    that both share.

    groups (node, component) tells which texts, as tags, are near copies. A run whose
    earliest place is in a near copy of its own text, or in an equal one, is then not
    reported: as a whole such a document is for near-duplicate detection to judge, which
    would not know it any more by the lines that are left.
    """
    docs = documents.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("tag"), F.col(text).cast("string").alias("body"))
    own = [T.StructField("key", docs.schema["key"].dataType), T.StructField("tag", T.LongType()), T.StructField("mark", T.LongType())]
    line = T.IntegerType()
    spots = docs.mapInPandas(_places(min_words, False), T.StructType([*own, T.StructField("at", line)]))
    spot = F.struct("key", "tag", "at")
    # Written, so that the joins below can split what many places share.
    shared = checkpoint(spots.groupBy("mark").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("mark"))
    reach = docs.mapInPandas(_places(min_words, True), T.StructType([*own, T.StructField("first", line), T.StructField("last", line), T.StructField("digest", T.BinaryType())]))
    met = checkpoint(reach.join(shared, "mark").drop("mark"))
    order = F.struct("key", "tag", "first", "last")
    runs = checkpoint(met.groupBy("digest").agg(F.min(order).alias("earliest"), F.max(order).alias("latest")).where("earliest <> latest").select("digest", "earliest"))
    same = F.col("key").eqNullSafe(F.col("earliest.key")) & (F.col("tag") == F.col("earliest.tag"))
    if groups is None:
        later = met.join(runs, "digest").where(order > F.col("earliest"))
    else:
        group = checkpoint(groups.select(F.col("node").alias("_node"), F.col("component").alias("_group")))
        runs = runs.join(group, F.col("earliest.tag") == F.col("_node"), "left").select("digest", "earliest", F.col("_group").alias("theirs"))
        later = met.join(checkpoint(runs), "digest").where(order > F.col("earliest"))
        later = later.join(group, F.col("tag") == F.col("_node"), "left")
        copies = (F.col("tag") == F.col("earliest.tag")) | F.coalesce(F.col("_group") == F.col("theirs"), F.lit(False))
        later = later.where(same | ~copies)
    first = F.when(same, F.greatest("first", F.col("earliest.last") + 1)).otherwise(F.col("first"))
    return later.select(F.col("key").alias(key), "tag", first.alias("first"), "last").distinct()


def _cut(text: str, found: str, counts: tuple[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, total, removed = [], [], []
            for body, ranges in zip(batch[text], batch[found], strict=True):
                lines = [] if body is None else body.split("\n")
                gone = set() if ranges is None else {i for r in ranges for i in range(r["first"], r["last"] + 1)}
                total.append(len(lines))
                removed.append(len(gone))
                kept.append(body if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))
            yield batch.drop(columns=[found]).assign(**{text: kept, counts[0]: total, counts[1]: removed})

    return run


def dedup_lines(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    min_words: int = MIN_WORDS,
    n_lines: str = "n_lines",
    n_removed: str = "n_removed",
    groups: DataFrame | None = None,
) -> DataFrame:
    """documents with repeated runs cut out of text, plus the numbers of its lines and of those removed.

    All columns and rows are kept; columns with the names of the two numbers are replaced.
    Where nothing is deleted the text is unchanged, a null text stays null and has 0
    lines; an empty text has one empty line. A text may become empty. See repeated_lines()
    for groups, ties and repeated rows; an empty table gives an empty result.
    """
    docs = documents.drop(n_lines, n_removed)
    ranges = repeated_lines(docs, text, key, min_words, groups)
    own, tag, found = (free_name(docs, n) for n in ("own_key", "own_tag", "ranges"))
    per = ranges.groupBy(F.col(key).alias(own), F.col("tag").alias(tag)).agg(F.collect_list(F.struct("first", "last")).alias(found))
    joined = docs.join(per, docs[key].eqNullSafe(per[own]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == per[tag]), "left").drop(own, tag)
    shape = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_removed, T.LongType())])
    return joined.mapInPandas(_cut(text, found, (n_lines, n_removed)), shape)
