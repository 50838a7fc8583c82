"""Versioned memo tables: earlier results are reused where key and version still hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state import checkpoint
from .reconcile import budgeted


def split(wanted: DataFrame, memo: DataFrame) -> DataFrame:
    """wanted (key, version, ...) with hit and the memo's content.

    A hit needs the same key and version; an empty version never matches.
    """
    known = memo.select(F.col("key").alias("_k"), F.col("version").alias("_v"), "content", "content_error")
    joined = wanted.join(known, (wanted["key"] == known["_k"]) & (wanted["version"] == known["_v"]) & (wanted["version"] != ""), "left")
    return joined.select(*(wanted[c] for c in wanted.columns), F.col("_k").isNotNull().alias("hit"), "content", "content_error")


def touched(memo: DataFrame, seen: DataFrame, fresh: DataFrame, now: Column, ttl: str) -> DataFrame:
    """The next memo: fresh rows in place of older ones, those of seen keys marked as seen now, and what is unseen for ttl forgotten.

    seen: key; fresh: columns of memo.
    """
    kept = memo.join(fresh.select("key"), "key", "left_anti")
    marks = seen.select("key").distinct().withColumn("_seen", F.lit(True))
    marked = kept.join(marks, "key", "left").withColumn("seen_at", F.when(F.col("_seen"), now).otherwise(F.col("seen_at"))).drop("_seen")
    return pruned(marked.select(memo.columns).unionByName(fresh.select(memo.columns)), now, ttl)


def pruned(memo: DataFrame, now: Column, ttl: str) -> DataFrame:
    return memo.where(F.col("seen_at") >= now - F.expr(f"INTERVAL {ttl}"))


def answers(items: DataFrame, memo: DataFrame) -> DataFrame:
    """items (id, input_hash, ...) with the memo's answer and how it stands: fresh, stale (of another input) or missing."""
    known = memo.select(F.col("id").alias("_id"), F.col("input_hash").alias("_hash"), "answer")
    joined = items.join(known, items["id"] == known["_id"], "left")
    how = F.when(F.col("_id").isNull(), "missing").when(F.col("_hash").eqNullSafe(F.col("input_hash")), "fresh").otherwise("stale")
    return joined.select(*(items[c] for c in items.columns), "answer", how.alias("memo"))


def hit_counts(split_rows: DataFrame) -> DataFrame:
    """One row: hits and misses of split()."""
    return split_rows.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def answer_outcomes(rows: DataFrame, finished: Column, answered: Column, order: list, most: int) -> DataFrame:
    """answers() rows with outcome: skipped (finished work), cached, enriched or failed within the budget of `most` calls, else deferred.

    answered says whether a call gave a valid answer; a stale answer is kept unless it did.
    """
    asks = ~finished & (F.col("memo") != "fresh")
    sent = budgeted(rows.withColumn("_done", finished), asks, order, most, "_act")
    outcome = (
        F.when(F.col("_done"), "skipped").when(F.col("memo") == "fresh", "cached").when(F.col("_act") == "deferred", "deferred").when(F.coalesce(answered, F.lit(False)), "enriched").otherwise("failed")
    )
    return sent.withColumn("outcome", outcome).drop("_done", "_act")


def next_answers(memo: DataFrame, fresh: DataFrame, now: Column, ttl: str) -> DataFrame:
    """The answer memo (id, input_hash, answer, seen_at) with fresh answers in place of older ones, pruned."""
    kept = memo.join(fresh.select("id"), "id", "left_anti")
    return pruned(kept.unionByName(fresh.select(memo.columns)), now, ttl)


def reread_due(version: Column, known_version: Column, parsed_at: Column, interval_seconds: Column, now: Column) -> Column:
    """Whether a document must be read again: not while its version stands, nor within its interval."""
    young = F.unix_micros(now) - F.unix_micros(parsed_at) < interval_seconds.cast("bigint") * 1_000_000
    return ~(F.coalesce(version == known_version, F.lit(False)) | F.coalesce(young, F.lit(False)))


def input_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def text_version(text: Column) -> Column:
    return F.concat(F.lit("text:"), F.substring(F.sha2(text, 256), 1, 24))


def completed(items: DataFrame, memo: DataFrame, call: Callable[[pd.Series], pd.Series], now: Column, ttl: str, order: list, most: int) -> tuple[DataFrame, DataFrame]:
    """One run over items (id, input_hash, prompt, due, ...): (items with answer, error and outcome, the next memo).

    memo (id, input_hash, answer, seen_at) is what earlier runs were answered. What stands
    there is not asked again, nor is what is not due (see reread_due; null counts as due);
    of the rest the first `most` in order are, the others are deferred.
    call takes prompts to answers, in batches on the executors. Where it raises, it is
    called for each row of the batch by itself; what raises then, and a null answer, is
    an error of that row, whose older answer is kept. Each prompt is sent once: answers are
    written before anything reads them. Answers that are used are seen now; what is unseen
    for ttl is forgotten.
    """
    rows = answers(items, memo)
    waits = ~F.coalesce("due", F.lit(True)) & (F.col("memo") == "stale")
    sent = checkpoint(budgeted(rows, (F.col("memo") != "fresh") & ~waits, order, most, "_act"))

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            answer = call(pd.Series([prompt])).iloc[0]
            return (None, "no answer") if pd.isna(answer) else (answer, None)
        except Exception as e:  # an answer that fails is a value
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                got = list(call(batch["prompt"]))
                told = [(None, "no answer") if pd.isna(a) else (a, None) for a in got] if len(got) == len(batch) else None
            except Exception:  # told row by row
                told = None
            told = [one(p) for p in batch["prompt"]] if told is None else told
            yield batch[["id", "input_hash"]].assign(answer=[a for a, _ in told], error=[e for _, e in told])

    asked = sent.where("_act = 'send'").select("id", "input_hash", "prompt")
    found = checkpoint(asked.mapInPandas(run, "id string, input_hash string, answer string, error string"))
    new = found.select(F.col("id").alias("_id"), F.col("answer").alias("_answer"), "error")
    joined = sent.join(new, F.col("id") == F.col("_id"), "left")
    outcome = (
        F.when(F.col("memo") == "fresh", "cached").when(F.col("_act") == "deferred", "deferred").when(F.col("_act") == "skip", "waiting").when(F.col("error").isNull(), "answered").otherwise("failed")
    )
    out = joined.select(*items.columns, F.coalesce("_answer", "answer").alias("answer"), "error", outcome.alias("outcome"))
    used = memo.join(sent.select("id"), "id", "left_semi").withColumn("seen_at", now)
    unused = memo.join(sent.select("id"), "id", "left_anti")
    fresh = found.where("error IS NULL").select("id", "input_hash", "answer", now.alias("seen_at"))
    return out, next_answers(used.unionByName(unused.select(used.columns)), fresh, now, ttl)
