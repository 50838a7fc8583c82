"""Export of the unified table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, short_number
from ..functions.times import rfc3339


def canonical(items: DataFrame) -> DataFrame:
    """By date with undated rows last, then course, title and id."""
    return items.orderBy(F.col("due_at").asc_nulls_last(), "course", "title", "id")


def flat(items: DataFrame) -> DataFrame:
    """The sixteen columns of the flat export in their order: instants as RFC 3339 in UTC, attachments counted and named, empty where there is nothing."""
    names = F.transform("attachments", lambda a: F.coalesce(blank_to_null(a["name"]), blank_to_null(a["url"]), F.lit("(unnamed)")))
    given = lambda c: F.coalesce(c, F.lit(""))
    return items.select(
        "id", "source", "kind", given(F.col("course")).alias("course"), given(F.col("title")).alias("title"), given(F.col("url")).alias("url"),
        given(rfc3339(F.col("assigned_at"))).alias("assigned_at"), given(rfc3339(F.col("due_at"))).alias("due_at"), given(short_number(F.col("points"))).alias("points"),
        "state", given(F.col("grade")).alias("grade"), given(rfc3339(F.col("submitted_at"))).alias("submitted_at"), F.coalesce("late", F.lit(False)).alias("late"),
        F.size("attachments").cast("bigint").alias("attachment_count"), F.array_join(names, ", ").alias("attachment_names"), given(F.col("description")).alias("description"),
    )


def write_json(items: DataFrame, path: str, made: Callable[[DataFrame], DataFrame] | None = None, compression: str | None = None) -> None:
    """Writes items in canonical order. made: what makes rows as they are written of items in order, so that what they are made of is sorted in their place."""
    rows = (made or (lambda df: df))(canonical(items))
    out = rows.withColumn("attachments", F.coalesce("attachments", F.array().cast(rows.schema["attachments"].dataType)))
    out.write.mode("errorifexists").json(path, compression=compression)


def write_csv(items: DataFrame, path: str) -> None:
    flat(canonical(items)).write.mode("errorifexists").option("header", True).csv(path)


def write_actions(actions: DataFrame, path: str, run: str) -> None:
    """Files the change-set of a run by its actions, as path/run=<run>/action=<action>.

    A run that is written again replaces itself as a whole, also where it has no longer
    an action that it had; other runs stay as they are.
    """
    if not run or "/" in run:
        raise ValueError("a run needs a name that can be a folder's")
    actions.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("action").parquet(f"{path}/run={run}")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """The change-sets of all runs, with run and action."""
    return spark.read.option("basePath", path).option("mergeSchema", True).parquet(path)


def write_files(files: DataFrame, path: str) -> int:
    """Writes files (name, content), one row each, into a folder that all executors reach, or into folders in it that names begin with; how many. A task that runs again writes its files anew."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        made = set()
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                if (parent := name.rpartition("/")[0]) not in made:
                    store.create_dir(f"{folder}/{parent}".rstrip("/"))
                    made.add(parent)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("name", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
