"""All feeds as one table: each is read by itself, and one that fails takes nothing from the others."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import WORK_ITEM

#: What is told of a failure: the source, the file if it is one file's, and what is wrong.
ERRORS = "source STRING, file STRING, error STRING"


class Feed(NamedTuple):
    """A source and how it is read: as (rows, errors), the latter (file, error) or None."""

    source: str
    read: Callable[[], tuple[DataFrame, DataFrame | None]]


def landed_pages(spark: SparkSession, path: str, row: str, field: str | None = None, place: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of the JSON pages under path, each an array of rows or an object with one under a field.

    row is the DDL of a row's struct. A page that is cut off or is no JSON gives no row,
    but (file, error); the others are read. A row's place in its page is a column as well.
    """
    name = field or "rows"
    shape = f"{name} ARRAY<STRUCT<{row}>>, _corrupt STRING"
    pages = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    wrapped = F.col("value") if field else F.concat(F.lit('{"rows": '), "value", F.lit("}"))
    parsed = pages.select("file", F.from_json(wrapped, shape, {"columnNameOfCorruptRecord": "_corrupt"}).alias("page"))
    broken = F.col("page").isNull() | F.col("page._corrupt").isNotNull()
    rows = parsed.where(~broken).select(F.posexplode(f"page.{name}").alias(place, "x")).select("x.*", place)
    return rows, parsed.where(broken).select("file", F.lit("malformed page").alias("error"))


def conformed(value: Column, have: T.DataType | None, want: T.DataType) -> Column:
    """value in the wanted type: structs by the names of their fields, arrays element by element, null for what is not there."""
    if have is None:
        return F.lit(None).cast(want)
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        held = {f.name: f.dataType for f in have}
        return F.when(value.isNotNull(), F.struct(*(conformed(value[f.name], held.get(f.name), f.dataType).alias(f.name) for f in want)))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType) and isinstance(want.elementType, T.StructType):
        return F.transform(value, lambda x: conformed(x, have.elementType, want.elementType))
    return value.cast(want)


def aligned(rows: DataFrame, schema: T.StructType = WORK_ITEM) -> DataFrame:
    """rows with the columns of schema, matched by name; what they lack is null, what it lacks goes."""
    held = {f.name: f.dataType for f in rows.schema}
    return rows.select(*(conformed(F.col(f"`{f.name}`"), held.get(f.name), f.dataType).alias(f.name) if f.name in held else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def with_progress(rows: DataFrame) -> DataFrame:
    """rows with their state, grade, turned_in_at, late and files, as far as they have these, as one progress."""
    names = {"state": "state", "turned_in_at": "submitted_at", "late": "late", "grade": "grade", "files": "attachments"}
    return rows.withColumn("progress", F.struct(*(F.col(c).alias(to) for c, to in names.items() if c in rows.columns)))


def gathered(spark: SparkSession, feeds: list[Feed], sources: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(items, errors): the union of the feeds of the given sources, of all if none is given, as WORK_ITEM, and what could not be read.

    A feed whose reading fails is one row of errors; so is each broken file of one that
    is read. It is an error to have no feed at all, or none that can be read.
    """
    chosen = [f for f in feeds if not sources or f.source in sources]
    if not chosen:
        raise ValueError("no feed is configured")
    items, broken, failed = [], [], []
    for feed in chosen:
        try:
            rows, errors = feed.read()
            items.append(aligned(rows.withColumn("source", F.lit(feed.source))))
        except (PySparkException, OSError, ValueError) as e:
            failed.append((feed.source, None, type(e).__name__))
            continue
        if errors is not None:
            broken.append(errors.select(F.lit(feed.source).alias("source"), "file", "error"))
    if not items:
        raise RuntimeError(f"no feed could be read: {failed}")
    told = [spark.createDataFrame(failed, ERRORS), *broken]
    return reduce(DataFrame.unionByName, items), reduce(DataFrame.unionByName, told)
