"""Sharding by extendible hashing.

Each row has a bit string: 60 bits of the MD5 of its key, then 60 of its text, so
that rows which share a key can still be parted. The directory starts with the empty
prefix; a bucket whose bytes exceed the limit splits on the next bit, and only such
buckets split. The bytes of `step` further bits are summed in one pass, from which
the depth of every bucket follows at once; only rows in buckets that are still too
large after those bits go into another pass. Texts are read once, for their sizes and
hashes, and never shuffled; directory rows are pre-aggregated before they are shuffled,
and a bucket has at most 2 ** step of them in a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Hexadecimal digits of each half, and bits of a digit.
HALF, DIGIT = 15, 4


def hash_digits(key: Column, text: Column) -> Column:
    """30 hexadecimal digits: 60 bits of the MD5 of each, null as empty."""
    return F.concat(*(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, HALF) for c in (key, text)))


def bits_of(digits: Column, n: int) -> Column:
    """n hexadecimal digits as 4 * n characters 0 or 1."""
    parts = [(at, min(HALF, n - at)) for at in range(0, n, HALF)]
    return F.concat(*(F.lpad(F.bin(F.conv(F.substring(digits, at + 1, width), 16, 10).cast("long")), DIGIT * width, "0") for at, width in parts))


def _directory(rows: DataFrame, depth: int, step: int, limit: int) -> DataFrame:
    """(prefix, shard, shard_bytes): for each prefix of depth + step bits (all where that is more), in digits, the bucket that holds it, null if it must split on.

    rows: digits, size. Bytes are summed once at full depth and rolled up to the
    shorter prefixes. A bucket whose rows all have the same bits cannot split.
    """
    deep = min(depth + step, 2 * HALF * DIGIT)
    fine = rows.groupBy(F.substring("digits", 1, deep // DIGIT).alias("prefix")).agg(
        F.sum("size").alias("size"), F.min("digits").alias("low"), F.max("digits").alias("high")
    )
    bits = bits_of(F.col("prefix"), deep // DIGIT)
    levels = fine.select("prefix", bits.alias("bits"), "size", "low", "high", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"))
    bucket = F.expr("substring(bits, 1, depth)")
    sums = levels.groupBy("depth", bucket.alias("shard")).agg(F.sum("size").alias("shard_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))).select("depth", "shard", "shard_bytes")
    # The first pass has at most 2 ** (step + 1) buckets; later ones as many for each that splits on, and 2 ** step prefixes in each.
    found = levels.select("prefix", "depth", bucket.alias("shard")).join(fits if depth else F.broadcast(fits), ["depth", "shard"], "left")
    least = F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "shard", "shard_bytes")))
    return found.groupBy("prefix").agg(least.alias("leaf")).select("prefix", "leaf.shard", "leaf.shard_bytes")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with n, from 0 within each digits: counted per partition of the written rows first, so that no task numbers a whole group."""
    placed = checkpoint(rows).withColumn("part", F.spark_partition_id())
    counts = placed.groupBy("digits", "part").agg(F.count("*").alias("held"))
    # One row per partition in a group.
    before = F.coalesce(F.sum("held").over(Window.partitionBy("digits").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("digits", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("digits", "part").orderBy("digits")) - 1
    return placed.withColumn("within", within).join(offsets, ["digits", "part"]).withColumn("n", F.col("before") + F.col("within")).drop("part", "within", "before")


def shard(documents: DataFrame, text: str = "text", key: str = "doc_id", limit: int = 64 << 20, step: int = 12) -> DataFrame:
    """(key, n_bytes, shard, shard_bytes), one row per row of documents.

    n_bytes counts the UTF-8 bytes of text (null: 0). shard is the bucket's hash
    prefix; "" is the one bucket of a table that fits the limit as a whole. Rows
    alike in key and text cannot be parted by bits: if they exceed the limit together,
    their bucket is divided by number into parts named prefix.0, prefix.1 and so on.
    shard_bytes exceeds the limit only where a single row does. An empty table gives
    an empty result; other columns are ignored. step is a multiple of 4.
    """
    if step % DIGIT or step <= 0:
        raise ValueError("step must be a multiple of 4")
    rows = checkpoint(
        documents.select(F.col(key).alias("key"), hash_digits(F.col(key), F.col(text)).alias("digits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    )
    done, depth, over = [], 0, False
    while True:
        directory = checkpoint(_directory(rows, depth, step, limit))
        # The first pass's directory has at most 2 ** step rows.
        side = F.broadcast(directory) if depth == 0 else directory
        placed = rows.withColumn("prefix", F.substring("digits", 1, (depth + step) // DIGIT)).join(side, "prefix").drop("prefix")
        done.append(placed.where("shard IS NOT NULL"))
        over = over or not directory.where(F.col("shard_bytes") > limit).isEmpty()
        if directory.where("shard IS NULL").isEmpty():
            break
        depth += step
        # Cut here, or plans would nest a level deeper with each pass.
        rows = checkpoint(placed.where("shard IS NULL").select("key", "digits", "size"))
    whole = reduce(DataFrame.unionByName, done)
    names = [F.col("key").alias(key), F.col("size").alias("n_bytes"), "shard", "shard_bytes"]
    fits = whole.where((F.col("shard_bytes") <= limit) | (F.col("shard_bytes") == F.col("size"))).select(*names)
    if not over:
        return fits
    # Rows with the same bits throughout, which have the same size.
    alike = whole.where((F.col("shard_bytes") > limit) & (F.col("shard_bytes") > F.col("size")))
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("size", F.lit(1)))).cast("long")
    part = F.floor(F.col("n") / F.col("per"))
    held = F.least(F.col("per"), F.round(F.col("shard_bytes") / F.col("size")).cast("long") - part * F.col("per")) * F.col("size")
    parts = _numbered(alike).withColumn("per", per).withColumns({"shard": F.concat_ws(".", "shard", part.cast("string")), "shard_bytes": held.cast("long")})
    return fits.unionByName(parts.select(*names))
