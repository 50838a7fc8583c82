"""Document fingerprints from closed syncmers.

Every k-mer of code points whose smallest inner s-mer is its first or its last is
chosen as an anchor. The choice looks at the k-mer alone, so an edit changes only
the anchors it touches: the others stay, wherever the text around them moves. Any
k - s + 1 consecutive s-mers hold at least one anchor, so long stretches are never
without one. A fingerprint is the list of anchors in text order; two fingerprints
are compared by matching equal anchors in place order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIX_1, MIX_2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every n consecutive code points."""
    out = np.zeros(len(points) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * BASE + points[i : i + len(out)]
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(text: str | None, k: int = 24, s: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text's closed syncmers in text order.

    A text of fewer than k code points, empty and null included, is one anchor as a
    whole. Positions count code points from 0; hashes are signed 32-bit.
    """
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) < k:
        whole = hashlib.blake2b(points.tobytes(), digest_size=4).digest()
        return np.frombuffer(whole, dtype=np.int32).copy(), np.zeros(1, dtype=np.int64)
    inner = _mixed(_grams(points, s))
    width = k - s + 1
    least = _least(inner, width)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    hashes = np.zeros(len(at), dtype=np.uint64)
    for i in [*range(0, k - s, s), k - s]:
        hashes = _mixed(hashes * BASE + inner[at + i])
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32), at


def as_text(hashes: np.ndarray) -> str:
    """A fingerprint as a string: eight lower-case hex digits an anchor, in text order."""
    return hashes.astype(">i4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">i4").astype(np.int32)


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Share of the anchors of both that match in place order: 1 for equal lists, 0 for none in common.

    The n-th occurrence of an anchor matches the n-th in the other list, and of those
    matches the longest series with rising places on both sides counts.
    """
    if np.array_equal(one, two):
        return 1.0
    common = np.intersect1d(one, two)
    if not len(common):
        return 0.0
    places, seen = {}, Counter()
    for i in np.flatnonzero(np.isin(two, common)):
        h = two[i]
        places[h, seen[h]] = i
        seen[h] += 1
    series: list[int] = []
    seen = Counter()
    for i in np.flatnonzero(np.isin(one, common)):
        h = one[i]
        j = places.get((h, seen[h]))
        seen[h] += 1
        if j is not None:
            at = int(np.searchsorted(series, j)) if series and series[-1] >= j else len(series)
            series[at : at + 1] = [j]
    return 2 * len(series) / (len(one) + len(two))


def fingerprints(documents: DataFrame, text: str = "text", key: str = "doc_id", k: int = 24, s: int = 4) -> DataFrame:
    """(key, hashes, positions): every document's anchors, one row per row. See anchors()."""
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("body"))
    shape = T.StructType(
        [
            T.StructField("key", docs.schema["key"].dataType),
            T.StructField("hashes", T.ArrayType(T.IntegerType())),
            T.StructField("positions", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [anchors(t, k, s) for t in batch["body"]]
            yield pd.DataFrame({"key": batch["key"], "hashes": [h for h, _ in found], "positions": [p for _, p in found]})

    return docs.mapInPandas(run, shape).withColumnRenamed("key", key)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def beside_next(documents: DataFrame, text: str, key: str) -> DataFrame:
    """(bucket, marker, key, h, body): rows dealt so that each stands in a bucket with the next in order of key, the text's hash and the text.

    Ranges of (key, hash), dealt without the texts, give the cuts, each of which is that
    of some row; the rows at a cut go to their own bucket and, as markers, to the end of
    the one before, and the first of all to the end of the last. So rows of one key, or
    of none, are cut as well. Texts are shuffled once, and only the cuts pass through the
    driver.
    """
    docs = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body")).withColumn("h", F.xxhash64(F.coalesce("body", F.lit(""))))
    n = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("key", "h").repartitionByRange(n, F.col("key").asc_nulls_first(), "h")
    # One row a range.
    found = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "h")).alias("cut")).collect()
    kind = docs.schema["key"].dataType
    starts = sorted(((r["cut"]["key"], r["cut"]["h"]) for r in found), key=lambda c: (c[0] is not None, c[0] if c[0] is not None else 0, c[1])) or [(None, 0)]
    cut = lambda k, h: F.struct(F.lit(k).cast(kind).alias("key"), F.lit(h).cast("long").alias("h"))
    # The last start that is not beyond the row, by halving steps.
    edges, place = F.array(*(cut(k, h) for k, h in starts)), F.struct("key", "h")
    steps = F.array(*(F.lit(1 << i) for i in range(len(starts).bit_length() - 1, -1, -1)))
    own = F.aggregate(steps, F.lit(0), lambda at, w: F.when((at + w < len(starts)) & (F.get(edges, at + w) <= place), at + w).otherwise(at))
    dealt = docs.withColumn("own", own)
    before = F.when(F.get(edges, F.col("own")).eqNullSafe(place), F.when(F.col("own") == 0, F.lit(len(starts) - 1)).otherwise(F.col("own") - 1))
    stay = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("marker"))
    mark = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("marker"))
    both = F.explode(F.when(F.col("before").isNull(), F.array(stay)).otherwise(F.array(stay, mark))).alias("to")
    return dealt.withColumn("before", before).select(both, "key", "h", "body").select("to.bucket", "to.marker", "key", "h", "body")


def compare_edited(documents: DataFrame, text: str = "text", key: str = "doc_id", k: int = 24, s: int = 4) -> DataFrame:
    """Every document's fingerprint, as a string, beside that of its edited text and of the next document.

    The next document is the one with the next larger key, after the last the first; a
    table of one row is next to itself. The edited text has the last half of its code
    points replaced by the start of the next. Keys are of any type that has an order and
    goes to a string and back; null keys come first, and rows of one key are in order of
    their text's XXH64, then their text, one row each; a null text is empty. An empty
    table gives an empty result; other columns are ignored.
    """
    dealt = beside_next(documents, text, key)
    shape = T.StructType(
        [
            T.StructField(key, T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its next one
        for batch in batches:
            out = []
            for bucket, marker, own, body in zip(batch["bucket"], batch["marker"], batch["key"], batch["body"], strict=True):
                body = body or ""
                if marker and (held is None or held[0] != bucket):
                    continue  # a repeat of the marker, or of a bucket without rows
                hashes = anchors(body, k, s)[0]
                if held is not None and held[0] == bucket:
                    _, key_, body_, hashes_ = held
                    changed = edited(body_, body)
                    other = anchors(changed, k, s)[0]
                    digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
                    out.append((key_, len(body_), digest, as_text(hashes_), as_text(other), likeness(hashes_, other), likeness(hashes_, hashes)))
                held = None if marker else (bucket, own, body, hashes)
            yield pd.DataFrame(out, columns=shape.names)

    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lined = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "marker", F.col("key").asc_nulls_first(), "h", "body")
    # Keys pass through pandas as strings, as whole numbers beside nulls would become floats there.
    found = lined.select("bucket", "marker", F.col("key").cast("string").alias("key"), "body").mapInPandas(run, shape)
    return found.withColumn(key, F.col(key).cast(documents.schema[key].dataType))
