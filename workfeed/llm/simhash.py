"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into `max_bits // 2 + 1` segments. Two fingerprints
that differ in at most `max_bits` bits then have one segment in which they differ
in at most one bit, so they share one of that segment's one-wildcard variants: the
segment with one of its bits deleted. Every distinct fingerprint is indexed under
all variants of all segments (64 keys), fingerprints meet by an equality join on
the key, and the full distance verifies each meeting.

Only distinct fingerprints are indexed; copies share one and meet again at the end.
A key that more than `bucket` fingerprints share is not expanded into pairs. Its
fingerprints are instead indexed under every pattern with `max_bits` bits deleted,
where any two that share a pattern are within the distance by construction: such a
group holds at most 2 ** max_bits fingerprints and is linked to its smallest. This
second way is as exact as the first and linear in the fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, free_name
from .components import connected_components

BITS = 64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles in order, repeats included; a text of fewer words is one, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = map(join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [join(words)]
    return np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits as a signed long, each set if it is set in over half the hashes; 0 for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def simhash(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a long.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a bit is set
    where over half of the word shingles (repeats included) have it set in their
    XXH64 with seed 42. A text of fewer words is one shingle; null, empty and blank
    texts have fingerprint 0.
    """

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return run(text)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of each segment of a fingerprint."""
    n = max_bits // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(bits) -> int:
    """The long whose given bits are set."""
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def _variants(fp: Column, max_bits: int) -> Column:
    """array of (slot, key): the segment and deleted bit, and what the fingerprint has in the rest of the segment."""
    kept = [(at, at + bit, _mask(b for b in range(at, at + width) if b != at + bit)) for at, width in segments(max_bits) for bit in range(width)]
    return F.array(*(F.struct(F.lit(gone).cast("smallint").alias("slot"), fp.bitwiseAND(F.lit(m)).alias("key")) for _, gone, m in kept))


def _first_slot(apart: Column, max_bits: int) -> Column:
    """The first slot in which two fingerprints meet that differ in the bits of apart: a pair counts there alone."""
    out = F.lit(-1)
    for at, width in reversed(segments(max_bits)):
        part = apart.bitwiseAND(F.lit(_mask(range(at, at + width))))
        # Without any difference they meet under all bits; else under the one that differs.
        out = F.when(part == 0, F.lit(at)).when(part == F.lit(_mask([63])), F.lit(63)).when(F.bit_count(part) == 1, F.bit_count(part - 1)).otherwise(out)
    return out.cast("smallint")


def near_fingerprints(prints: DataFrame, max_bits: int = 2, bucket: int = 1024, parts: int | None = None) -> DataFrame:
    """(a, b), a < b: links that connect all fingerprints within max_bits of each other.

    prints: a column fp of distinct longs. Every pair within the distance is in the
    result, or else both its ends are linked to a third within the distance of both.
    parts: in how many partitions the variants are kept at most; as many as shuffles have without it.
    """
    most = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # As many tasks as the variants need, which are 64 times the fingerprints' bytes.
    # Dealt round, as a shuffle by fp again would be left out and its parts joined.
    spread = prints.repartition(min(most, parts or most))
    keyed = spread.select("fp", F.explode(_variants(F.col("fp"), max_bits)).alias("v")).select("fp", "v.slot", "v.key")
    sizes = keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark would take the variants to be as small as the fingerprints and broadcast them.
    met = keyed.hint("merge").join(sizes, ["slot", "key"])
    met = checkpoint(met.coalesce(parts) if parts else met)
    apart = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.bit_count(apart) <= max_bits) & (F.col("slot") == _first_slot(apart, max_bits))
    few = met.where(F.col("n") <= bucket)
    left = few.select("slot", "key", F.col("fp").alias("a"))
    right = few.select("slot", "key", F.col("fp").alias("b"))
    pairs = left.hint("merge").join(right, ["slot", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    if parts and met.where(F.col("n") > bucket).isEmpty():
        return pairs.distinct()
    crowded = met.where(F.col("n") > bucket).select("fp").distinct()
    masks = [_mask(b for b in range(BITS) if b not in gone) for gone in combinations(range(BITS), max_bits)]
    patterns = F.posexplode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseAND(m)))
    # A group holds at most 2 ** max_bits fingerprints.
    groups = crowded.select("fp", patterns.alias("slot", "key")).groupBy("slot", "key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def _grouped(documents: DataFrame, text: str, key: str, shingle: int, max_bits: int, bucket: int) -> DataFrame:
    """(key, fp, kept): each row's fingerprint and the smallest (key, fp) of its group."""
    rows = checkpoint(documents.select(F.col(key).alias("key"), simhash(F.col(text), shingle).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("key").alias("first"))
    links = near_fingerprints(prints.select("fp"), max_bits, bucket)
    groups = connected_components(links, "a", "b")
    named = prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min(F.when(F.col("first").isNotNull(), F.struct("first", "fp"))).alias("kept"))
    return rows.join(named.join(least, "group").select("fp", "kept"), "fp")


def near_duplicates(
    documents: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, max_bits: int = 2, bucket: int = 1024
) -> DataFrame:
    """(key, fingerprint, component): which documents hang together.

    fingerprint is a long; component is the smallest key that a document reaches over
    links of at most max_bits differing bits, itself included. One row per row of
    documents: rows that repeat a key count as one document for the minimum and keep
    their rows; a null key takes part in links but is never a component's name unless
    all keys of the component are null. Null, empty and blank texts share fingerprint
    0. An empty table gives an empty result; other columns are ignored.
    """
    found = _grouped(documents, text, key, shingle, max_bits, bucket)
    return found.select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), F.col("kept.first").alias("component"))


def drop_near_duplicates(
    documents: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, max_bits: int = 2, bucket: int = 1024
) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the smallest (key, fingerprint)'s.

    Rows that share a key and are unlike are not one group, and both stay; of rows alike
    in key and fingerprint any one stays. A row with a null key stays, as the links
    cannot name it.
    """
    found = _grouped(documents, text, key, shingle, max_bits, bucket)
    tag, print_ = free_name(documents, "kept"), free_name(documents, "fingerprint")
    keep = found.where((F.col("key") == F.col("kept.first")) & (F.col("fp") == F.col("kept.fp"))).select(F.col("key").alias(tag), F.col("fp").alias("fp_" + print_)).distinct()
    named = documents.where(F.col(key).isNotNull()).withColumn(print_, simhash(F.col(text), shingle))
    met = named.join(keep, (named[key] == keep[tag]) & (named[print_] == keep["fp_" + print_]), "left_semi").dropDuplicates([key, print_]).drop(print_)
    return met.unionByName(documents.where(F.col(key).isNull()))
