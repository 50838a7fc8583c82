"""Near copies by the Jaccard similarity of word shingles: operator 2 at a stated similarity.

The similarity of two texts is that of their sets of word shingles. Candidates come
from SimHash's deletion-variant signatures (see simhash), which find all texts within
two bits of each other however crowded they are. Two texts with a similarity of 0.8
differ in some ten of 64 bits, which no number of segments that is worth its keys can
reach; for these a text also has `bands` keys, each the digest of `rows` minima of its
shingles' hashes under random multipliers. Two texts with a similarity of s share at
least one key with a chance of 1 - (1 - s ** rows) ** bands, which at 20 bands of 5
rows is 0.9996 at 0.8. Texts meet by equality joins, and every meeting is verified by
the exact similarity through a join with the shingles of the texts that met.

Only different texts are indexed; copies share a node and meet again at the end. A
key that more than `bucket` texts share is not expanded into pairs at first: its texts are
compared with two of them, those of the smallest and largest hash under the band's
number. That links most of a crowded group. Where a crowded key still has texts of several
groups, those of them that can be linked by their distances to one of the two meet once more, by an exact set-similarity join: of a text's shingles, rarest
first, one of the first n - ceil(similarity * n) + 1 is shared by every text at that
similarity, so equality joins on those shingles, between texts of different groups,
find every link that is left. No pair that shares a key is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, free_name
from .common import partitions as partitions_of
from .components import connected_components
from .simhash import BITS, majority, near_fingerprints, shingle_hashes

#: Counters of shingles, a power of two.
COUNTERS = 1 << 17

#: Rows of a few numbers that one partition holds of a table that is small for the session's number of them.
EACH = 200_000


def partitions(rows: int) -> int:
    """In how many partitions a table of that many rows of a few numbers each is kept; tables of a single one meet without a shuffle."""
    return partitions_of(rows, EACH)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The hashes of a text's different word shingles, sorted; see simhash.shingle_hashes()."""
    return np.unique(shingle_hashes(text, words))


@cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """The keys of a set of shingle hashes, as signed longs."""
    import xxhash

    odd, plus = _multipliers(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * odd + plus
        np.minimum(least, part.min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in least.reshape(bands, rows)]


def _signature(text: Column, words: int, bands: int, rows: int) -> Column:
    """struct(fp, keys): the SimHash and the banded keys of a text."""

    @F.pandas_udf("fp long, keys array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            hashes = [shingle_hashes(t, words) for t in texts]
            yield pd.DataFrame({"fp": [majority(h) for h in hashes], "keys": [band_keys(np.unique(h), bands, rows) for h in hashes]})

    return run(text)


def _shingles(text: Column, words: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, words).view(np.int64) for t in texts])

    return run(text)


def candidates(keyed: DataFrame, bucket: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowded) of keyed (node, slot, key): (a, b), a < b, that share a slot and key, of keys over bucket only those with two chosen nodes; and (slot, key, node, low) of these keys, low being one of the two. parts: see partitions()."""
    mark = F.struct(F.xxhash64("node", "slot").alias("h"), "node")
    sizes = keyed.groupBy("slot", "key").agg(F.count("*").alias("n"), F.min(mark).alias("low"), F.max(mark).alias("high")).where("n > 1")
    # Spark would take the keys to be as few as the nodes that they are exploded from, and broadcast them.
    met = checkpoint(keyed.hint("merge").join(sizes, ["slot", "key"]).select("slot", "key", "node", "n", F.col("low.node").alias("low"), F.col("high.node").alias("high")).coalesce(parts))
    few, crowded = met.where(F.col("n") <= bucket), met.where(F.col("n") > bucket)
    pairs = few.select("slot", "key", F.col("node").alias("a")).hint("merge").join(few.select("slot", "key", F.col("node").alias("b")), ["slot", "key"]).select("a", "b").coalesce(parts)
    chosen = crowded.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    found = pairs.unionByName(chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).where("a < b")
    return found, crowded.select("slot", "key", "node", "low")


def measured(pairs: DataFrame, sets: DataFrame, similarity: float, parts: int) -> DataFrame:
    """The pairs (a, b) with apart, the Jaccard distance of their sets (node, s), and alike, whether they have at least the similarity; two empty sets are alike. parts: see partitions()."""
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"{c}_s")) for c in ("a", "b"))
    sized = pairs.join(left, "a").coalesce(parts).join(right, "b").coalesce(parts).select("a", "b", F.size(F.array_intersect("a_s", "b_s")).alias("both"), (F.size("a_s") + F.size("b_s")).alias("n"))
    whole = F.col("n") - F.col("both")
    return sized.select("a", "b", F.when(whole == 0, 0.0).otherwise(1 - F.col("both") / whole).alias("apart"), (F.col("both") >= similarity * whole).alias("alike"))


def _first(counts: np.ndarray, similarity: float):
    """A set's keys in order: its first n - ceil(similarity * n) + 1 shingles, those of small counts first."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sets in batches:
            out = []
            for s in sets:
                s = np.asarray(s, dtype=np.int64)
                keys = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
                out.append(s[np.lexsort((s, counts[s & (COUNTERS - 1)]))[:keys]])
            yield pd.Series(out)

    return run


def links_across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all links of at least the similarity between members (node, group) of different groups; sets (node, s) has the shingles of each.

    Shingles are put in one order for all, rare ones first; a set's first ones (its own
    shingles, at most the set) are the keys, and keys of a single group join nothing.
    What is rare is told by a fixed number of counters that shingles share by their
    bits: any order that is the same for all sets is exact, so no shingle has to be met
    with its own count.
    """
    held = checkpoint(members.join(sets, "node").where(F.size("s") > 0))
    parts = partitions(held.agg(F.sum(F.size("s"))).first()[0] or 0)
    counter = F.col("g").bitwiseAND(F.lit(COUNTERS - 1)).alias("c")
    counts = np.zeros(COUNTERS, dtype=np.float32)
    for c, n in held.select(F.explode("s").alias("g")).groupBy(counter).agg(F.count("*").alias("n")).collect():
        counts[c] = n
    keyed = held.select("node", "group", F.size("s").alias("n"), F.posexplode(_first(counts, similarity)(F.col("s"))).alias("at", "g"))
    keyed = checkpoint(keyed.select("node", "group", "g", (F.col("n") - F.col("at")).alias("left"), "n"))
    found = measured(_meetings(keyed, similarity, parts), held.select("node", "s"), similarity, parts)
    return found.where("alike").select("a", "b")


def _meetings(keyed: DataFrame, similarity: float, parts: int, width: float = 1.05) -> DataFrame:
    """(a, b), a < b: sets of different groups that may be alike. keyed (node, group, g, left, n): a key g of a set of n, left of which are not before it. parts: see partitions().

    The first key that two alike sets share leaves each of them enough for what they
    must have in common, which the nearer they are in size is the more. So a key
    serves only the sizes for which it is early enough, in bands that grow by width:
    what a crowd of like size has in common behind its own shingles is no key within it.
    A key has a row for each of these bands alone, and for none in which no set has it.
    """
    share = similarity / (1 + similarity)
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(width)) + 1e-9).cast("int")
    mixed = keyed.groupBy("g").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.min("n").alias("from"), F.max("n").alias("to")).where("least <> most").select("g", "from", "to")
    shared = keyed.coalesce(parts).join(checkpoint(mixed.coalesce(parts)), "g")
    early = (F.col("left") / share - F.col("n")) * (1 + 1e-6) + 1e-3
    reach = shared.withColumn("least", F.greatest(F.lit(1.0), similarity * F.col("n") - 1e-6, F.col("from"))).withColumn("most", F.least(F.col("n") / similarity + 1e-6, F.col("to"), early))
    reach = reach.where("least <= most").withColumn("own", band(F.col("n"))).withColumn("other", F.explode(F.sequence(band(F.col("least")), band(F.col("most")))))
    least = F.greatest(F.pow(F.lit(width), F.col("other") - 1e-6), similarity * F.col("n"))
    reach = reach.where(F.col("left") >= share * (F.col("n") + least) - 1e-6)
    reach = checkpoint(reach.select("node", "group", "g", "left", "n", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).coalesce(parts))
    slot = ["g", "low", "high"]
    sides = [F.max((F.col("own") == F.col(c)).cast("int")) for c in ("low", "high")]
    mixed = reach.groupBy(*slot).agg(F.min("group").alias("least"), F.max("group").alias("most"), F.least(*sides).alias("both")).where("least <> most AND both = 1").select(*slot)
    keys = checkpoint(reach.coalesce(parts).join(checkpoint(mixed.coalesce(parts)).coalesce(parts), slot, "left_semi").coalesce(parts))
    a, b = (keys.where(F.col("own") == F.col(end)).select(*slot, *(F.col(c).alias(f"{side}_{c}") for c in ("node", "group", "left", "n"))) for side, end in (("a", "low"), ("b", "high")))
    common = F.ceil(share * (F.col("a_n") + F.col("b_n")) - 1e-9)
    met = a.join(b, slot).where(((F.col("low") < F.col("high")) | (F.col("a_node") < F.col("b_node"))) & (F.col("a_group") != F.col("b_group")) & (F.least("a_left", "b_left") >= common))
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def in_reach(members: DataFrame, pairs: DataFrame, similarity: float, parts: int) -> DataFrame:
    """(node, group) of the members (slot, key, node, low, group) that may be linked to another group's member under their key.

    The distance is a metric, so of two linked nodes the distances to the key's low differ by at
    most 1 - similarity: nodes are put in rings of that width around it, and stay if their ring and the ones
    beside it hold several groups. pairs (a, b, apart) has every node's distance to its low; parts: see partitions().
    """
    width = 1 - similarity + 1e-9
    known = pairs.select("a", "b", "apart").coalesce(parts)
    ends = (F.least("node", "low") == F.col("a")) & (F.greatest("node", "low") == F.col("b"))
    far = F.when(F.col("node") == F.col("low"), 0.0).otherwise(F.col("apart"))
    ringed = checkpoint(members.coalesce(parts).join(known, ends, "left").select("slot", "key", "node", "group", F.floor(far / width).cast("int").alias("ring")).coalesce(parts))
    held = ringed.coalesce(parts).groupBy("slot", "key", "ring").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    beside = held.select("slot", "key", F.explode(F.array(*(F.col("ring") + d for d in (-1, 0, 1)))).alias("ring"), "low", "high")
    mixed = beside.groupBy("slot", "key", "ring").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("slot", "key", "ring")
    return ringed.coalesce(parts).join(checkpoint(mixed.coalesce(parts)).coalesce(parts), ["slot", "key", "ring"], "left_semi").select("node", "group").distinct()


def completed(groups: DataFrame, crowded: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """groups (node, component) joined further by the links between nodes that share a crowded key (slot, key, node, low) and are not yet in one group; pairs is what was measured so far."""
    parts = partitions(crowded.count() + pairs.count())
    named = checkpoint(crowded.coalesce(parts).join(groups.coalesce(parts), "node", "left").select("slot", "key", "node", "low", F.coalesce("component", "node").alias("group")).coalesce(parts))
    named = named.coalesce(parts)
    split = named.groupBy("slot", "key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("slot", "key")
    members = checkpoint(in_reach(named.join(checkpoint(split.coalesce(parts)).coalesce(parts), ["slot", "key"], "left_semi"), pairs, similarity, parts).coalesce(parts))
    if members.isEmpty():
        return groups
    links = checkpoint(links_across(members, sets, similarity))
    if not (more := links.count()):
        return groups
    parts = partitions(more + groups.count() + members.count())
    groups = groups.coalesce(parts)
    ends = [members.select(F.col("node").alias(c), F.col("group").alias(f"{c}_group")).coalesce(parts) for c in ("a", "b")]
    met = links.coalesce(parts).join(ends[0], "a").coalesce(parts).join(ends[1], "b").coalesce(parts)
    joined = checkpoint(connected_components(met, "a_group", "b_group", EACH).select(F.col("node").alias("component"), F.col("component").alias("further")).coalesce(parts)).coalesce(parts)
    # A node without a link so far is a group of its own.
    alone = joined.join(groups.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), "component")
    return checkpoint(groups.unionByName(alone).coalesce(parts).join(joined, "component", "left").select("node", F.coalesce("further", "component").alias("component")).coalesce(parts))


def alike_prints(nodes: DataFrame, max_bits: int, n: int) -> DataFrame:
    """(a, b), a < b: nodes (node, fp), at most n, that SimHash links: of equal fingerprints each with the first, of near ones the first of each."""
    parts = partitions(n)
    nodes = nodes.coalesce(parts)
    firsts = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("one")).coalesce(parts)).coalesce(parts)
    near = checkpoint(near_fingerprints(firsts.select("fp"), max_bits, parts=partitions(BITS * n)).coalesce(parts)).coalesce(parts)
    ends = [firsts.select(F.col("fp").alias(c), F.col("one").alias(f"{c}_one")) for c in ("a", "b")]
    far = near.join(ends[0], "a").coalesce(parts).join(ends[1], "b").coalesce(parts).select(F.col("a_one").alias("a"), F.col("b_one").alias("b"))
    same = nodes.join(firsts, "fp").coalesce(parts).select(F.col("node").alias("a"), F.col("one").alias("b"))
    return far.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")


def _linked(docs: DataFrame, words: int, similarity: float, bands: int, rows: int, bucket: int, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, nodes, groups) of docs (key, node, body): (key, node) of each row, (node, first) of each text, and (node, component) of texts that are linked."""
    found = checkpoint(docs.select("key", "node", _signature(F.col("body"), words, bands, rows).alias("s")))
    n = found.count()
    keyed, long = partitions(bands * n), partitions(BITS * n)
    nodes = checkpoint(found.groupBy("node").agg(F.min("key").alias("first"), F.first("s").alias("s")).coalesce(keyed))
    banded, crowded = candidates(nodes.select("node", F.posexplode("s.keys").alias("slot", "key")), bucket, keyed)
    pairs = checkpoint(banded.unionByName(alike_prints(nodes.select("node", "s.fp"), max_bits, n)).distinct().coalesce(keyed))
    wanted = reduce(DataFrame.unionByName, (pairs.select(F.col(c).alias("node")) for c in ("a", "b"))).distinct()
    texts = docs.select("node", "body").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))
    sets = checkpoint(texts.select("node", _shingles(F.col("body"), words).alias("s")))
    told = checkpoint(measured(pairs, sets, similarity, long))
    groups = checkpoint(connected_components(told.where("alike"), "a", "b", EACH).coalesce(partitions(n)))
    return found.select("key", "node"), nodes.select("node", "first"), completed(groups, crowded, told, sets, similarity)


def _noded(documents: DataFrame, text: str, key: str) -> DataFrame:
    """(key, node, body): node is the XXH64 of the text, a null one as empty."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return documents.select(F.col(key).alias("key"), F.xxhash64(body).alias("node"), body.alias("body"))


def near_groups(
    documents: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 5, bucket: int = 64, max_bits: int = 2
) -> DataFrame:
    """(node, component): the texts, as XXH64, that are linked to another text, and their group. See near_copies()."""
    return _linked(_noded(documents, text, key), words, similarity, bands, rows, bucket, max_bits)[2]


def _grouped(documents: DataFrame, text: str, key: str, words: int, similarity: float, bands: int, rows: int, bucket: int, max_bits: int) -> DataFrame:
    """(key, node, kept): each row's text as a hash, and the smallest (key, node) of its group."""
    found, nodes, groups = _linked(_noded(documents, text, key), words, similarity, bands, rows, bucket, max_bits)
    parts = partitions(found.count())
    named = nodes.select("node", "first").coalesce(parts).join(groups.coalesce(parts), "node", "left").select("node", "first", F.coalesce("component", "node").alias("group"))
    named = checkpoint(named.coalesce(parts)).coalesce(parts)
    least = named.groupBy("group").agg(F.min(F.when(F.col("first").isNotNull(), F.struct("first", "node"))).alias("kept")).coalesce(parts)
    return found.coalesce(parts).join(named.join(least, "group").select("node", "kept").coalesce(parts), "node").coalesce(parts)


def near_copies(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    words: int = 5,
    similarity: float = 0.8,
    bands: int = 20,
    rows: int = 5,
    bucket: int = 64,
    max_bits: int = 2,
) -> DataFrame:
    """(key, component): which documents hang together by links of at least `similarity`.

    component is the smallest key that a document reaches, itself included. One row
    per row of documents; rows with a null key take part in links but never name a
    component unless all its keys are null. Texts without words are alike. An empty
    table gives an empty result; other columns are ignored.
    """
    found = _grouped(documents, text, key, words, similarity, bands, rows, bucket, max_bits)
    return found.select(F.col("key").alias(key), F.col("kept.first").alias("component"))


def drop_near_copies(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    words: int = 5,
    similarity: float = 0.8,
    bands: int = 20,
    rows: int = 5,
    bucket: int = 64,
    max_bits: int = 2,
) -> DataFrame:
    """One row of each group of near copies, with all its columns: the smallest key's.

    Rows that share a key and are unlike are not one group, and both stay; of rows alike
    in key and text any one stays. A row with a null key stays, as the links cannot
    name it.
    """
    found = _grouped(documents, text, key, words, similarity, bands, rows, bucket, max_bits)
    tag, other = free_name(documents, "kept"), free_name(documents, "kept_node")
    keep = found.where((F.col("key") == F.col("kept.first")) & (F.col("node") == F.col("kept.node"))).select(F.col("key").alias(tag), F.col("node").alias(other)).distinct()
    node = free_name(documents, "node")
    named = documents.where(F.col(key).isNotNull()).withColumn(node, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    met = named.join(keep, (named[key] == keep[tag]) & (named[node] == keep[other]), "left_semi").dropDuplicates([key, node]).drop(node)
    return met.unionByName(documents.where(F.col(key).isNull()))
