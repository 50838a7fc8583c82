"""Spelling variants: words one edit apart, found by blocked products of letter counts.

A word becomes a vector of letter counts. One inserted or deleted letter moves that vector by
a squared distance of 1, a replaced one by 2, so of all pairs only those at most two apart,
in equal or adjacent lengths, need a look. Squared distances of two blocks of words come from one NumPy
product of their matrices; pairs that stay are verified letter by letter.

Blocks are not multiplied all with all. A block holds words of one length and of the same
counts in a few groups of letters. An edit changes at most one group by one, or two
groups by one in opposite directions, so a block meets itself and a bounded number of
others, which it names as keys of an equality join: every pair is met once. A
block that is larger than a product should be is divided by the words' hashes, and its
parts meet each other in as many tasks; no block is gathered whole anywhere. The rows of that join are
parts of blocks, not words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Runs of letters: ASCII's and those of U+00C0 to U+00FF.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Letters of a word that has at least this many are looked at.
MIN_LENGTH = 7

#: Groups of letters whose counts name a block, with its length; letters of none are one more. Of these seven, a block names seven blocks of one letter more and the 21 of two groups.
GROUPS = ("a", "eé", "iou", "bcdfghj", "klmn", "pqrs")

#: Words of a part of a block, and letters: a part of long words has fewer.
PART_WORDS, PART_LETTERS = 1024, 1 << 16

#: Dimensions of a letter-count vector: a to z, and U+00C0 to U+00FF; other letters share them.
DIMENSIONS = 90

#: Letters of pairs that are compared at once.
COMPARED = 1 << 22


def runs(text: Column, least: int) -> Column:
    """The maximal runs of letters of at least so many, with A to Z in lower case; of null, none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([{LETTERS}]{{{least},}})"), 1)
    return F.transform(found, lambda run: F.translate(run, UPPER, LOWER))


def misspelt(key: Column, run: Column, every: int = 31) -> Column:
    """run, or run without one letter where the CRC-32 of `<key>:<run>` is a multiple of every; a null key is empty text."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    place = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, word: str = "word", least: int = 2) -> DataFrame:
    """(word, n) of the different words that occur at least so often; nulls are none. Spark counts in the tasks before it shuffles."""
    return words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _group_counts(word: Column) -> list[Column]:
    """How many letters of each group a word has; letters of no group show in its length alone."""
    size = F.length(word)
    return [(size - F.length(F.translate(word, letters, ""))).cast("int") for letters in GROUPS]


def _moves() -> str:
    """SQL of the steps from a block to those that its words are compared with: none, one letter more in any group, and one letter moved to a later group.

    A last group has all letters of none, and no count of its own. Of two blocks that one replaced letter
    parts, the one that has it in the earlier group names the other.
    """
    n = len(GROUPS)
    step = lambda longer, up, down: f"named_struct('longer', {longer}, 'by', array({', '.join(str(int(i == up) - int(i == down)) for i in range(n))}))"
    steps = [step(0, None, None), *(step(1, i, None) for i in range(n + 1)), *(step(0, j, i) for i in range(n + 1) for j in range(i + 1, n + 1))]
    return f"array({', '.join(steps)})"


def _parts(words: DataFrame) -> DataFrame:
    """(block, part, size, counts, words): the words of a block in parts of bounded size."""
    keyed = words.select("word", F.length("word").alias("size"), F.array(*_group_counts(F.col("word"))).alias("counts"))
    sizes = keyed.groupBy("size", "counts").agg(F.count("*").alias("n_block"))
    room = F.greatest(F.lit(1), F.least(F.lit(PART_WORDS), (F.lit(PART_LETTERS) / F.col("size")).cast("int")))
    many = sizes.withColumn("n_parts", F.ceil(F.col("n_block") / room)).where("n_parts > 1")
    part = F.pmod(F.xxhash64("word"), F.coalesce("n_parts", F.lit(1)))
    dealt = keyed.join(many.select("size", "counts", "n_parts"), ["size", "counts"], "left").withColumn("part", part)
    return dealt.groupBy("size", "counts", "part").agg(F.collect_list("word").alias("words"))


class Block:
    """Words of one length as code points and as letter counts."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
        size = self.codes.shape[1]
        letters = np.where(self.codes < 128, self.codes - 97, self.codes - 166) % DIMENSIONS
        places = letters + np.arange(len(words), dtype=np.int64)[:, None] * DIMENSIONS
        counts = np.bincount(places.ravel(), minlength=len(words) * DIMENSIONS).reshape(len(words), DIMENSIONS)
        self.counts = counts.astype(np.float32 if size < 2000 else np.float64)  # squares are exact
        self.squares = (self.counts**2).sum(axis=1)


def near_in(a: Block, b: Block) -> list[tuple[str, str]]:
    """The pairs of a word of a and one of b, which are of the same length or one longer, that differ by exactly one edit; of a block with itself, each pair once."""
    apart = a.squares[:, None] + b.squares - 2 * (a.counts @ b.counts.T)
    left, right = np.nonzero(apart <= 2)
    if a is b:
        once = left < right
        left, right = left[once], right[once]
    size, same = a.codes.shape[1], a.codes.shape[1] == b.codes.shape[1]
    found = []
    step = max(1, COMPARED // size)
    for at in range(0, len(left), step):
        i, j = left[at : at + step], right[at : at + step]
        x, y = a.codes[i], b.codes[j]
        if same:
            near = (x != y).sum(axis=1) == 1
        else:
            ahead = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
            behind = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            near = ahead + behind >= size
        found += [(a.words[p], b.words[q]) for p, q in zip(i[near], j[near], strict=True)]
    return found


def packed(parts: Iterator[list[str]]) -> Iterator[list[str]]:
    """Lists of words put together while they are small."""
    held: list[str] = []
    for part in parts:
        if held and len(held) + len(part) > PART_WORDS:
            yield held
            held = []
        held = held + part
    if held:
        yield held


def near_pairs(words: DataFrame, word: str = "word") -> DataFrame:
    """(a, b): the pairs of different words that differ by exactly one inserted, deleted or replaced code point, each pair once.

    words holds different words, none empty or null. How many pairs there are is bounded by the
    words' letters, not by the square of their number.
    """
    parts = checkpoint(_parts(words.select(F.col(word).alias("word"))))
    moved = parts.select("size", "counts", "part", "words", F.explode(F.expr(_moves())).alias("move"))
    reached = F.zip_with("counts", "move.by", lambda a, b: a + b)
    is_own = (F.col("move.longer") == 0) & F.forall("move.by", lambda b: b == 0)
    asked = moved.select((F.col("size") + F.col("move.longer")).alias("size"), reached.alias("counts"), "part", "words", F.col("move.longer").alias("longer"), is_own.alias("is_own")).where(F.forall("counts", lambda c: c >= 0))
    held = parts.select("size", "counts", F.col("part").alias("other"), F.col("words").alias("others"))
    met = asked.join(held, ["size", "counts"]).where("NOT is_own OR part <= other")
    met = met.select("words", "others", "size", "counts", "other", "longer", F.expr("is_own AND part = other").alias("itself"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str]] = []
            words, others = batch.column("words"), batch.column("others")
            rows = enumerate(zip(*(batch.column(c).to_pylist() for c in ("size", "counts", "other", "longer", "itself")), strict=True))
            for _, together in groupby(rows, lambda row: row[1][:3]):  # rows of one key follow each other in a join
                met = list(together)
                b = Block(others[met[0][0]].as_py())
                for kind in {row[3:] for _, row in met}:
                    if kind == (0, True):
                        found += near_in(b, b)
                    else:
                        for part in packed(words[at].as_py() for at, row in met if row[3:] == kind):
                            found += near_in(Block(part), b)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.string()) for i in (0, 1)], names=["a", "b"])

    return met.mapInArrow(run, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Forms have no cycles; each round halves what is left of every way."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = checkpoint(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not then.where("moved").limit(1).count():
            return then.select("word", "root")
        now = then.select("word", "root")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n), different words with their numbers of occurrences.

    A word's form is its near word of largest n (of equals the smallest by code points)
    if that n is at least `times` the word's, root where its forms end. Words without near words keep their row. An empty table gives an empty one.
    """
    if times <= 1:
        raise ValueError("a form must occur more often than its word")
    words = checkpoint(words.select("word", "n"))
    pairs = checkpoint(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    valued = both.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("b"))).alias("best")
    near = valued.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    formed = checkpoint(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    found = formed.join(roots(formed.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def words_of(documents: DataFrame, text: str = "text", key: str = "doc_id", least: int = 2) -> DataFrame:
    """(word, n): the words of at least MIN_LENGTH letters of the texts that occur at least so often overall.

    A run of letters is a word once the letter that misspelt() takes is gone. Null and
    empty texts have none; repeated rows count each; other columns are ignored.
    """
    found = documents.select(F.col(key).alias("key"), F.explode(runs(F.col(text), MIN_LENGTH)).alias("run"))
    words = found.select(misspelt(F.col("key"), F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return counted(words, least=least)
