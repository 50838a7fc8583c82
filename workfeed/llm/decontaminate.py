"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased over A-Z and cut into words: runs of ASCII digits, letters
and non-ASCII bytes. A window is `window` consecutive words of an item (an item with
fewer words, but not none, is one window). Words of items are numbered, and the
automaton runs over word numbers. Its keys are seeds: the words of every item at
regular places, so dense that each window has a whole seed in it, and an item of one
window as a whole. The automaton passes over each document's words once; around a seed
the item and the document are compared word by word to both sides, and a stretch that
has the length of a window is a match. It is given in word numbers and in offsets of
the original text.

Seeds take about one node of the automaton for each word of an item, where all windows
written out would take ten times its letters; with the items' word numbers that is some
25 bytes for each byte of item text. An automaton is built once in each Python worker
from the broadcast item texts, whose bytes are summed first: up to `block_bytes` they
are one block and the documents are passed over in place, without any shuffle. A larger
item table is cut into blocks of that size; each block is then scanned for itself and
the matches meet by a shuffle on the document, so neither driver nor worker ever holds
more than one block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, free_name

#: A-Z to a-z; every other ASCII byte that is no digit or letter to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

SPAN = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Items:
    """Items indexed for matching: (item_id, text) pairs of which equal word sequences are one."""

    #: Places of a seed beyond which it is replaced.
    SHARED = 64

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick

        self.window = window
        self.number: dict[bytes, int] = {}
        owners: dict[bytes, set[str | None]] = {}
        for item, text in items:
            if words := words_of(text):
                owners.setdefault(b" ".join(words), set()).add(item)
        self.ids: list[tuple[str | None, ...]] = []
        self.words: list[np.ndarray] = []
        seeds: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        # A window of w words holds one of the seeds of s words that begin w - s + 1 words apart.
        size = max(1, (window * 3) // 5)
        for line, own in owners.items():
            words = [self.number.setdefault(w, len(self.number) + 1) for w in line.split()]
            at = len(self.ids)
            self.ids.append(tuple(sorted(own, key=lambda x: (x is None, x))))
            self.words.append(np.array(words, dtype=np.int32))
            if len(words) < window:
                seeds.setdefault(tuple(words), []).append((at, 0))
            else:
                for i in range(0, len(words) - size + 1, window - size + 1):
                    seeds.setdefault(tuple(words[i : i + size]), []).append((at, i))
        # A seed that many items share, such as a usual opening, gives way to the windows that hold it.
        for key in [k for k, places in seeds.items() if len(k) == size < window and len(places) > self.SHARED]:
            for at, i in seeds.pop(key):
                own = self.words[at].tolist()
                whole = len(own) < window
                for first in [0] if whole else range(max(0, i - window + size), min(i, len(own) - window) + 1):
                    seeds.setdefault(tuple(own[first : first + window]), []).append((at, first))
        self.automaton = None
        if seeds:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, places in seeds.items():
                if len(key) == window:  # a whole window tells of an item all there is to tell, wherever the item has it
                    places = dict(places).items()
                self.automaton.add_word(key, (len(key), tuple(places)))
            self.automaton.make_automaton()

    def runs(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """The stretches (first, last word) of a text's words by item number, as long as they match or in parts that together are."""
        get = self.number.get
        numbers = tuple(get(w, 0) for w in words)
        out: dict[int, list[tuple[int, int]]] = {}
        upto: dict[tuple[int, int], int] = {}
        for end, (size, places) in self.automaton.iter(numbers):
            start = end - size + 1
            for item, at in places:
                if size == self.window:
                    found = out.setdefault(item, [])
                    if found and found[-1][0] <= start <= found[-1][1] + 1:
                        found[-1] = (found[-1][0], max(end, found[-1][1]))
                    else:
                        found.append((start, end))
                    continue
                if upto.get((item, start - at), -1) >= start:
                    continue  # in a stretch that was compared already
                own = self.words[item]
                a, b = start, end
                while a > 0 and at - (start - a) > 0 and numbers[a - 1] == own[at - (start - a) - 1]:
                    a -= 1
                while b + 1 < len(numbers) and at + (b + 1 - start) < len(own) and numbers[b + 1] == own[at + (b + 1 - start)]:
                    b += 1
                upto[item, start - at] = b
                if b - a + 1 >= min(self.window, len(own)):
                    out.setdefault(item, []).append((a, b))
        return out


def scan(text: str | None, items: Items) -> tuple[int, list[tuple[str | None, int, int, int, int]]]:
    """Number of words, and the maximal stretches (item, first word, last word, start, end) in code points."""
    raw = (text or "").encode("utf-8", "replace")
    folded = raw.translate(FOLD)
    words = folded.split()
    if items.automaton is None or not words:
        return len(words), []
    runs = items.runs(words)
    if not runs:
        return len(words), []
    by_item: dict[str | None, list[tuple[int, int]]] = {}
    for item, found in runs.items():
        for name in items.ids[item]:
            by_item.setdefault(name, []).extend(found)
    places = [m.span() for m in re.finditer(rb"[^ ]+", folded)]
    out = []
    for item, found in sorted(by_item.items(), key=lambda x: (x[0] is None, x[0])):
        found.sort()
        joined = [list(found[0])]
        for a, b in found[1:]:
            if a <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        for a, b in joined:
            start = len(raw[: places[a][0]].decode("utf-8", "replace"))
            out.append((item, a, b, start, start + len(raw[places[a][0] : places[b][1]].decode("utf-8", "replace"))))
    return len(words), out


_built: dict[str, Items] = {}


def built(name: str, shared: Broadcast, window: int) -> Items:
    """The index of a broadcast's items, made once in a Python worker, which keeps the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(shared.value, window)
    return _built[name]


def _scanner(shared: Broadcast, window: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = built(name, shared, window)
        for batch in batches:
            text = batch.columns[-1]
            done = [scan(t, items) for t in batch[text]]
            out = batch.drop(columns=[text])
            out["n_words"] = [n for n, _ in done]
            out["spans"] = [[dict(zip(SPAN.names, s, strict=True)) for s in spans] for _, spans in done]
            yield out

    return run


def find_contamination(
    documents: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """(key, n_words, spans): the stretches of every document that repeat item windows.

    spans: array of (item_id string, first_word, last_word, start, end), ordered by
    item and place; overlapping and adjoining windows of an item are one span; word
    numbers are inclusive and from 0, start and end count code points of the
    original text (end exclusive). One row per row of documents. A null or empty
    text has no words and no spans; items with null or empty text have no windows;
    items that repeat a text all own its matches; a null item_id owns matches like any
    other, last in order. Other columns of either table are ignored whatever their names.
    """
    docs = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))
    kind = docs.schema["key"].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])
    blocks = item_blocks(items, item_key, item_text, block_bytes)

    if len(blocks) == 1:
        return docs.mapInPandas(_scanner(blocks[0](), window), out).withColumnRenamed("key", key)

    tag = free_name(docs, "digest")
    tagged = docs.withColumn(tag, F.sha2(F.coalesce("body", F.lit("")), 256))
    each = T.StructType([out["key"], T.StructField(tag, T.StringType()), *out.fields[1:]])
    parts = [tagged.dropDuplicates(["key", tag]).select("key", tag, "body").mapInPandas(_scanner(block(), window), each) for block in blocks]
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    met = met.groupBy("key", tag).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    left, right = tagged.select("key", tag).alias("l"), met.alias("r")
    return left.join(right, F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col(f"l.{tag}") == F.col(f"r.{tag}"))).select(
        F.col("l.key").alias(key), "n_words", "spans"
    )


def item_blocks(items: DataFrame, item_key: str, item_text: str, block_bytes: int) -> list[Callable[[], Broadcast]]:
    """Makers of broadcasts of (item, text), of about block_bytes at most, which together hold all items."""
    rows = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).cast("string").alias("body")).where("body IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("body") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    context = items.sparkSession.sparkContext

    def maker(i: int) -> Callable[[], Broadcast]:
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == i)
        return lambda: context.broadcast([(r.item, r.body) for r in part.collect()])

    return [maker(i) for i in range(n)]


def hit_words(spans: Column) -> Column:
    """How many different words the spans cover."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first_word"].alias("a"), s["last_word"].alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto"))
    return F.aggregate(
        ordered,
        zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"] - 1, acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["b"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def drop_contaminated(
    documents: DataFrame, items: DataFrame, text: str = "text", window: int = 10, item_key: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20
) -> DataFrame:
    """The rows of documents in which no item window occurs, with all their columns.

    Rows with null or empty text have no words and stay. There is no shuffle: each block
    of items is a pass over the rows that the one before has left.
    """

    def keep(shared: Broadcast):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = built(name, shared, window)
            for batch in batches:
                yield batch[[not scan(t, found)[1] for t in batch[text]]]

        return run

    out = documents
    for i, block in enumerate(item_blocks(items, item_key, item_text, block_bytes)):
        # One automaton in memory at a time: what a block has left is written before the next.
        out = (checkpoint(out) if i else out).mapInPandas(keep(block()), documents.schema)
    return out
