"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance of being toxic is a logistic
function of its words, the document's is the noisy-or of its sentences': one minus
the product of what each leaves over. Only documents are labelled; the gradient of
the document's loss tells how far each sentence is to blame, and so the weights learn
to point at sentences.

A word's weight is the sum over its features, the word and its first 3, 4 and 5
letters; each different word of a sentence counts once. The model is fitted on at
most `sample_rows` labelled documents (the first by a hash of their key), read
whole; that bound and `max_features` also bound the weights, which are broadcast.
Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")

MODEL = T.StructType([T.StructField("feature", T.StringType()), T.StructField("weight", T.DoubleType())])
#: The name of the intercept among the features; no feature of a word is empty.
BIAS = ""

FOUND = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in (3, 4, 5) if len(word) > n)]


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, words) of each sentence that has words; offsets in code points."""
    text = text or ""
    for m in SENTENCE.finditer(text):
        if found := set(WORD.findall(m[0].lower())):
            yield m.start(), m.end(), found


def fit(bags: Iterable[list[set[str]]], labels: list[int], max_features: int = 50_000, rounds: int = 150, rate: float = 0.1, sparse: float = 1e-4, least: int = 5) -> dict[str, float]:
    """Weights by feature, BIAS among them, that minimise the bags' log loss.

    Full-batch Adam with a penalty of `sparse` on each weight's size, which leaves most
    at zero, so that rare words don't learn bags by heart. Features of fewer than
    `least` bags are left out, and beyond max_features those of the fewest. Without bags of both labels only the bias is learnt.
    """
    # One bag of word sets is in memory at a time; what stays is a number a word.
    words: dict[str, int] = {}
    spelled, counts, owner = array("i"), array("i"), array("i")
    seen: Counter[str] = Counter()
    n_bags = 0
    for bag in bags:
        for found in bag:
            spelled.extend(words.setdefault(w, len(words)) for w in found)
            counts.append(len(found))
            owner.append(n_bags)
        seen.update({f for found in bag for w in found for f in features(w)})
        n_bags += 1
    names = [f for f, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:max_features] if n >= least]
    del seen
    number = {f: i for i, f in enumerate(names)}
    known = [[number[f] for f in features(w) if f in number] for w in words]
    del words
    entries, lengths, start = array("i"), [], 0
    for n in counts:
        before = len(entries)
        for w in spelled[start : start + n]:
            entries.extend(known[w])
        start += n
        lengths.append(len(entries) - before)
    at, owner, y = np.frombuffer(entries or array("i", [0]), dtype=np.int32)[: len(entries)], np.array(owner), np.array(labels, dtype=float)
    row = np.repeat(np.arange(len(lengths)), lengths)
    x, m, v = np.zeros(len(names) + 1), 0.0, 0.0
    x[-1] = -5.0
    for step in range(1, rounds + 1 if n_bags else 1):
        z = np.clip(np.bincount(row, x[at], minlength=len(lengths)) + x[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_bags)
        some = np.maximum(-np.expm1(none), 1e-9)
        blame = np.where(y[owner] > 0, -(np.exp(none) / some)[owner], 1.0) * p
        g = np.append(np.bincount(at, blame[row], minlength=len(names)), blame.sum()) / n_bags
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-5)
        x -= pace * m / (1 - 0.9**step)
        x[:-1] = np.sign(x[:-1]) * np.maximum(np.abs(x[:-1]) - pace[:-1] * sparse, 0)
    return {f: float(x[i]) for f, i in number.items() if abs(x[i]) > 1e-3} | {BIAS: float(x[-1])}


def train(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_rows: int = 6000, max_features: int = 50_000) -> dict[str, float]:
    """The model fitted in one task to at most sample_rows labelled documents.

    labels: key and label (0 or 1); rows with a null in either are left out, of rows
    that repeat a key the highest label and the smallest text hold. Documents without a
    label, and labels without a document, are ignored and not counted. Without labelled documents no text is toxic.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("body"))
    sample = known.join(docs.select("key"), "key", "left_semi").orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    # sample has at most sample_rows rows of two numbers.
    rows = docs.join(F.broadcast(sample), "key").groupBy("key").agg(F.max("label").alias("label"), F.min("body").alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted((k, y, body or "") for b in batches for k, y, body in zip(b["key"], b["label"], b["body"], strict=True))
        model = fit(([w for _, _, w in sentences(t)] for _, _, t in got), [y for _, y, _ in got], max_features)
        yield pd.DataFrame(list(model.items()), columns=MODEL.names)

    fitted = rows.repartition(1).mapInPandas(run, MODEL)
    return {r.feature: r.weight for r in fitted.collect()} or {BIAS: -30.0}


class Scorer:
    """Scores texts under a model; remembers the weights of the words it has met."""

    def __init__(self, model: dict[str, float]):
        self.model, self.known = model, {}

    def word(self, w: str) -> float:
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = sum(self.model.get(f, 0.0) for f in features(w))
        return self.known[w]

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of the sentences at 0.5 or more."""
        bias, left, found = self.model[BIAS], 0.0, []
        for start, end, words in sentences(text):
            z = max(-30.0, min(30.0, bias + math.fsum(map(self.word, words))))
            p = 1 / (1 + math.exp(-z))
            left += math.log1p(-p)
            if p >= 0.5:
                found.append((start, end, p))
        return -math.expm1(left), found


def score(documents: DataFrame, model: dict[str, float], text: str = "text") -> DataFrame:
    """documents with score (0 to 1) and offending, the sentences at 0.5 or more.

    All rows and columns are kept, but columns of those two names are replaced.
    offending is an array of (start, end, score), offsets in code points. A text
    without words (null and empty ones too) scores 0. Equal texts score equally.
    """
    docs = documents.drop("score", "offending")
    shape = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(FOUND))])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Scorer(shared.value)
        for batch in batches:
            done = [judge(t) for t in batch[text]]
            found = [[dict(zip(FOUND.names, s, strict=True)) for s in spans] for _, spans in done]
            yield batch.assign(score=[s for s, _ in done], offending=found)

    return docs.mapInPandas(run, shape)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: the CRC-32 of its key as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
