"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into the runs that no piece crosses (white space, then
anything else); the batch's different runs are concatenated and indexed by a suffix
array sorted to the length of the longest piece. Every piece of the model is
binary-searched in it, all pieces at a time, which gives its range of occurrences;
those are the edges from a place over a length to a piece, kept sorted by place.

The model is byte-pair encoding, so the edges are relaxed in its order and not as a
shortest path: symbols begin as single characters, and again and again the two
neighbours joined by the edge of the best score (the leftmost of equals) become one.
All short runs take their next step at once as array operations; long ones, such as
text without spaces, use a heap over the same edges. A very long run is cut first
where no piece's occurrence reaches over, which changes none of its steps. A character without a piece is
spelt in byte pieces.

The model's file is read on the driver alone and its pieces are broadcast: they are
as many as the vocabulary, whatever the texts are. Encoding and decoding are single
passes without a shuffle.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary(NamedTuple):
    """What matching needs of a model: pieces by id, and ids and scores of those that text can match."""

    pieces: list[str]
    normal: list[int]
    scores: list[float]
    #: id of the piece of each byte.
    byte_ids: list[int]
    controls: frozenset[int]


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a byte-pair model with byte fallback and without normalisation rules."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
    normal = [i for i in ids if i not in special and not model.is_byte(i) and not model.is_unused(i)]
    pieces = [model.id_to_piece(i) for i in ids]
    if any(SPACE in pieces[i].lstrip(SPACE) for i in normal):
        raise ValueError("a piece has a space after other characters")
    return Vocabulary(pieces, normal, [model.get_score(i) for i in ids], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], frozenset(special))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def suffix_array(points: np.ndarray, depth: int) -> np.ndarray:
    """The places of points in order of what begins there, by `depth` points at least.

    As many points as fit are packed into one number; ranks of those are then doubled.
    """
    letters, rank = np.unique(points, return_inverse=True)
    rank = rank.astype(np.int64) + 1  # 0 stands beyond the end
    bits = int(len(letters)).bit_length()
    key, done = rank.copy(), 1
    while done < depth and bits * (done + 1) <= 62:
        key <<= bits
        if done < len(rank):
            key[:-done] |= rank[done:]
        done += 1
    while done < depth:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        key = rank * (len(points) + 2)
        if done < len(rank):
            key[:-done] += rank[done:]
        done *= 2
    return np.argsort(key, kind="stable")


class Matcher:
    """Encodes runs under a vocabulary and remembers what it has encoded."""

    #: Characters of different runs that are indexed at once; runs remembered at most; symbols of a run for array steps; characters of a run that is encoded in parts.
    CHUNK, KEEP, LONG, SPLIT = 400_000, 600_000, 64, 4096

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        texts = [vocabulary.pieces[i] for i in vocabulary.normal]
        self.ids = np.array(vocabulary.normal)
        self.depth = max(map(len, texts))
        self.lengths = np.array([len(t) for t in texts])
        self.chars = np.full((len(texts), self.depth), -1, dtype=np.int64)
        for i, t in enumerate(texts):
            self.chars[i, : len(t)] = _points(t)
        self.score = np.array(vocabulary.scores)
        self.forget()

    def forget(self) -> None:
        """The runs encoded so far by number; their ids lie one after the other in flat."""
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = self.counts = np.zeros(0, dtype=np.int64)

    def ranges(self, points: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) in the suffix array of each piece's occurrences, narrowed a character at a time."""
        low, high = np.zeros(len(self.ids), dtype=np.int64), np.full(len(self.ids), len(order), dtype=np.int64)
        padded = np.append(points, np.full(self.depth, -1, dtype=np.int64))
        for d in range(self.depth):
            on = np.flatnonzero((self.lengths > d) & (low < high))
            want = self.chars[on, d]
            found = []
            for beyond in (False, True):
                a, b = low[on], high[on]
                while (unsettled := a < b).any():
                    mid = (a + b) >> 1
                    at = padded[order[np.minimum(mid, len(order) - 1)] + d]
                    right = unsettled & ((at <= want) if beyond else (at < want))
                    a, b = np.where(right, mid + 1, a), np.where(unsettled & ~right, mid, b)
                found.append(a)
            low[on], high[on] = found
        return low, np.maximum(low, high)

    def edges(self, points: np.ndarray) -> np.ndarray:
        """Table of place by length: the id of the piece that spans it, or -1."""
        order = suffix_array(points, self.depth)
        low, high = self.ranges(points, order)
        counts = high - low
        piece = np.repeat(np.arange(len(self.ids)), counts)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        table = np.full((len(points), self.depth + 1), -1, dtype=np.int32)
        table[order[low[piece] + within], self.lengths[piece]] = self.ids[piece]
        return table

    def parts(self, run: str) -> list[str]:
        """A long run cut where no piece reaches over, so that its parts encode as the run does; indexed a chunk at a time."""
        points = _points(run)
        reach = np.zeros(len(points) + 1, dtype=np.int64)
        for at in range(0, len(points), self.CHUNK):
            # The pieces that begin in the chunk end at most depth characters on.
            table = self.edges(points[at : at + self.CHUNK + self.depth])[: self.CHUNK]
            for n in range(2, self.depth + 1):
                start = np.flatnonzero(table[:, n] >= 0) + at
                reach += np.bincount(start + 1, minlength=len(reach))[: len(reach)]
                reach -= np.bincount(np.minimum(start + n, len(points)), minlength=len(reach))[: len(reach)]
        free = np.flatnonzero(np.cumsum(reach)[1:-1] == 0) + 1
        out, begin = [], 0
        while begin < len(run):
            at = int(np.searchsorted(free, begin + self.LONG))
            end = int(free[at]) if at < len(free) else len(run)
            out.append(run[begin:end])
            begin = end
        return out

    def _short(self, table: np.ndarray, begins: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> None:
        """Marks in whole, for all short runs together, where the last symbols begin."""
        sizes = ends - begins
        start = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        word = np.repeat(np.arange(len(begins)), sizes)
        while len(start):
            last = np.append(word[1:] != word[:-1], True)
            # The end of the next symbol, where there is one in the run.
            after = np.append(start[1:], 0)
            end_next = np.append(after[1:], 0)
            end_next = np.where(np.append(last[1:], True), ends[word], end_next)
            length = np.where(last, 0, end_next - start)
            found = np.where((length > 0) & (length <= self.depth), table[start, np.minimum(length, self.depth)], -1)
            score = np.where(found >= 0, self.score[found], -np.inf)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.maximum.reduceat(score, heads)
            group = np.cumsum(np.append(True, word[1:] != word[:-1])) - 1
            go = best > -np.inf
            candidates = np.flatnonzero((score == best[group]) & go[group])
            first = candidates[np.append(True, group[candidates][1:] != group[candidates][:-1])] if len(candidates) else candidates
            gone = first + 1
            whole[start[gone]] = False
            keep = go[group]
            keep[gone] = False
            start, word = start[keep], word[keep]

    def _long(self, table: np.ndarray, begin: int, end: int, whole: np.ndarray) -> None:
        """The same for one run with a heap."""
        after = {i: i + 1 for i in range(begin, end)}
        before = {i + 1: i for i in range(begin, end - 1)}
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < end and (k := after[j]) - i <= self.depth and (found := table[i, k - i]) >= 0:
                heapq.heappush(heap, (-self.score[found], i, j, k))

        for i in range(begin, end):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if after.get(i) != j or after.get(j) != k:
                continue
            after[i] = k
            del after[j]
            whole[j] = False
            if k < end:
                before[k] = i
            offer(i)
            if i in before:
                offer(before[i])

    def learn(self, runs: list[str]) -> None:
        """Encodes different runs together."""
        text = "\0".join(runs)
        points = _points(text)
        sizes = np.array([len(r) for r in runs])
        begins = np.cumsum(sizes + 1) - sizes - 1
        table = self.edges(points)
        whole = np.ones(len(points), dtype=bool)
        short = sizes <= self.LONG
        self._short(table, begins[short], (begins + sizes)[short], whole)
        for i in np.flatnonzero(~short):
            self._long(table, int(begins[i]), int(begins[i] + sizes[i]), whole)
        whole[begins[1:] - 1] = False  # between the runs
        at = np.flatnonzero(whole)
        owner = np.searchsorted(begins, at, side="right") - 1
        ends = np.append(at[1:], 0)
        last = np.append(owner[1:] != owner[:-1], True)
        ids = table[at, np.where(last, (begins + sizes)[owner], ends) - at]
        widths = np.ones(len(ids), dtype=np.int64)
        spelt = {n: self.spell(text[at[n]]) for n in np.flatnonzero(ids < 0).tolist()}
        for n, own in spelt.items():
            widths[n] = len(own)
        flat = np.repeat(ids, widths).astype(np.int32)
        for n, place in zip(spelt, (np.cumsum(widths) - widths)[list(spelt)].tolist(), strict=True):
            flat[place : place + len(spelt[n])] = spelt[n]
        counts = np.bincount(owner, weights=widths, minlength=len(runs)).astype(np.int64)
        self.number.update(zip(runs, range(len(self.counts), len(self.counts) + len(runs)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, flat])

    def spell(self, character: str) -> list[int]:
        return [self.v.byte_ids[b] for b in character.encode("utf-8", "replace")]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif "  " in t or SPACE in t or t[0] == " " or t[-1] == " ":
                cut.append(RUN.findall(SPACE + t.replace(" ", SPACE)))
            else:
                cut.append((SPACE + t.replace(" ", f" {SPACE}")).split(" "))
        for runs in cut:
            if any(len(r) > self.SPLIT for r in runs):
                runs[:] = chain.from_iterable(self.parts(r) if len(r) > self.SPLIT else (r,) for r in runs)
        if len(self.number) > self.KEEP:
            self.forget()
        new, size = [], 0
        for run in set(chain.from_iterable(cut)) - self.number.keys():
            new.append(run)
            size += len(run) + 1
            if size >= self.CHUNK:
                self.learn(new)
                new, size = [], 0
        if new:
            self.learn(new)
        ends = np.cumsum([len(runs) for runs in cut])
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(ends[-1]) if len(ends) else 0)
        counts = self.counts[numbers]
        stops = np.append(0, np.cumsum(counts))
        places = np.repeat(self.starts[numbers] - stops[:-1], counts) + np.arange(stops[-1])
        return np.split(self.flat[places], stops[ends[:-1]]) if len(ends) else []


class Decoder:
    """Texts of ids: byte pieces as UTF-8, control pieces as nothing, without the leading space that encoding puts."""

    def __init__(self, vocabulary: Vocabulary):
        self.parts = [b"" if i in vocabulary.controls else p.replace(SPACE, " ").encode() for i, p in enumerate(vocabulary.pieces)]
        for byte, i in enumerate(vocabulary.byte_ids):
            self.parts[i] = bytes([byte])

    def __call__(self, ids) -> str:
        given = () if ids is None else np.asarray(ids, dtype=np.int64).tolist()
        text = b"".join(map(self.parts.__getitem__, given)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(documents: DataFrame, text: str = "text", model: str = MODEL, decoded: str | None = None) -> DataFrame:
    """documents with ids: the piece ids of text; with a name in decoded, also the text that these decode to.

    All rows and columns are kept, but columns of those names are replaced. The ids are
    those that the model's own library gives. A null or empty text has no ids.
    """
    docs = documents.drop("ids", *([decoded] if decoded else []))
    shape = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    shared = documents.sparkSession.sparkContext.broadcast(tuple(load(model)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = Vocabulary(*shared.value)
        matcher, back = Matcher(v), Decoder(v)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                found = matcher.encode(list(part[text]))
                yield part.assign(ids=found, **({decoded: [back(x) for x in found]} if decoded else {}))

    return docs.mapInPandas(run, shape)


def decode(encoded: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """encoded with the text of ids in a column called text, which is replaced if there.

    Null or no ids give an empty text. Decoding what encode() gave returns the text
    but for U+2581, which comes back as a space; bytes that are no UTF-8 come back as
    U+FFFD.
    """
    rows = encoded.drop(text)
    shape = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(load(model)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back = Decoder(Vocabulary(*shared.value))
        for batch in batches:
            yield batch.assign(**{text: [back(x) for x in batch[ids]]})

    return rows.mapInPandas(run, shape)
