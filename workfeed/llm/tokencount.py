"""Counts of byte-pair tokens without the tokens: merges on a heap and a linked list.

A text is cut at the special strings of the vocabulary, each of which is one token,
and what lies between into pre-tokens by the byte-level pattern. A pre-token begins as
one symbol a byte, linked to its neighbours. The heap holds every adjacent pair that
the vocabulary joins, by rank and then from the left; popping the lowest joins its two
symbols, and the pairs with the new neighbours are put on the heap. A popped pair
whose symbols have meanwhile changed is passed over. Each join takes one symbol away, so the
count is the bytes less the joins; no token and no identifier is made.

The vocabulary's file is read on the driver alone; its ranks are broadcast, and are as
many as the vocabulary whatever the texts are. Counting is a single pass without a shuffle,
each worker remembering the counts of the last pre-tokens, up to a bound. A text is
read match by match, so its pre-tokens are never in memory together; joining a
single pre-token takes some hundred bytes of memory for each of its own.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the byte-level pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary(NamedTuple):
    """What counting needs: the rank of each joined pair of byte strings, and the strings that are one token wherever they stand."""

    ranks: dict[tuple[str, str], int]
    special: list[str]


@cache
def patterns() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    """PATTERN; characters that only the regex module knows as letters or numbers; PATTERN with those as neither.

    The vocabulary's library has the Unicode tables of this interpreter, the regex module later ones.
    """
    known = regex.compile(r"[\p{L}\p{N}]")
    late = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c)))
    late = "".join(f"{run[0]}-{run[-1]}" for run in runs(late))
    letter, number, other = rf"[\p{{L}}--[{late}]]", rf"[\p{{N}}--[{late}]]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{late}])"
    exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", other).replace(r"\p{L}+|", f"{letter}+|").replace(r"\p{N}+|", f"{number}+|")
    return regex.compile(PATTERN), regex.compile(f"[{late}]"), regex.compile("(?V1)" + exact)


def runs(characters: str) -> list[str]:
    """Ascending characters, cut where one does not follow its predecessor."""
    return ["".join(c for _, c in run) for _, run in groupby(enumerate(characters), lambda x: ord(x[1]) - x[0])]


def byte_letters() -> dict[str, str]:
    """The letter by which a byte-level vocabulary writes a byte, to that byte: printable ones stand for themselves, the others follow U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): chr(b) for b in own} | {chr(0x100 + n): chr(b) for n, b in enumerate(others)}


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a byte-level byte-pair file; a ValueError for one with settings that would change the counts."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, cut = data["model"], data["pre_tokenizer"] or {}
    added = data["added_tokens"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer", "truncation", "padding") if data.get(k)]
    odd += [k for k in ("single_word", "lstrip", "rstrip", "normalized") for t in added if t[k]]
    letters = byte_letters()
    if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or not letters.keys() <= model["vocab"].keys():
        odd.append("no plain byte-level byte-pair model")
    if odd:
        raise ValueError(f"{path}: {', '.join(odd)}")
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    as_bytes = lambda piece: "".join(letters[c] for c in piece)
    return Vocabulary({(as_bytes(a), as_bytes(b)): n for n, (a, b) in enumerate(pairs)}, [t["content"] for t in added])


def joined(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left of one pre-token, whose bytes are the characters of symbols."""
    n = len(symbols)
    at: list[str | None] = list(symbols)
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((at[i], at[i + 1]))) is not None]
    if not heap:
        return n
    heapify(heap)
    after, before, joins = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if at[i] is None or j == n or ranks.get((at[i], at[j])) != rank:
            continue
        at[i], at[j] = at[i] + at[j], None
        joins += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((at[i], at[k]))) is not None:
                heappush(heap, (rank, i))
        h = before[i]
        if h >= 0 and (rank := ranks.get((at[h], at[i]))) is not None:
            heappush(heap, (rank, h))
    return n - joins


class Counter(dict):
    """Counts of pre-tokens, made when first asked for; long ones are not kept, and all are forgotten when they are many."""

    KEEP, LONG = 1 << 18, 48

    #: Characters up to which the pre-tokens of a text are listed at once.
    AT_ONCE = 1 << 20

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.ranks, self.unsure = vocabulary.ranks, False
        self.find, self.late, self.exact = patterns()
        special = sorted(filter(None, vocabulary.special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, token: str) -> int:
        n = joined(token.encode().decode("latin-1"), self.ranks)
        if self.late.search(token):
            self.unsure = True
        elif len(token) <= self.LONG:
            if len(self) >= self.KEEP:
                self.clear()
            self[token] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings; one with characters that the patterns class differently is cut again by the exact one."""
        self.unsure = False
        n = self.cut(self.find, text)
        return self.cut(self.exact, text) if self.unsure else n

    def cut(self, find: regex.Pattern, text: str) -> int:
        if len(text) <= self.AT_ONCE:
            return sum(map(self.__getitem__, find.findall(text)))
        return sum(self[m[0]] for m in find.finditer(text))

    def __call__(self, text: str | None) -> int:
        """Tokens of a whole text; of null and of the empty text, none."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        total = start = 0
        for m in self.special.finditer(text):
            total += self.plain(text[start : m.start()]) + 1
            start = m.end()
        return total + self.plain(text[start:])


def n_tokens(documents: DataFrame, text: str | Column = "text", model: str = MODEL) -> Column:
    """A column with the number of tokens of a text column of documents, as the library gives it for the vocabulary in model.

    Special strings inside a text are one token each; none is added at its ends.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tuple(load(model)))
    known: list[Counter] = []

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not known:
            known.append(Counter(Vocabulary(*shared.value)))
        return pd.Series([known[0](t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(documents: DataFrame, text: str = "text", model: str = MODEL, limit: int = 1024) -> DataFrame:
    """documents with n_bytes (of the text in UTF-8), n_tokens, and over_limit: whether those are more than limit.

    All rows and columns are kept, but columns of those names are replaced; text may be
    one of them. A null or empty text has no bytes and no tokens. Repeated rows are
    counted each, an empty table gives an empty one.
    """
    made = {
        "n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
        "n_tokens": n_tokens(documents, F.col(text), model),
    }
    own = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in (*made, "over_limit")]
    counted = documents.select(*own, *(c.alias(name) for name, c in made.items()))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
