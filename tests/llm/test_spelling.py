import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from workfeed.llm import spelling


def one_edit(a, b):
    """Whether b is a with exactly one code point inserted, deleted or replaced, by trying."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_words(rows):
    """(doc_id, text) to the numbers of occurrences."""
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def brute(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def misspell(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]])


def test_near_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    letters = "aaeehilnrstéÿÀ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(250)}
    words |= {misspell(rng, w, letters) for w in sorted(words) for _ in range(3)} - {""}
    words |= {"a" * n for n in range(1, 12)} | {"\U0001f600" * 7, "\U0001f600" * 6, "zz日本語zz", "zz日本zz"}
    table = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(want) > 500
    for size in (1024, 3):
        monkeypatch.setattr(spelling, "PART_WORDS", size)
        monkeypatch.setattr(spelling, "COMPARED", size * 10)
        got = [tuple(sorted(r)) for r in spelling.near_pairs(table).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_very_long_words(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(70_000))
    words = [long, long[:500] + long[501:], long[:9] + "z" + long[10:], long[:9] + "yy" + long[9:], long[::-1]]
    got = {tuple(sorted(r)) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {tuple(sorted((words[0], w))) for w in words[1:3]}


def test_words_and_forms_equal_brute_force(spark):
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(7, 10))) for _ in range(12)]
    texts = []
    for i in range(400):
        run = [rng.choice(common[:4]) for _ in range(8)] + [misspell(rng, rng.choice(common), "abcé") for _ in range(3)]
        texts.append((i if i % 7 else None, " ".join(w.upper() if rng.random() < 0.2 else w for w in run) + ". ÉTAGES, short", "n"))
    texts += [(5, None, "n"), (6, "", "n"), *[(7, "repeated repeatde repeated", "n")] * 3]
    docs = spark.createDataFrame(texts, "doc_id long, text string, word string")
    words = brute_words([t[:2] for t in texts])
    counts = spelling.words_of(docs)
    assert {r.word: r.n for r in counts.collect()} == words
    got = sorted((tuple(r) for r in spelling.variants(counts).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])
    assert got == brute(words)
    assert any(r[1] for r in got)


def test_forms_are_followed_to_the_last(spark):
    chain = ["aaaaaaa" + "b" * i for i in range(9)]
    words = spark.createDataFrame([(w, 10**i) for i, w in enumerate(chain)], "word string, n long")
    got = {r.word: r for r in spelling.variants(words).collect()}
    assert {r.root for r in got.values()} == {chain[-1]}
    assert [got[w].form for w in chain] == [*chain[1:], None]
    ties = spark.createDataFrame([("aaaaaaaa", 2), ("baaaaaaa", 20), ("éaaaaaaa", 20), ("aaaaaaa", 20)], "word string, n long")
    assert {r.word: r.form for r in spelling.variants(ties).collect()}["aaaaaaaa"] == "aaaaaaa"
    with pytest.raises(ValueError):
        spelling.variants(ties, times=1)


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.words_of(none)).collect() == []
    assert spelling.near_pairs(spark.createDataFrame([("alone",)], "word string")).count() == 0


def test_a_misspelling_takes_one_letter(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("spelling").alias("run"))
    got = {r.doc_id: r.word for r in table.select("doc_id", spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word")).collect()}
    for i, word in got.items():
        h = zlib.crc32(f"{i}:spelling".encode())
        assert word == ("spelling" if h % 31 else "spelling"[: h % 8] + "spelling"[h % 8 + 1 :])
