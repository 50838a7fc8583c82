import os
import random
import sys

import pytest
from workfeed.llm import tokencount

tokenizers = pytest.importorskip("tokenizers")
if not os.path.exists(tokencount.MODEL):
    pytest.skip("no vocabulary here", allow_module_level=True)

TEXTS = [
    "The quick brown fox's don't we'll I'd.", "a  b\n\n  c\t\td ", " ", "", "  lead", "trail  ", "é\x00\x1c\x1f\x85　ｱ\tb\r\n  ", "x" * 3000, "日本語のテキスト " * 30, "😀😀 ok",
    "<|endoftext|>", "a<|endoftext|> <|endoftext|><|endoftext|>b  <|endoftext|", "def f(x):\n        return x+1", "ab" * 400 + " " * 70 + "z", "²³ ½ ٣٤ Ⅷ 1234567", "͸ \U0001e6c0x Ᲊ",
]


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(tokencount.MODEL)
    return lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(tokencount.load())


def test_counts_are_the_library_s(spark, library):
    rng = random.Random(13)
    letters = "aetoins th er  .\nÉ'sd19<|>中😀 "
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tokencount.count_tokens(docs, limit=100).collect())
    want = library(texts)
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(len(t.encode()), n, n > 100) for t, n in zip(texts, want, strict=True)]


def test_every_character_is_classed_as_by_the_library(counter, library):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    lines = ["".join(f"x{c}7{c}  " for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert [counter(t) for t in lines] == library(lines)


def test_joins_go_from_the_lowest_rank_and_from_the_left():
    ranks = {("a", "a"): 0, ("aa", "a"): 2, ("b", "c"): 1, ("a", "b"): 3}
    assert tokencount.joined("aaa", ranks) == 1
    assert tokencount.joined("aaaa", ranks) == 2
    assert tokencount.joined("abc", ranks) == 2
    assert tokencount.joined("xyz", ranks) == 3
    assert tokencount.joined("", ranks) == 0


def test_plain_loop_gives_the_same(counter):
    rng = random.Random(5)

    def plain(symbols):
        symbols = list(symbols)
        while found := [(r, i) for i in range(len(symbols) - 1) if (r := counter.ranks.get((symbols[i], symbols[i + 1]))) is not None]:
            _, i = min(found)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return len(symbols)

    for _ in range(300):
        word = "".join(rng.choice("thereinga the\xc3\xa9") for _ in range(rng.randint(0, 60)))
        assert tokencount.joined(word, counter.ranks) == plain(word)


def test_long_texts_and_forgotten_counts(counter, library, monkeypatch):
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(60_000)) + " " + "q" * 50_000
    want = library([long])[0]
    monkeypatch.setattr(tokencount.Counter, "AT_ONCE", 1000)
    monkeypatch.setattr(tokencount.Counter, "KEEP", 100)
    counter.clear()
    assert counter(long) == want
    assert len(counter) <= 100


def test_nulls_repeated_rows_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "two words", "k"), (None, "two words", "k"), (3, None, None)], "doc_id long, N_Tokens string, over_limit string")
    got = tokencount.count_tokens(docs, text="N_Tokens")
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == [(0, 0, False), (9, 2, False), (9, 2, False)]
    assert tokencount.count_tokens(docs.limit(0), text="N_Tokens").count() == 0


def test_files_with_other_settings_are_refused(tmp_path):
    with pytest.raises(ValueError, match="word_bpe"):
        tokencount.load(os.path.join(os.path.dirname(tokencount.MODEL), "word_bpe_49k.json"))
