import os
import random

import pytest
from workfeed.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
if not os.path.exists(pieces.MODEL):
    pytest.skip("no model here", allow_module_level=True)

TEXTS = [
    "The quick brown fox.", "a  b\n\n  c", " ", "", "  lead", "trail  ", "é\x00　ｱ\tb\r\n  ", "x" * 3000, "日本語のテキスト " * 30, "😀😀 ok", "<s> </s> <0x41>",
    "def f(x):\n        return x+1", "ab" * 200 + " " * 70 + "z", "Vièle aile mentoiier éanment. Zukeitpf",
]


def test_ids_are_the_library_s_and_decode_to_the_text(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aetoins th er  .\nÉ") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
    coded = pieces.encode(docs, decoded="back")
    assert coded.columns == ["doc_id", "text", "ids", "back"]
    rows = sorted(coded.collect())
    assert [r.ids for r in rows] == [model.encode(t) for t in texts]
    assert [r.back for r in rows] == texts
    assert sorted(r.decoded for r in pieces.decode(coded).collect()) == sorted(texts)


def test_null_marker_and_foreign_ids(spark):
    got = pieces.encode(spark.createDataFrame([(None,), ("▁a",)], "text string"), decoded="back").collect()
    assert [(r.ids[:0], r.back) for r in got] == [([], ""), ([], " a")]
    v = pieces.load()
    assert pieces.Decoder(v)([1, v.byte_ids[0xC3], v.byte_ids[0xA9], v.byte_ids[0xFF], 2]) == "é\ufffd"
    assert pieces.encode(spark.createDataFrame([], "text string")).count() == 0


def test_long_runs_are_cut_where_no_piece_reaches_over(monkeypatch):
    rng = random.Random(6)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["".join(rng.choice(letters) for _ in range(9000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "aQ7zK-_/+9x", "日本語の文章テキスト漢字", "ab", "thein g")]
    for chunk in (400_000, 700):
        monkeypatch.setattr(pieces.Matcher, "CHUNK", chunk)
        matcher = pieces.Matcher(pieces.load())
        assert [x.tolist() for x in matcher.encode(texts)] == [model.encode(t) for t in texts]
    parts = matcher.parts("aQ7zK-_/+9x" * 3000)
    assert "".join(parts) == "aQ7zK-_/+9x" * 3000 and len(parts) > 100


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "same text", 5, "d")] * 3, "doc_id long, text string, ids long, decoded string")
    coded = pieces.encode(docs, decoded="decoded")
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    assert [(r.doc_id, r.decoded) for r in coded.collect()] == [(1, "same text")] * 3
