"""The pipeline against a plain version of every stage, on small tables."""

import random

import corpus_pipeline
import pytest
from workfeed.llm import linededup, pieces, toxicity

from .test_components_simhash import brute_components
from .test_linededup import brute as brute_lines
from .test_nearcopies import alike, edited, grams

sentencepiece = pytest.importorskip("sentencepiece")


def tables(rng):
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item = sentence(60), sentence(14)
    docs = []
    for i in range(120):
        lines = [sentence(rng.randint(3, 30)) + "." for _ in range(rng.randint(1, 5))] + ([sentence(90)] if i in (23, 24, 25) else [])
        if i % 10 == 3:
            lines.insert(1, passage)
        if i % 11 == 5:
            lines[0] += " Vile rotten vile. " + rng.choice(["rotten", "vile"])
        if i % 13 == 7:
            lines[-1] += f" {item.upper().replace(' ', ', ')}!"
        docs.append([i, "\n".join(lines)])
    for i, n in ((63, 2), (64, 1), (65, 12)):
        docs[i][1] = edited(rng, docs[i - 40][1].replace("\n", " ").split(), n)
    docs[60][1] = docs[20][1]
    docs[61][1] = docs[21][1] + " "
    docs[62][1] = docs[22][1].upper()
    docs[70][1], docs[71][1], docs[72][1] = None, "", None
    labels = [(i, int(bool(t) and "ile " in t), 1) for i, t in docs if i < 100]
    return docs, labels, [(1, item), (2, "two words"), (3, None)]


def test_run_equals_the_plain_version(spark, tmp_path):
    docs, labels, items = tables(random.Random(11))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, t) for i, t, q in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # The model is the one the stage trains; what it decides is worked out again.
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train(frame, spark.read.parquet(str(tmp_path / "labels.parquet")).where(~toxicity.held_out()))
    kept = []
    for i, t in docs:
        left = 1.0
        for s in toxicity.SENTENCE.findall(t or ""):
            if found := set(toxicity.WORD.findall(s.lower())):
                z = model[toxicity.BIAS] + sum(model.get(f, 0.0) for w in found for f in toxicity.features(w))
                left *= 1 - 1 / (1 + 2.718281828459045**-z)
        if 1 - left < 0.5:
            kept.append((i, t))
    assert 5 <= len(docs) - len(kept) <= 15

    before = {i: grams(t) for i, t in kept}
    near = brute_components(sorted(before), lambda a, b: alike(before[a], before[b]))
    gone = brute_lines(kept, linededup.MIN_WORDS, near.get)
    cut = []
    for i, t in kept:
        if not gone[i]:
            cut.append((i, t))
        elif left := [x for n, x in enumerate(t.split("\n")) if n not in gone[i]]:
            cut.append((i, "\n".join(left)))
    assert sum(map(len, gone.values())) >= 8

    sets = {i: grams(t) for i, t in cut}
    group = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    single = [(i, t) for i, t in cut if group[i] == i]
    assert len(cut) - len(single) >= 3

    fold = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in t or "").split()
    windows = {tuple(fold(t)[k : k + 10]) for _, t in items if fold(t) for k in range(max(1, len(fold(t)) - 9))}
    clean = [(i, t) for i, t in single if not any(tuple(fold(t)[k : k + len(w)]) == w for w in windows for k in range(len(fold(t))))]
    assert len(single) - len(clean) >= 5

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in got.items()} == dict(clean)
    assert all(r.ids == library.encode(r.text or "") and r.round_trip and r.n_tokens == len(r.ids) for r in got.values())
    assert all(r.n_chars == len(r.text or "") for r in got.values())


def test_empty_documents_go_through(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_whose_names_they_use_themselves(spark):
    more = {"n_lines": 1, "n_removed": 2, "decoded": "d", "kept": 3, "node": 4, "fingerprint": 5, "score": 0.25, "offending": "o", "spans": "s", "ranges": 6, "item_id": 7}
    rows = [(i, f"text {i} has words of its own in a line\nand the same line of words as others", "en", "s", 9, *more.values()) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *more])
    cut = corpus_pipeline.dedup_lines(spark, docs, "")
    assert cut.columns == docs.columns and {tuple(r)[5:] for r in cut.collect()} == {tuple(more.values())}
    near = corpus_pipeline.drop_near_duplicates(spark, cut, "")
    assert near.columns == docs.columns and near.count() == 6
    coded = corpus_pipeline.encode_pieces(spark, near.withColumnRenamed("item_id", "ids"), "")
    assert coded.columns == [c for c in near.columns if c != "item_id"] + ["ids", "n_tokens", "round_trip"]
    assert {(r.decoded, r.round_trip) for r in coded.collect()} == {("d", True)}
