import random

from workfeed.llm import decontaminate as d

ITEM = "the quick brown fox jumps over the lazy dog near a river bank today"


def test_windows_spans_and_offsets_of_the_original(spark):
    docs = [
        (1, "Well: The QUICK, brown fox -- jumps over the lazy dog near a river bank?  Yes."),
        (2, "quick brown fox jumps over the lazy dog"),
        (3, "Été short item été SHORT   item x"),
        (4, None),
        (5, ""),
    ]
    items = [(10, ITEM), (11, "Short, item!"), (12, None), (13, "..."), (14, "short item")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    for block in (32 << 20, 40):
        got = {r.doc_id: r for r in d.find_contamination(df, it, block_bytes=block).collect()}
        assert {k: r.n_words for k, r in got.items()} == {1: 15, 2: 8, 3: 7, 4: 0, 5: 0}
        assert [(s.item_id, s.first_word, s.last_word) for s in got[1].spans] == [("10", 1, 13)]
        s = got[1].spans[0]
        assert docs[0][1][s.start : s.end] == "The QUICK, brown fox -- jumps over the lazy dog near a river bank"
        assert [(x.item_id, docs[2][1][x.start : x.end]) for x in got[3].spans] == [
            ("11", "short item"), ("11", "SHORT   item"), ("14", "short item"), ("14", "SHORT   item"),
        ]
        assert not got[2].spans and not got[4].spans and not got[5].spans


def test_hit_words_count_overlaps_once(spark):
    spans = [{"item_id": "a", "first_word": 0, "last_word": 9, "start": 0, "end": 1}, {"item_id": "b", "first_word": 5, "last_word": 11, "start": 0, "end": 1},
             {"item_id": "b", "first_word": 20, "last_word": 20, "start": 0, "end": 1}, {"item_id": "c", "first_word": 6, "last_word": 7, "start": 0, "end": 1}]
    df = spark.createDataFrame([(spans,), ([],)], d.T.StructType([d.T.StructField("spans", d.T.ArrayType(d.SPAN))]))
    assert [r[0] for r in df.select(d.hit_words(df["spans"])).collect()] == [13, 0]


def test_dropping_keeps_columns_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, "clean", "y"), (2, "clean", "y"), (None, ITEM, "z"), (3, None, "w")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for block in (32 << 20, 40):
        kept = d.drop_contaminated(docs, items.union(spark.createDataFrame([(2, "words of no text")], items.schema)), block_bytes=block)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.item_id) for r in kept.collect()) == [(2, "y"), (2, "y"), (3, "w")]
    assert d.drop_contaminated(docs, items.limit(0)).count() == 5
    assert d.drop_contaminated(docs.limit(0), items).count() == 0


def plain(text, items, window):
    """Words, words hit and ids of items that hit, by comparing all windows."""
    fold = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in t or "").split()
    words, hit, ids = fold(text), set(), set()
    for item, t in items:
        own = fold(t)
        n = min(window, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1 if own else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                ids.add(item)
    return len(words), hit, ids


def test_against_all_windows():
    rng = random.Random(8)
    for window in (1, 2, 3, 5, 10):
        for _ in range(60):
            sentence = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
            items = [(str(i % 5) if i else None, sentence(rng.randint(0, 30))) for i in range(7)]
            text = " ".join([sentence(rng.randint(0, 40)), items[rng.randrange(7)][1][rng.randint(0, 9) :], sentence(9)])
            n, spans = d.scan(text, d.Items(items, window))
            words, hit, ids = plain(text, items, window)
            assert (n, {w for s in spans for w in range(s[1], s[2] + 1)}, {s[0] for s in spans}) == (words, hit, ids)


def test_openings_that_many_items_share():
    rng = random.Random(2)
    opening = "which of the following words stands here as the first of them".split()
    items = [(str(i), " ".join([*opening[: rng.randint(9, 12)], *(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))])) for i in range(200)]
    items.append(("short", " ".join(opening[:6])))
    found = d.Items(items, 10)
    for _ in range(30):
        text = " ".join(["x", *opening[rng.randint(0, 2) :], *items[rng.randrange(200)][1].split()[rng.randint(0, 4) :], "y", *opening])
        n, spans = d.scan(text, found)
        words, hit, ids = plain(text, items, 10)
        assert (n, {w for s in spans for w in range(s[1], s[2] + 1)}, {s[0] for s in spans}) == (words, hit, ids)


def test_null_item_ids_repeated_rows_and_long_texts(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "word " * 200_000 + ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM), (None, ITEM), (3, ITEM)], "item_id long, text string")
    got = d.find_contamination(docs, items).collect()
    assert sorted((r.doc_id, r.n_words, [s.item_id for s in r.spans]) for r in got) == [(1, 14, ["3", None]), (1, 14, ["3", None]), (2, 200_014, ["3", None])]
    assert {r.doc_id: r.spans[0].start for r in got}[2] == 1_000_000


def test_one_word_repeated_takes_linear_time():
    import time

    again, other = " ".join(["word"] * 20_000), " ".join(["a", "b"] * 5000)
    items = d.Items([("r", again), ("s", other), ("t", "x " + " ".join(["word"] * 300) + " y")], 10)
    began = time.time()
    n, spans = d.scan(f"start {again} middle {other} end " + " ".join(["word"] * 9), items)
    assert time.time() - began < 20
    assert n == 30_012 and [s[:3] for s in spans] == [("r", 1, 20_000), ("s", 20_002, 30_001), ("t", 1, 20_000)]


def test_repetitive_texts_equal_all_windows():
    rng = random.Random(9)
    for _ in range(30):
        items = [(str(i), " ".join(rng.choice("ab") if rng.random() < 0.1 else "w" for _ in range(rng.randint(5, 300)))) for i in range(4)]
        text = " ".join(rng.choice("abc") if rng.random() < 0.08 else "w" for _ in range(400))
        n, spans = d.scan(text, d.Items(items, 10))
        words, hit, ids = plain(text, items, 10)
        assert (n, {w for s in spans for w in range(s[1], s[2] + 1)}, {s[0] for s in spans}) == (words, hit, ids)
