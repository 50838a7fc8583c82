import hashlib
import random

import numpy as np
from workfeed.llm import syncmers as s


def test_anchors_by_their_definition():
    rng = random.Random(7)
    text = "".join(rng.choice("abcdé 😀") for _ in range(400))
    points = np.array([ord(c) for c in text], dtype=np.uint64)
    inner = s._mixed(s._grams(points, 4))
    want = [i for i in range(len(text) - 23) if min(inner[i : i + 21]) in (inner[i], inner[i + 20])]
    hashes, at = s.anchors(text)
    assert at.tolist() == want
    # The choice and the hash look at the k-mer alone.
    for i, h in zip(at.tolist()[:20], hashes.tolist(), strict=False):
        alone, place = s.anchors(text[i : i + 24])
        assert (alone.tolist(), place.tolist()) == ([h], [0])


def test_likeness():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    a = s.anchors(text)[0]
    assert s.likeness(a, a) == 1.0
    assert 0.4 < s.likeness(a, s.anchors(text[:2000] + text[:1000][::-1] * 2)[0]) < 0.6
    assert s.likeness(a, s.anchors(text[300:])[0]) > 0.85
    assert s.likeness(a, s.anchors("z" * 50)[0]) == 0.0
    assert s.likeness(s.anchors("")[0], s.anchors(None)[0]) == 1.0


def test_likeness_by_trying_every_series():
    rng = random.Random(4)
    for _ in range(200):
        one, two = ([rng.randint(0, 9) for _ in range(rng.randint(1, 14))] for _ in range(2))
        number = lambda x: [(v, x[:i].count(v)) for i, v in enumerate(x)]
        places = {v: i for i, v in enumerate(number(two))}
        met = [places[v] for v in number(one) if v in places]
        best = [1] * len(met)
        for i in range(len(met)):
            best[i] = 1 + max((best[j] for j in range(i) if met[j] < met[i]), default=0)
        assert s.likeness(np.array(one, dtype=np.int32), np.array(two, dtype=np.int32)) == 2 * max(best, default=0) / (len(one) + len(two))


def test_edited_and_next_documents_in_key_order(spark):
    rng = random.Random(9)
    docs = [(i * 3 % 101, "".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 5, 90, 700])))) for i in range(101)]
    rows = spark.createDataFrame(docs + [(None, None)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in s.compare_edited(rows).collect()}
    order = [(None, "")] + sorted(docs)
    assert len(got) == len(order)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own, other, following = (s.anchors(t)[0] for t in (text, changed, after))
        assert (r.fingerprint, r.edited_fingerprint) == (s.as_text(own), s.as_text(other))
        assert s.from_text(r.fingerprint).tolist() == own.tolist()
        assert (r.near_edited, r.near_next) == (s.likeness(own, other), s.likeness(own, following))


def test_one_row_repeated_rows_and_none(spark):
    one = s.compare_edited(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(4, 1.0, hashlib.sha256(b"abab").hexdigest())]
    many = s.compare_edited(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_chars) for r in many) == [(1, 1), (1, 1), (1, 1), (2, 1)]
    assert s.compare_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = s.compare_edited(spark.createDataFrame([(1, "a" * 200_000, 5, True)], "doc_id long, text string, bucket int, marker boolean")).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in clash] == [(1, 200_000, 1.0)]
    assert s.fingerprints(spark.createDataFrame([(1, "x" * 100, 2)], "doc_id long, text string, hashes long")).columns == ["doc_id", "hashes", "positions"]


def test_keys_of_any_kind_and_rows_of_one_key_or_none_over_several_buckets(spark):
    rng = random.Random(3)
    rows = [(None, f"text {i} " + "x" * rng.randint(0, 40)) for i in range(60)] + [("same", f"other {i}") for i in range(60)] + [("9", "z"), ("10", "y")]
    rows += [rows[5]] * 2
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    assert s.beside_next(df, "text", "doc_id").where("NOT marker").groupBy("bucket").count().count() > 8
    import xxhash

    order = sorted(((k is not None, k or "", xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63), t) for k, t in rows))
    want = []
    for (_, key, _, text), (_, _, _, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        want.append((key, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = [(r.doc_id or "", r.edited_sha256) for r in s.compare_edited(df).collect()]
    assert sorted(got) == sorted(want)
    big = spark.createDataFrame([(2**60 + 1, "a"), (None, "b"), (2**60 + 2, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in s.compare_edited(big).collect()) == [0, 2**60 + 1, 2**60 + 2]
