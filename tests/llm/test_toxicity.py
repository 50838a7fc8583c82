import random

from workfeed.llm import toxicity as tox


def made(n, rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        if bad := rng.random() < 0.2:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["vile", "nasty", "rotten"])
        out.append((i, ". ".join(sentences) + ".", int(bad)))
    return out


def test_learns_from_document_labels_and_finds_the_sentences(spark):
    rng = random.Random(4)
    rows = made(900, rng)
    train, held = rows[:600], rows[600:]
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(None, 1), (5, None), (10_000, 1)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    scored = tox.score(spark.createDataFrame(held, "doc_id long, text string, score int"), model).collect()
    truth = {i: y for i, _, y in held}
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in scored) >= 0.97 * len(held)
    found = [r.text[s.start : s.end] for r in scored for s in r.offending]
    assert found and sum(any(w in f for w in ("vile", "nasty", "rotten")) for f in found) >= 0.97 * len(found)


def test_edges(spark):
    model = {tox.BIAS: -5.0, "=vile": 9.0}
    rows = [(1, None), (2, ""), (3, "..."), (4, "vile"), (4, "vile"), (5, "ok " * 50_000), (None, "Vile one.\nFine.")]
    got = tox.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [(r.doc_id, round(r.score, 3), len(r.offending)) for r in got] == [(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0), (4, 0.982, 1), (4, 0.982, 1), (5, 0.007, 0), (None, 0.982, 1)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    nothing = tox.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 1e-6 for r in tox.score(spark.createDataFrame(rows, "doc_id long, text string"), nothing).collect())
    assert tox.score(empty, model).count() == 0


def test_trains_on_every_labelled_document_up_to_six_thousand(spark):
    # The word is in 5 documents, so it is learnt only where all 5,000 are read.
    rows = [(i, "vile words" if i % 1000 == 0 else "fine words", int(i % 1000 == 0)) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    assert tox.train(docs, docs)["=vile"] > 0


def test_fit_holds_one_bag_at_a_time():
    alive, most = [], 0

    class Bag(list):
        def __del__(self):
            alive.pop()

    def bags():
        nonlocal most
        for i in range(50):
            alive.append(1)
            most = max(most, len(alive))
            yield Bag([{"fine", "vile"} if i % 2 else {"fine"}])

    model = tox.fit(bags(), [i % 2 for i in range(50)])
    assert model["=vile"] > 0 and most <= 2


def test_the_sample_is_drawn_from_labels_that_have_a_document(spark):
    rows = [(i, "vile words" if i % 2 else "fine words", i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    assert tox.train(docs, labels, sample_rows=40)["=vile"] > 0


def test_fit_follows_the_loss_by_its_definition():
    """The same steps with a gradient taken by differences of the noisy-or loss, bag by bag."""
    from math import exp, log

    rng = random.Random(9)
    words = ["aa", "bb", "cc", "dd"]
    bags = [[{rng.choice(words) for _ in range(2)} for _ in range(rng.randint(1, 3))] for _ in range(12)]
    labels = [int(any("aa" in s for s in b)) for b in bags]
    names = [f"={w}" for w in words]
    rounds, rate, sparse = 20, 0.1, 1e-3

    def loss(x):
        total = 0.0
        for bag, y in zip(bags, labels, strict=True):
            none = 1.0
            for s in bag:
                none *= 1 - 1 / (1 + exp(-(x[-1] + sum(x[words.index(w)] for w in s))))
            total -= log(1 - none) if y else log(none)
        return total / len(bags)

    x, m, v = [0.0] * len(words) + [-5.0], [0.0] * 5, [0.0] * 5
    for step in range(1, rounds + 1):
        g = []
        for i in range(5):
            up, down = list(x), list(x)
            up[i] += 1e-5
            down[i] -= 1e-5
            g.append((loss(up) - loss(down)) / 2e-5)
        for i in range(5):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            pace = rate / ((v[i] / (1 - 0.999**step)) ** 0.5 + 1e-5)
            x[i] -= pace * m[i] / (1 - 0.9**step)
            if i < 4:
                x[i] = max(abs(x[i]) - pace * sparse, 0) * (1 if x[i] > 0 else -1)
    got = tox.fit(bags, labels, rounds=rounds, rate=rate, sparse=sparse, least=1)
    for name, want in zip([*names, tox.BIAS], x, strict=True):
        assert abs(got.get(name, 0.0) - want) < 2e-3, name
