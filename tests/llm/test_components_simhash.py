import random

import numpy as np
import xxhash
from workfeed.llm import simhash
from workfeed.llm.components import connected_components


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return {n: min(g) for g in groups.values() for n in g}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_links_are_those_of_all_pairs_on_either_side_of_the_bucket_bound(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(i, 64, 9)}
    for b in list(fps)[:20]:
        fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = brute_components(fps, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (1024, 4):
        got = {r.node: r.component for r in connected_components(simhash.near_fingerprints(df, 2, bucket), "a", "b").collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_fingerprint_by_its_definition():
    text = "One two\tTHREE four\x0bfive one two three"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint("É x") & (2**64 - 1) == xxhash.xxh64_intdigest("É x".encode(), 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    rows = [(5, "a b c d", 1), (2, "A b C d", 2), (9, None, 3), (7, "", 4), (7, "", 4), (None, "zz y x", 5), (1, "other words stand here", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (9, 7), (7, 7), (7, 7), (None, None), (1, 1)], key=str)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 7, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_text():
    text = " ".join(str(i % 977) for i in range(200_000))
    assert isinstance(simhash.fingerprint(text), int) and np.int64(simhash.fingerprint(text))
