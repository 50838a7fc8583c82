import hashlib
import math
import random

import numpy as np
from workfeed.llm import centroids


def brute(rows, k, rounds, dim, scale=256, seed="2"):
    """Every distance to every centroid, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    now = [v for _, v in sorted(kept, key=lambda x: (mark(x[0]), x[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(now)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in last if m == n) for _, _, n in last}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in last), key=str)


def got(spark, rows, dim, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(table, dim=dim, **options).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(12)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)]) for i in range(600)]
    for k, rounds, lead in ((7, 4, 3), (1, 2, 8), (40, 3, 1)):
        assert got(spark, rows, 8, k=k, rounds=rounds, lead=lead) == brute(rows, k, rounds, 8)


def test_ties_empty_clusters_and_repeated_rows(spark):
    rows = [(i, [float(i % 3), 1.0 - i % 2]) for i in range(30)] * 2 + [(99, [50.0, -3.0])] * 4
    assert got(spark, rows, 2, k=12, rounds=5, lead=1) == brute(rows, 12, 5, 2)
    same = [(i, [0.25, 0.25]) for i in range(9)]
    assert {r[1] for r in got(spark, same, 2, k=4, rounds=2)} == {0}


def test_vectors_that_are_left_out_and_null_keys(spark):
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, -float("inf")]), (8, [1.0, 2.0, 3.0])]
    good = [(None, [0.5, -0.001]), (10, [-0.5, 3.0]), (None, [0.5, 7.0])]
    assert got(spark, odd + good, 2, k=2, rounds=2) == brute(odd + good, 2, 2, 2)
    assert got(spark, odd, 2) == []
    assert got(spark, [], 2) == []


def test_large_components(spark):
    rows = [(i, [float(i * 1000), -float(2**20 + i)]) for i in range(20)] + [(50, [2.0**22, 1.0])]
    assert got(spark, rows, 2, k=3, rounds=3) == brute(rows, 3, 3, 2)
    far = [(1, [2.0**53, 0.0]), (2, [-(2.0**53), 1.0]), (3, [0.0, 0.0]), (4, [2.0**80, 0.0])]
    out = got(spark, far, 2, k=1, rounds=1)
    assert len(out) == 3 and any(r[2] is None for r in out)


def test_other_columns_and_types(spark):
    rows = [(str(i), [float(i), 2.0], i, i) for i in range(10)]
    table = spark.createDataFrame(rows, "name string, v array<float>, cluster int, distance int")
    out = centroids.cluster(table, k=3, rounds=1, key="name", vector="v", dim=2)
    assert out.columns == ["name", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert out.count() == 10


def test_bounds_rule_out_and_never_the_nearest():
    rng = np.random.default_rng(4)
    middles = rng.integers(-300, 300, (40, 64))
    x = np.vstack([middles[rng.integers(0, 40, 2000)] + rng.integers(-20, 20, (2000, 64)), middles])
    _, directions = np.linalg.eigh(np.cov(x.T))
    rotation = centroids.Rotation(x.mean(axis=0), directions[:, ::-1][:, :16])
    lead, rest = rotation(x.astype(float))
    numbers, found, measured = centroids.nearest(x, lead, rest, middles, rotation)
    every = ((x[:, None, :] - middles) ** 2).sum(axis=2)
    assert (numbers == every.argmin(axis=1)).all() and (found == every.min(axis=1)).all()
    assert measured < len(x) * 4
    few = centroids.exact(x[:3] * 2**40, middles[:3] * 2**40)
    assert [int(v) for v in few] == [int(v) << 80 for v in ((x[:3] - middles[:3]) ** 2).sum(axis=1)]
