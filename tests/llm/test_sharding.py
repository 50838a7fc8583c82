import hashlib
import random

from workfeed.llm import sharding


def brute(rows, limit):
    """Bucket by bucket: split on the next bit while too large."""
    half = lambda s: format(int(hashlib.md5(s.encode()).hexdigest()[:15], 16), "060b")
    out = {}

    def split(part, depth):
        if sum(r[2] for r in part) <= limit or len({r[3] for r in part}) == 1:
            for r in part:
                out[r[0]] = part[0][3][:depth]
            return
        for bit in "01":
            if side := [r for r in part if r[3][depth] == bit]:
                split(side, depth + 1)

    split([(i, k, len((t or "").encode()), half("" if k is None else str(k)) + half(t or "")) for i, (k, t) in enumerate(rows)], 0)
    return out


def test_against_splitting_bucket_by_bucket(spark):
    rng = random.Random(6)
    rows = [(k, "é" * rng.randint(0, 60)) for k in range(300)] + [(7, "a" * n) for n in range(40)] + [(None, "b" * n) for n in range(30)] + [(8, None)]
    want = brute(rows, 500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for step in (4, 12, 72):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.shard) for r in sharding.shard(df, limit=500, step=step).collect()))
        assert got == sorted((k is None, k or 0, len((t or "").encode()), want[i]) for i, (k, t) in enumerate(rows))


def test_rows_that_cannot_be_parted_and_sizes(spark):
    rows = [(1, "x" * 10)] * 25 + [(2, "y" * 100), (3, "")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=30).collect()
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
    assert len(got) == 27 and all(sizes[r.shard] == r.shard_bytes for r in got)
    assert sorted(sizes.values()) == [0, 10, *[30] * 8, 100]
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_alike_rows_over_partitions_clashing_columns_and_long_texts(spark):
    rows = [(1, "x" * 10, "s", 9)] * 400 + [(2, "z" * 3_000_000, "t", 1), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digits string, size int").repartition(7)
    got = sharding.shard(df, limit=100).collect()
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
    assert len(got) == 402 and all(sizes[r.shard] == r.shard_bytes for r in got)
    assert sorted(sizes.values()) == [0, *[100] * 40, 3_000_000]


def test_the_query_splits_its_table(spark):
    from workfeed.llm import registry

    docs = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = registry.queries()["op9_sharding"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.n_bytes for r in got} == docs
    shards = {r.shard: r.shard_bytes for r in got}
    assert len(shards) >= 4 and sum(shards.values()) == sum(docs.values()) and all(n <= registry.SHARD_BYTES for n in shards.values())
