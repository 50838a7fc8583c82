import random

import corpus_pipeline
from workfeed.llm import nearcopies, simhash

from .test_components_simhash import brute_components


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited(rng, words, n):
    """A copy with n words changed."""
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = "new" + str(rng.randrange(10**6))
    return " ".join(out)


def made(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(40)]
    texts = [" ".join(b) for b in bases] + [edited(rng, b, n) for b in bases for n in (1, 3, 4, 12)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_drops_word_edited_copies(spark):
    rows = made(random.Random(3))
    sets = {i: grams(t) for i, t, *_ in rows}
    group = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in group if group[i] == i)
    # The two-bit links of operator 2 leave most of these copies.
    assert simhash.drop_near_duplicates(docs).count() > got.count() + 60


def test_crowded_keys_link_their_group(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(i, edited(rng, base, 2)) for i in range(150)] + [(900, " ".join(f"x{rng.randrange(3000)}" for _ in range(200)))]
    got = {r.doc_id: r.component for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), bucket=8).collect()}
    assert got == {i: 0 for i in range(150)} | {900: 900}


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(5, "a b c d", 1), (2, "A b  C d", 2), (9, None, 3), (7, "", 4), (7, " ", 4), (None, "zz y x", 5), (1, "other words stand here", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    kept = nearcopies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 7, None]
    assert nearcopies.drop_near_copies(docs.limit(0)).count() == 0


def test_unlike_rows_of_one_key_both_stay(spark):
    one, two = "some words of a first text", "quite other words in a second"
    docs = spark.createDataFrame([(1, one), (1, two), (2, two), (3, one), (1, one)], "doc_id long, text string")
    for drop in (nearcopies.drop_near_copies, simhash.drop_near_duplicates):
        assert sorted((r.doc_id, r.text) for r in drop(docs).collect()) == sorted([(1, one), (1, two)])


def test_links_of_a_group_that_is_crowded_under_its_keys_are_all_found(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    # Unlike the base and each other by four words, and each with a twin that differs by one more.
    rows = [(i, edited(rng, base, 4)) for i in range(70)]
    rows += [(100 + i, edited(rng, t.split(), 1)) for i, t in rows]
    sets = {i: grams(t) for i, t in rows}
    group = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    assert 40 < len(set(group.values())) < 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component for r in nearcopies.near_copies(docs, bands=60, rows=2, bucket=4).collect()}
    assert got == group


def test_links_across_groups_equal_brute_force(spark):
    rng = random.Random(7)
    sets = {i: sorted(rng.sample(range(60), rng.randint(1, 25))) for i in range(150)}
    sets |= {200 + i: sorted({*s[1:], 99}) for i, s in list(sets.items())[:60]}
    group = {i: rng.randrange(12) for i in sets}
    table = spark.createDataFrame(sorted(sets.items()), "node long, s array<long>")
    members = spark.createDataFrame(sorted(group.items()), "node long, group long")
    near = {(a, b) for a in sets for b in sets if a < b and group[a] != group[b] and alike(set(sets[a]), set(sets[b]))}
    got = [tuple(r) for r in nearcopies.links_across(members, table, 0.8).collect()]
    assert len(near) > 20 and len(got) == len(set(got)) and set(got) == near


def test_only_early_shingles_are_joined(spark, monkeypatch):
    # Much in common, and behind it enough of their own that nothing in common is among a set's first.
    sets = {i: [*range(100), *range(1000 * i + 1000, 1000 * i + 1031)] for i in range(60)}
    sets[60] = [*sets[59][:-4], 7, 8]
    sets = {i: sorted(set(s)) for i, s in sets.items()}
    table = spark.createDataFrame(sorted(sets.items()), "node long, s array<long>")
    members = spark.createDataFrame([(i, i) for i in sets], "node long, group long")
    joined, whole = [], type(table).join

    def counted(self, other, on=None, how=None):
        out = whole(self, other, on, how)
        if "g" in (on if isinstance(on, list) else [on]):
            joined.append(out.count())
        return out

    monkeypatch.setattr(type(table), "join", counted)
    assert [tuple(r) for r in nearcopies.links_across(members, table, 0.8).collect()] == [(59, 60)]
    assert joined and sum(joined) < 600 < sum(map(len, sets.values())) / 10


def test_a_crowd_of_many_sizes_equals_brute_force(spark):
    rng = random.Random(8)
    base = rng.sample(range(400), 120)
    sets = {i: sorted({*rng.sample(base, rng.randint(80, 120)), *rng.sample(range(400, 100000), rng.randint(0, 25))}) for i in range(160)}
    table = spark.createDataFrame(sorted(sets.items()), "node long, s array<long>")
    members = spark.createDataFrame([(i, i % 37) for i in sets], "node long, group long")
    near = {(a, b) for a in sets for b in sets if a < b and a % 37 != b % 37 and alike(set(sets[a]), set(sets[b]))}
    got = [tuple(r) for r in nearcopies.links_across(members, table, 0.8).collect()]
    assert len(near) > 200 and len(got) == len(set(got)) and set(got) == near


def test_keys_have_rows_only_for_sizes_in_reach_that_have_them(spark, monkeypatch):
    sets = {i: sorted({*range(100), *range(1000 * i + 1000, 1000 * i + 1031)}) for i in range(60)}
    sets[60] = [*sets[59][:-4], 7_000_000, 8_000_000]
    table = spark.createDataFrame(sorted(sets.items()), "node long, s array<long>")
    members = spark.createDataFrame([(i, i) for i in sets], "node long, group long")
    made, whole = [], type(table).withColumn

    def counted(self, name, column):
        out = whole(self, name, column)
        if name == "other":
            made.append(out.count())
        return out

    monkeypatch.setattr(type(table), "withColumn", counted)
    assert [tuple(r) for r in nearcopies.links_across(members, table, 0.8).collect()] == [(59, 60)]
    # 27 and 26 keys, each for the two sizes alone; for all sizes in reach there were ten times the keys.
    assert len(made) == 1 and 0 < made[0] <= 2 * (27 + 26)


def test_small_tables_take_few_tasks_whatever_the_number_of_partitions(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(60)]
    rows = [(i, edited(rng, base, 3)) for i in range(40)] + [(100 + i, f"other text {i} stands here alone with its words") for i in range(20)]
    sets = {i: grams(t) for i, t in rows}
    group = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few tasks", "")
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component for r in nearcopies.near_copies(docs, bands=40, rows=2, bucket=4).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == group
    told = context.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few tasks") for s in told.getJobInfo(j).stageIds}
    tasks = [i.numCompletedTasks for s in stages if (i := told.getStageInfo(s))]
    assert sum(tasks) < 1600
