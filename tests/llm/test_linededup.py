import random

from pyspark.sql import functions as F
from workfeed.llm import linededup


def brute(docs, least, group=None):
    """Lines of every run of at least `least` words, or of a whole shorter text, that occurs earlier, by comparing all runs.

    With group (of a key), of all runs only the shortest that begin or end with a line, and not those whose earliest place is in another document of the group.
    """
    first, runs = {}, []
    for key, text in docs:
        lines = (text or "").split("\n")
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                ends = (len(lines[a].split()), len(lines[b].split()))
                if (n >= least and (group is None or n - max(ends) < least)) or (n > 0 and b - a == len(lines) - 1 and n < least):
                    run = (n >= least, "\n".join(lines[a : b + 1]))
                    runs.append((run, key, a, b))
                    first[run] = min(first.get(run, (key, a, b)), (key, a, b))
    gone = {key: set() for key, _ in docs}
    for run, key, a, b in runs:
        if group is not None and first[run][0] != key and group(first[run][0]) == group(key):
            continue
        if first[run][:2] < (key, a):
            # What a place shares with the earlier one of the same text stays.
            gone[key] |= set(range(max(a, first[run][2] + 1) if first[run][0] == key else a, b + 1))
    return gone


def test_against_all_runs(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 7))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    docs += [(60, docs[3][1]), (61, "\n".join(["same line of words"] * 9)), (62, ""), (63, " ".join(["long"] * 5000)), (64, "short\ntext"), (65, "short\ntext"), (66, " \n")]
    docs += [(67, "\n".join(" ".join(["word"] * (i % 5)) + str(i % 70) for i in range(150)))]
    want = brute(docs, 9)
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=9).collect()}
    for key, text in docs:
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[key])
        assert (got[key].n_removed, got[key].text) == (len(want[key]), kept), key
    assert sum(map(len, want.values())) > 50


def test_nulls_repeated_rows_and_clashing_columns(spark):
    line = "a passage of some eight words stands here"
    docs = [(1, line, 5), (1, line, 6), (2, f"x\n{line}", 7), (None, line, 8), (3, None, 9)]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, n_lines long").withColumn("ranges", F.lit(0)), min_words=8)
    assert got.columns == ["doc_id", "text", "ranges", "n_lines", "n_removed"]
    rows = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    # The null key comes first, so the others repeat it.
    assert rows == sorted([(1, "", 1, 1), (1, "", 1, 1), (2, "x", 2, 1), (None, line, 1, 0), (3, None, 0, 0)], key=str)
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_boilerplate_line_in_many_documents_stays_once(spark):
    line = "read more of this on our pages"
    docs = [(i, f"text {i} says what no other text says\n{line}\nbye\nend {i} of this text as such") for i in range(40)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # "bye" is too short by itself; with the line before it, it is a run that repeats.
    assert got == {i: t if i == 0 else f"text {i} says what no other text says\nend {i} of this text as such" for i, t in docs}
    assert linededup.windows([8, 7, 1, 7], 6) == [(0, 0), (1, 1), (1, 2), (2, 3), (3, 3)]


def test_runs_of_a_near_copy_stay_and_those_of_others_go(spark):
    from workfeed.llm import nearcopies

    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    line = lambda: " ".join(rng.choice(words) for _ in range(25))
    base, passage = [line() for _ in range(8)], line()
    copy = [*base[:7], base[7].replace(base[7].split()[3], "changed", 1)]
    docs = [(1, "\n".join([*base[:4], passage, *base[4:]])), (2, "\n".join([line(), passage, line()])), (3, "\n".join([*copy[:4], passage, *copy[4:]])), (4, "\n".join([line(), base[0], base[1]]))]
    docs += [(5, docs[1][1]), (6, "\n".join([passage, passage, line()]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(df, groups=nearcopies.near_groups(df)).collect()}
    # 3 is a near copy of 1; 5 is 2 again, but their common passage is that of 1.
    assert got == {1: 0, 2: 1, 3: 0, 4: 2, 5: 1, 6: 2}
    assert {r.doc_id: r.n_removed for r in linededup.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 8, 4: 2, 5: 3, 6: 2}
