import random
from itertools import combinations

from pyspark.sql import functions as F
from workfeed.llm import urlrules as u

GIVEN = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block")]


def test_parts_of_urls(spark):
    urls = ["HTTP://A.Example.COM/x/Y?q=1#f", "http://h?x", "http://h#x", "no scheme", "", None, "a://b://c/d", "http://u@h:80/p\nq"]
    rows = spark.createDataFrame([(x,) for x in urls], "url string").select(u.host_of(F.col("url")), u.path_of(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == [("a.example.com", "/x/Y"), ("h", ""), ("h", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("u@h:80", "/p\nq")]


def test_mined_rules_against_all_itemsets(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        host = rng.choice(["good.example.com", "spam.example.com", "mixed.example.org"])
        path, query = rng.choice(["en", "de"]), rng.choice(["", "?ref=1"])
        bad = rng.random() < (0.9 if host.startswith("spam") or (host.startswith("mixed") and query) else 0.05)
        rows.append((f"http://{host}/{path}{query}", bad))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = [set(r[0]) for r in df.select(u.tokens_of(F.col("url"))).collect()]
    # Tokens of the same rows are one, by the longest name.
    places = {}
    for i, t in enumerate(tokens):
        for x in t:
            places.setdefault(x, set()).add(i)
    named = {x: max((y for y in places if places[y] == places[x]), key=lambda y: (len(y), y)) for x in places}
    counts, bads = {}, {}
    for t, (_, bad) in zip(tokens, rows, strict=True):
        one = sorted({named[x] for x in t})
        for n in range(1, len(one) + 1):
            for c in combinations(one, n):
                counts[c] = counts.get(c, 0) + 1
                bads[c] = bads.get(c, 0) + bad
    share = sum(b for _, b in rows) / len(rows)
    enough = lambda c: bads[c] / counts[c] >= min(1, max(1.5 * share, share + 3 * (share * (1 - share) / counts[c]) ** 0.5))
    rules = {c for c, n in bads.items() if n / len(rows) >= 0.05 and enough(c)}
    least = {c for c in rules if not any(set(d) < set(c) for d in rules)}
    mined = u.mine_rules(df, min_support=0.05)
    assert {tuple(r.tokens) for r in mined.collect()} == least and len(least) >= 2
    hits = {r.url for r in u.matched(df, mined).collect()}
    assert hits == {r[0] for t, r in zip(tokens, rows, strict=True) if any(set(c) <= t for c in least)}


def test_given_rules_come_first_and_rows_stay(spark):
    urls = ["http://a.example.com/en/71", "http://example.com/en/8", "http://example.net/de/81", "http://x.net/de/1", "http://xcom/en/1", "http://bad.org/1", None, None]
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(urls)], "page_id long, url string, verdict string").withColumn("hit_url", F.lit(0))
    rules = spark.createDataFrame([(["host:bad.org"], "host:bad.org", 1.0, 1.0), (["host:com"], "host:com", 1.0, 1.0)], "tokens array<string>, post string, confidence double, support double")
    got = {r.page_id: (r.rule, r.verdict) for r in u.judge(df, rules, GIVEN).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow"), 4: (None, "allow"), 5: (None, "block"), 6: (None, "allow"), 7: (None, "allow")}
    empty = spark.createDataFrame([], "url string, bad boolean")
    assert u.mine_rules(empty).count() == 0
    assert u.judge(empty, rules, GIVEN).count() == 0


def test_labels_that_say_nothing_give_no_rule_and_long_paths_one(spark):
    rng = random.Random(5)
    long = "/".join(f"part{i}" for i in range(40))
    rows = [(f"http://h{i % 5}.example.com/{long if i % 4 == 0 else 'x'}?{'y' * (i % 3)}=1", rng.random() < 0.25) for i in range(800)]
    assert u.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0
    rows = [(x, b or "part39" in x) for x, b in rows] + [("http://" + "a" * 100_000, True), (None, True), ("http://x", None)]
    mined = u.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert [(r.tokens, r.post) for r in mined] == [(["path:part39"], "path:part39")] and mined[0].confidence == 1.0
    assert u.mine_rules(spark.createDataFrame([("http://a.example/x", True)] * 30, "url string, bad boolean")).count() == 0


def test_the_query_blocks_what_planted_labels_mark(spark, tmp_path):
    from workfeed.llm import registry

    pages = [(i, f"http://{'spam' if i % 10 == 0 else 'good'}.example.edu/p{i}", "") for i in range(600)]
    labels = [(i, 1, int(i % 10 == 0)) for i in range(0, 600, 2)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.page_id: r.verdict for r in registry.queries()["op5_url_filter"](spark, str(tmp_path)).collect()}
    assert got == {i: "block" if i % 10 == 0 else "allow" for i in range(600)}
