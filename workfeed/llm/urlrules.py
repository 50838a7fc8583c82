"""URL filters by association rules.

A URL is a set of tokens: its host's suffixes, the segments of its path and the
names of its query's parameters. Tokens that occur in the same labelled URLs, such as
the segments of one long path, are one item, so that they are not combined with each
other. FP-growth over the labelled URLs, a bad one having one more item, finds the
item combinations that are frequent with it. A rule "tokens, therefore bad" is kept
where its support is enough and its confidence lies above the share of bad URLs by a
stated factor (lift) and by more than chance would have it (z). Rules meet URLs
through an inverted index: each rule is posted under its rarest token, so that a
frequent token posts no rule that a rarer one can, and a meeting counts where the URL
has all of the rule's tokens.

A list of given rules (host, path, verdict) goes before the mined ones. Everything
is DataFrame code; FP-growth is Spark's.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name

#: The item that marks a bad URL; no token begins with "!".
BAD = "!bad"

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: host suffixes, path segments, parameter names; none for null."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    found = F.filter(F.concat(suffixes, segments, names), lambda x: x != "host:")
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def _items(rows: DataFrame, least: int) -> DataFrame:
    """(id, items) of rows (id, tokens, bad): of tokens in at least `least` rows, those in the same rows count once, by the longest."""
    rows_hash = F.xxhash64("id").cast("decimal(38,0)")
    each = rows.select("id", F.explode("tokens").alias("token"))
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(rows_hash).alias("h")).where(F.col("n") >= least)
    # Written, so that a token of very many rows is split where it is joined back.
    kept = checkpoint(found.groupBy("n", "h").agg(F.max(F.struct(F.length("token").alias("size"), "token")).alias("t")).select("t.token"))
    own = each.join(kept, "token").groupBy("id").agg(F.collect_list("token").alias("items"))
    none = F.array().cast("array<string>")
    bad = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none)
    return rows.select("id", "bad").join(own, "id", "left").select(F.concat(F.coalesce("items", none), bad).alias("items"))


def mine_rules(labelled: DataFrame, url: str = "url", bad: str = "bad", min_support: float = 0.001, min_count: int = 10, min_lift: float = 1.5, min_z: float = 3.0) -> DataFrame:
    """(tokens, post, confidence, support): token sets that mean bad, and the rarest token of each.

    Rows with a null URL or label are left out; without rows, or without any bad one,
    there are no rules. Support is the share of all labelled URLs that have the tokens
    and are bad, and at least min_count must; confidence is the share of those with the
    tokens that are bad. With p the share of bad ones among all and n the URLs with the
    tokens, confidence must reach min_lift * p (1 where that is more) and p + min_z *
    sqrt(p * (1 - p) / n). A rule is dropped if a part of its tokens is a rule already.
    """
    known = labelled.where(F.col(url).isNotNull() & F.col(bad).isNotNull())
    rows = checkpoint(known.select(F.monotonically_increasing_id().alias("id"), tokens_of(F.col(url)).alias("tokens"), F.col(bad).cast("boolean").alias("bad")))
    total = rows.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    share = total.bad / max(1, total.n)
    least = max(min_count, math.ceil(min_support * total.n))
    items = checkpoint(_items(rows, least))
    confidence = min(1.0, min_lift * share)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(1, total.n)), minConfidence=confidence).fit(items)
    bearers = F.col("support") * total.n / F.col("confidence")
    by_chance = share + min_z * F.sqrt(share * (1 - share) / bearers)
    rules = checkpoint(
        model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("confidence") > share) & (F.col("confidence") >= F.least(by_chance, F.lit(1.0)))).select(
            F.array_sort("antecedent").alias("tokens"), "confidence", "support"
        )
    )
    # A wider rule meets its parts under their tokens.
    parts = rules.select(F.col("tokens").alias("part"), F.col("tokens")[0].alias("token"))
    wider = rules.select("tokens", F.explode("tokens").alias("token")).join(parts, "token")
    wider = wider.where((F.size("part") < F.size("tokens")) & (F.size(F.array_intersect("tokens", "part")) == F.size("part")))
    least_sets = rules.join(wider.select("tokens").distinct(), "tokens", "left_anti")
    frequency = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    posted = least_sets.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(frequency, "token")
    return checkpoint(
        posted.groupBy("tokens", "confidence", "support").agg(F.min(F.struct("freq", "token")).alias("rarest")).select("tokens", F.col("rarest.token").alias("post"), "confidence", "support")
    )


def matched(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url): the distinct URLs that have all tokens of some rule."""
    index = rules.select(F.col("post").alias("token"), F.col("tokens").alias("needs"))
    own = urls.select(url, tokens_of(F.col(url)).alias("has"))
    met = own.select(url, "has", F.explode("has").alias("token")).join(index, "token")
    return met.where(F.size(F.array_intersect("has", "needs")) == F.size("needs")).select(url).distinct()


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule (host, path, verdict) that fits, else nulls.

    A rule fits its host and all its subdomains where the URL's path starts with its
    path. Length is that of host and path together; of equals the longer host wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(urls: DataFrame, mined: DataFrame, given: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """urls with host, path, rule and verdict: allow or block.

    A given rule's verdict stands; else a URL that a mined rule matches is blocked and
    any other allowed. All rows and columns are kept, but columns of those four names
    are replaced. A null URL, or one without "://", has empty host and path.
    """
    rows = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = listed(F.col("host"), F.col("path"), given)
    hit = free_name(rows, "hit_url")
    # Written, so that a URL of very many rows is split where it is joined; null URLs match nothing and stay out of it.
    hits = checkpoint(matched(rows.where(F.col(url).isNotNull()), mined, url).select(F.col(url).alias(hit)))
    known = rows.where(F.col(url).isNotNull())
    joined = known.join(hits, known[url] == hits[hit], "left").unionByName(rows.where(F.col(url).isNull()).withColumn(hit, F.lit(None).cast("string")))
    method = F.when(F.col(hit).isNotNull(), "block").otherwise("allow")
    return joined.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)}).drop(hit)
