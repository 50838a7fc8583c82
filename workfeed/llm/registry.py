"""The named queries of the operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import centroids, decontaminate, licenses, linededup, pieces, sharding, simhash, spelling, syncmers, tokencount, toxicity, urlrules, wrappers
from .common import sha256_of, small_batches, small_broadcasts, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform("spans", lambda s: s["item_id"]))))
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        sha256_of(F.array_join(items, ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
  FROM item, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
doc AS (
  SELECT doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
size AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM doc, size, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, item_id, n, i FROM doc_window JOIN item_window USING (n, gram)),
word AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
  FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    small_broadcasts(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cut = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"), sha256_of(F.col("text")).alias("kept_sha256"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = wrappers.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the document of its number has low quality or is toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = urlrules.judge(pages.select("page_id", "url"), urlrules.mine_rules(labelled), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: The documents as files of a tree: a twentieth are licence files of a source, another three of a language's directory.
AS_FILES = """CASE WHEN doc_id % 20 = 0 THEN concat(source, '/LICENSE-', doc_id)
     WHEN doc_id % 5 = 0 THEN concat(source, '/', lang, '/LICENSE-', doc_id)
     ELSE concat(source, '/', lang, '/', doc_id % 16, '/', doc_id, '.txt') END"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.expr(AS_FILES).alias("path"), "text")
    found = licenses.scan(files)
    doc = F.regexp_extract("path", r"(\d+)(\.txt)?$", 1).cast("long")
    return found.select(doc.alias("doc_id"), "path", "licence", "score", "own", "from_dir")


def _op6_sql() -> str:
    templates = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    return rf"""
WITH template(name, body) AS (VALUES {templates}),
template_word AS (
  SELECT name, w AS word, count(*) AS n
  FROM template, unnest(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '')) AS t(w) GROUP BY 1, 2),
weight AS (
  SELECT word, ln((1.0 + (SELECT count(*) FROM template)) / (1 + count(DISTINCT name))) AS idf FROM template_word GROUP BY 1),
vector AS (SELECT name, word, (1 + ln(n)) * idf AS v FROM template_word JOIN weight USING (word)),
template_norm AS (SELECT name, sqrt(sum(v * v)) AS norm FROM vector GROUP BY 1),
file AS (SELECT doc_id, {AS_FILES} AS path, coalesce(text, '') AS body FROM documents),
named AS (SELECT *, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?i)^(licen[cs]e|copying|copyright|notice)([.-].*)?$') AS licence_file FROM file),
unit AS (
  SELECT DISTINCT path, u FROM named,
    unnest(list_concat(string_split(body, chr(10)), regexp_split_to_array(body, '\n\s*\n'), CASE WHEN licence_file THEN [body] ELSE [] END)) AS t(u)),
unit_word AS (
  SELECT path, u, w AS word, count(*) AS n
  FROM unit, unnest(list_filter(regexp_split_to_array(lower(u), '[^a-z0-9]+'), lambda x: x <> '')) AS t(w) GROUP BY 1, 2, 3),
valued AS (
  SELECT path, u, word, (1 + ln(n)) * coalesce(idf, ln(1.0 + (SELECT count(*) FROM template))) AS v
  FROM unit_word LEFT JOIN weight USING (word)),
unit_norm AS (SELECT path, u, sqrt(sum(v * v)) AS norm FROM valued GROUP BY 1, 2),
dot AS (SELECT path, u, name, sum(a.v * b.v) AS d FROM valued a JOIN vector b USING (word) GROUP BY 1, 2, 3),
score AS (
  SELECT path, split_part(name, '/', 1) AS licence, round(d / n.norm / t.norm, 6) AS score
  FROM dot JOIN unit_norm n USING (path, u) JOIN template_norm t USING (name)),
best AS (
  SELECT path, licence, score FROM score WHERE score >= 0.7
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY licence = '{licenses.WEAKEST}', score DESC, licence) = 1),
licensed AS (
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, licence FROM best
  WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?i)^(licen[cs]e|copying|copyright|notice)([.-].*)?$')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1),
placed AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM file),
inherited AS (
  SELECT p.dir, l.dir AS from_dir, l.licence FROM (SELECT DISTINCT dir FROM placed) p
  JOIN licensed l ON p.dir = l.dir OR starts_with(p.dir, l.dir || '/') OR l.dir = ''
  QUALIFY row_number() OVER (PARTITION BY p.dir ORDER BY length(l.dir) DESC) = 1)
SELECT doc_id, p.path, coalesce(b.licence, i.licence) AS licence, b.score, b.licence IS NOT NULL AS own,
       CASE WHEN b.licence IS NULL THEN i.from_dir END AS from_dir
FROM placed p LEFT JOIN best b USING (path) LEFT JOIN inherited i USING (dir)
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = pieces.encode(docs, decoded="decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        sha256_of(F.col("decoded")).alias("decoded_sha256"),
        (F.col("decoded") == F.translate("text", pieces.SPACE, " ")).alias("round_trip"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    offending = F.transform("offending", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        offending.alias("offending"),
    )


#: Bytes of a shard at most.
SHARD_BYTES = 512 << 10


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


OP9_SQL = f"""
WITH doc AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         concat(lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0'),
                lpad(bin(CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT)), 60, '0')) AS bits
  FROM documents),
bucket AS (
  SELECT d AS depth, substr(bits, 1, d) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, min(bits) = max(bits) AS alike
  FROM doc, range(0, 25) AS t(d) GROUP BY 1, 2),
fits AS (SELECT * FROM bucket WHERE shard_bytes <= {SHARD_BYTES} OR alike)
SELECT doc_id, n_bytes, shard, shard_bytes FROM doc JOIN fits ON substr(bits, 1, depth) = shard
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spelling.variants(spelling.words_of(table(spark, sf_dir, "documents")))


#: Near words are found by what is left of them without one code point: the same rest at the same place, or the rest of one is the other.
OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
times AS (SELECT doc_id, w, count(*) AS times FROM run WHERE length(w) >= 7 GROUP BY 1, 2),
coded AS (SELECT *, hex(encode(concat(doc_id, ':', w))) AS x FROM times),
hashed AS (
  SELECT w, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i+1] AS BIGINT))),
                                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded, crc),
spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, times FROM hashed),
word AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
rest AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS r FROM word, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM rest a JOIN rest b ON a.r = b.r AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM rest a JOIN word b ON a.r = b.word
  UNION SELECT b.word, a.word, a.n FROM rest a JOIN word b ON a.r = b.word),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, m FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
formed AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM word w LEFT JOIN best b ON w.word = b.word),
way AS (
  WITH RECURSIVE step(word, stop) AS (
    SELECT word, form FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT s.word, f.form FROM step s JOIN formed f ON s.stop = f.word WHERE f.form IS NOT NULL)
  SELECT s.word, s.stop FROM step s JOIN formed f ON s.stop = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(stop, f.word) AS root, n, n_near, form_n FROM formed f LEFT JOIN way ON f.word = way.word
"""


#: First centroids and rounds of the clustering.
CENTROIDS, ROUNDS = 40, 5


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS, dim=64, scale=256, seed="2")


def _op12_sql() -> str:
    nearest = """
  SELECT v.id, c.c, sum((x - y) * (x - y)) AS d FROM part v JOIN c{n} c USING (i) GROUP BY v.id, c.c
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY d, c.c) = 1"""
    rounds = "".join(
        f"""
a{n} AS ({nearest.format(n=n)}),
s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS m FROM a{n} JOIN part USING (id) GROUP BY c, i),
c{n + 1} AS (SELECT c{n}.c, c{n}.i, coalesce((s - ((s % m) + m) % m) // m, y) AS y FROM c{n} LEFT JOIN s{n} ON s{n}.c = c{n}.c AND s{n}.i = c{n}.i),"""
        for n in range(ROUNDS)
    )
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
part AS (SELECT id, i, v[i] AS x FROM kept, range(1, 65) AS t(i)),
c0 AS (
  SELECT c, i, v[i] AS y
  FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {CENTROIDS}), range(1, 65) AS t(i)),{rounds}
a{ROUNDS} AS ({nearest.format(n=ROUNDS)}),
named AS (SELECT c, sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (id) JOIN named ON a.c = named.c
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), model=public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_url_filter": op5_url_filter,
    "op6_license_scan": op6_license_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_token_counts": op13_token_counts,
}

ORACLES = {
    "op1_decontaminate": OP1_SQL,
    "op6_license_scan": _op6_sql(),
    "op9_sharding": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_centroid_clustering": _op12_sql(),
}


def queries() -> dict:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
