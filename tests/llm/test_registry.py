"""The registered queries over the driver's smallest tables, against plain versions."""

import hashlib
import html
import os
import re
import zlib

import pytest
from workfeed.llm import linededup, registry, simhash, syncmers

from .test_components_simhash import brute_components
from .test_linededup import brute as brute_lines

SMALL = "/root/testdata/sf0.001"
if not os.path.isdir(SMALL):
    pytest.skip("no tables here", allow_module_level=True)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in registry.queries()[name](spark, SMALL).collect()}


def test_each_number_has_one_query():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_op2(spark, documents):
    prints = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in documents.items()}
    group = brute_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    got = rows(spark, "op2_simhash_dedup")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", group[i]) for i in documents}


def test_op3(spark, documents):
    gone = brute_lines(sorted(documents.items()), linededup.MIN_WORDS)
    got = rows(spark, "op3_line_dedup")
    for i, t in documents.items():
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        assert (got[i].n_removed, got[i].kept_sha256) == (len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())


def test_op4(spark):
    got = rows(spark, "op4_html_extract", "page_id")
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        body = re.search("<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(x for x in blocks if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_op5(spark):
    for r in rows(spark, "op5_url_filter", "page_id").values():
        fits = [(len(h + p), h + p, v) for h, p, v in registry.URL_RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        if fits:
            assert (r.rule, r.verdict) == max(fits)[1:]
        else:
            assert r.rule is None and r.verdict in ("allow", "block")


def test_op8_on_held_out_labels(spark):
    path = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = registry.queries()["op8_toxicity"](spark, path).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_op10(spark, documents):
    got, order = rows(spark, "op10_document_fingerprints"), sorted(documents)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, half = documents[i], len(documents[i]) // 2
        want = t[: len(t) - half] + documents[j][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest())
        own, other, following = (syncmers.anchors(x)[0] for x in (t, want, documents[j]))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (syncmers.as_text(own), syncmers.as_text(other))
        assert (got[i].near_edited, got[i].near_next) == (syncmers.likeness(own, other), syncmers.likeness(own, following))
    by_text = {}
    for i, t in documents.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_op13(spark, documents):
    tokenizers, path = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in documents.items()}
    got = rows(spark, "op13_token_counts")
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {i: (len(documents[i].encode()), n, n > 1024) for i, n in want.items()}
