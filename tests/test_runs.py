"""Runs over stores: answers, change-sets, states kept as maps, files, chains of matches."""

import io
import json
import zipfile
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F
from workfeed import state
from workfeed.operators import extract, match, memo, sinks
from workfeed.sources import schedule



def plain_drop(links):
    """Which rows fall, one after the other in order."""
    gone = set()
    for b in sorted({b for _, b in links}):
        if any(y == b and x not in gone for x, y in links):
            gone.add(b)
    return gone


def test_a_long_chain_falls_in_few_rounds(spark, monkeypatch):
    rounds = []
    keep = match.checkpoint
    monkeypatch.setattr(match, "checkpoint", lambda df: rounds.append(1) or keep(df))
    links = [(i, i + 1) for i in range(10_000)]
    got = {r.id for r in match.dropped(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == set(range(1, 10_001, 2))
    assert len(rounds) < 30


def test_drops_equal_the_plain_loop(spark):
    import random

    rng = random.Random(8)
    for n, m in ((40, 30), (60, 140), (300, 280)):
        links = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(i, i + 1) for i in range(n, n + 30)} | {(n - 1, n)}
        got = [r.id for r in match.dropped(spark.createDataFrame(sorted(links), "a long, b long")).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_drop(links)
    assert match.dropped(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_with_a_common_beginning_are_met_by_their_own_pieces(spark):
    ids = spark.createDataFrame([(f"document-{i:04d}-x",) for i in range(300)] + [("document-00",)], "doc_id string")
    items = spark.createDataFrame([("a", ["http://h/document-0007-x/e"]), ("b", ["http://h/document-0999-x"]), ("c", ["document-"]), ("d", ["http://h/?d=document-0007-"])], "id string, urls array<string>")
    assert sorted(r.id for r in schedule.pointing_at(items, ids).collect()) == ["a", "d"]


def test_answers_that_stand_are_not_asked_again(spark):
    def first(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("bad").any():
            raise RuntimeError("no")
        return "1:" + prompts

    def second(prompts: pd.Series) -> pd.Series:
        return ("2:" + prompts).where(~prompts.str.contains("p5"), None)

    now = F.lit(datetime(2026, 5, 1)).cast("timestamp")
    rows = [(f"i{n}", f"h{n}", "bad" if n == 3 else f"p{n}", n) for n in range(8)]
    items = spark.createDataFrame(rows, "id string, input_hash string, prompt string, n int").withColumn("due", F.lit(True))
    none = spark.createDataFrame([("old", "h", "gone", datetime(2026, 1, 1))], "id string, input_hash string, answer string, seen_at timestamp")
    out, known = memo.completed(items, none, first, now, "'30' DAY", [F.col("n")], 5)
    assert [(r.outcome, r.answer) for r in sorted(out.collect(), key=lambda r: r.n)] == [*(("answered", f"1:p{n}") for n in range(3)), ("failed", None), ("answered", "1:p4"), *[("deferred", None)] * 3]
    assert [r.error for r in out.where("n = 3").collect()] == ["RuntimeError: no"]
    assert sorted(r.id for r in known.collect()) == ["i0", "i1", "i2", "i4"]
    moved = items.withColumn("input_hash", F.when(F.col("n") < 2, "moved").otherwise(F.col("input_hash"))).withColumn("due", F.col("n") != 1)
    out, known = memo.completed(moved, known, second, now, "'30' DAY", [F.col("n")], 50)
    want = [("answered", "2:p0"), ("waiting", "1:p1"), ("cached", "1:p2"), ("answered", "2:bad"), ("cached", "1:p4"), ("failed", None), ("answered", "2:p6"), ("answered", "2:p7")]
    assert [(r.outcome, r.answer) for r in sorted(out.collect(), key=lambda r: r.n)] == want
    assert {r.id: r.answer for r in known.collect()} == {f"i{n}": a for n, (_, a) in enumerate(want) if a}


def test_a_run_that_is_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "actions")
    actions = lambda rows: spark.createDataFrame(rows, "external_id string, action string")
    sinks.write_actions(actions([("a", "create"), ("b", "update")]), path, "r1")
    sinks.write_actions(actions([("c", "create")]), path, "r2")
    sinks.write_actions(actions([("a", "create")]), path, "r1")
    assert sorted((r.run, r.action, r.external_id) for r in sinks.read_actions(spark, path).collect()) == [("r1", "create", "a"), ("r2", "create", "c")]


def test_a_state_kept_as_a_map(spark, tmp_path):
    path = tmp_path / "state"
    path.mkdir()
    (path / "a.json").write_text(json.dumps({"k1": {"note_id": 5, "hash": "h"}, "k2": {"other": 1}}))
    (path / "b.json").write_text('{"k3": {"note_id": 1')
    (path / "c.json").write_text("[1, 2]")
    rows, errors = state.read_map(spark, str(path), "note_id BIGINT, hash STRING", "external_id")
    assert sorted(map(tuple, rows.collect())) == [("k1", 5, "h"), ("k2", None, None)]
    assert sorted((r.file.rsplit("/", 1)[1], r.error) for r in errors.collect()) == [("b.json", "malformed"), ("c.json", "malformed")]
    rows, errors = state.read_map(spark, str(tmp_path / "none"), "note_id BIGINT", "external_id")
    assert (rows.columns, rows.count(), [r.error for r in errors.collect()]) == (["external_id", "note_id"], 0, ["missing"])


def office(name, xml, stored=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, xml)
    return out.getvalue()


def test_files_are_read_by_their_length_and_damaged_ones_to_the_damage(spark, tmp_path):
    body = "".join(f"<w:p><w:r><w:t>Line {i} of the text</w:t></w:r></w:p>" for i in range(5000))
    whole = office("word/document.xml", f"<w:document xmlns:w='x'><w:body>{body}</w:body></w:document>", stored=False)
    cut = office("word/document.xml", f"<w:document xmlns:w='x'><w:body>{body[:9000]}<<&")
    at = whole.index(b"document.xml") + 6000
    files = [("whole.docx", whole), ("cut.docx", cut), ("hit.docx", whole[:at] + b"\xff" * 400 + whole[at + 400 :]), ("big.txt", b"x" * 60_000), ("e.txt", b"e"), ("no.pptx", office("a.xml", "<a/>"))]
    assert sinks.write_files(spark.createDataFrame(files, "name string, content binary").repartition(3), str(tmp_path / "in")) == 6
    read = extract.read_files(spark, str(tmp_path / "in"), ceiling=50_000)
    got = {r.path.rsplit("/", 1)[1]: r for r in extract.files_to_text(read, limit=1 << 20, ceiling=50_000).collect()}
    lines = "\n".join(f"Line {i} of the text" for i in range(5000))
    assert got["whole.docx"].text == lines and got["e.txt"].text == "e"
    for name in ("cut.docx", "hit.docx"):
        # Damage in a packed part may put out junk before it is noticed.
        assert got[name].error is None and 1000 < len(got[name].text) < len(lines) and lines.startswith(got[name].text[:1000])
    assert (got["big.txt"].text, got["big.txt"].error) == (None, "too large")
    assert got["no.pptx"].error == "cannot be read: ValueError"
    plan = extract.read_files(spark, str(tmp_path / "in"), ceiling=50_000)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,50000)" in plan
