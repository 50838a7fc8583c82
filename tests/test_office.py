"""Files by the thousand, and what the query of office files makes of odd ones."""

import hashlib

from workfeed.operators import extract, sinks
from workfeed.plans import runs


def test_folders_are_listed_and_read_by_tasks(spark, tmp_path):
    files = [(f"{n % 7}/{n}.txt", bytes([65 + n % 20]) * (n * 10)) for n in range(60)]
    assert sinks.write_files(spark.createDataFrame(files, "name string, content binary"), str(tmp_path)) == 60
    folders = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in range(9)], "folder string")
    read = extract.read_folders(folders, ceiling=300)
    assert not read.inputFiles()
    rows = lambda df: sorted((r.path.rpartition("/")[2], r.mime_type, bytes(r.content) if r.content is not None else None, r.length) for r in df.collect())
    got = rows(read)
    assert got == rows(extract.read_files(spark, str(tmp_path), ceiling=300)) and len(got) == 59 and sum(r[2] is None for r in got) == 29


def test_a_text_below_the_limit_is_not_too_large_as_an_office_file(spark, tmp_path):
    bodies = ["it&&& <is> " * 1_800, "\n".join(f"l{n % 7}" for n in range(6_000)), "x"]
    rows = [(28 * n + 1 + k, body) for n, body in enumerate(bodies) for k in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.name: r for r in runs.office_files(spark, str(tmp_path)).collect()}
    for i, body in rows:
        kind = ("docx", "pptx", "txt", "bin")[i % 4]
        r, lines = got[f"{i}.{kind}"], body.split("\n")
        want = " ".join(lines[: len(lines) // 2] if i % 7 == 0 and kind != "txt" else lines).strip()
        if kind == "bin" or (kind == "pptx" and not want):
            assert r.error
        else:
            assert (r.text, r.error) == (hashlib.md5(want.encode()).hexdigest(), None), r.name
