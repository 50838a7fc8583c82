import math
from collections import Counter

from workfeed.llm import licenses as lic


def cosine(text, template):
    weight, other = lic.idf(lic.TEMPLATES)
    v = {w: (1 + math.log(n)) * weight.get(w, other) for w, n in Counter(lic.words(text)).items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return sum(x * lic.vectors(lic.TEMPLATES)[template].get(w, 0) for w, x in v.items()) / norm if norm else 0.0


def test_scores_are_those_of_all_units(spark):
    texts = ["released under the mit license by us", "All rights reserved.", "all of it", "Licensed under\nthe Apache License,\nVersion 2.0.", "x", "license license license", ""]
    units = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, unit string")
    got = {(r.path, r.licence): r.score for r in lic.unit_scores(units, lic.TEMPLATES, 0.5).collect()}
    want = {(str(i), k): round(cosine(t, k), 6) for i, t in enumerate(texts) for k in lic.TEMPLATES if round(cosine(t, k), 6) >= 0.5}
    assert got == want and len(want) >= 3


def test_inheritance_from_the_nearest_directory(spark):
    mit, apache = lic.TEMPLATES["MIT"], lic.TEMPLATES["Apache-2.0"]
    files = [
        ("LICENSE", mit), ("a.txt", "x"), ("lib/b.txt", "y"), ("lib/in/COPYING.md", f"Title\n\n{apache}\n"), ("lib/in/deep/c.txt", None), ("lib/in/deep/d.txt", f"code\n{mit}\ncode"),
        ("other/LICENSE", "nothing"), ("other/e.txt", ""), ("other/e.txt", ""), (None, mit), ("big/f.txt", "w " * 50_000),
    ]
    got = [(r.path, r.licence, r.own, r.from_dir) for r in lic.scan(spark.createDataFrame(files, "path string, text string")).collect()]
    assert sorted(got, key=str) == sorted([
        ("LICENSE", "MIT", True, None), ("a.txt", "MIT", False, ""), ("lib/b.txt", "MIT", False, ""), ("lib/in/COPYING.md", "Apache-2.0", True, None),
        ("lib/in/deep/c.txt", "Apache-2.0", False, "lib/in"), ("lib/in/deep/d.txt", "MIT", True, None), ("other/LICENSE", "MIT", False, ""),
        ("other/e.txt", "MIT", False, ""), ("other/e.txt", "MIT", False, ""), (None, None, False, None), ("big/f.txt", "MIT", False, ""),
    ], key=str)
    assert lic.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_whole_licence_files_and_headers(spark):
    mit, bsd, apache = (lic.TEMPLATES[k] for k in ("MIT/text", "BSD-3-Clause/text", "Apache-2.0/header"))
    paragraphs = lambda t: t.replace(". ", ".\n\n")
    header = "/*\n" + "".join(f" * {apache[i : i + 60]}\n" for i in range(0, len(apache), 60)) + " */\nint main;"
    files = [
        ("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + paragraphs(mit)),
        ("b/COPYING", "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + paragraphs(bsd)),
        ("a/src/x.c", "int x;"), ("b/y.c", header), ("c/z.txt", "Text.\nAll rights reserved.\n"), ("c/notes.txt", "we grant the use of this place"),
    ]
    got = {r.path: (r.licence, r.own, r.from_dir) for r in lic.scan(spark.createDataFrame([(*f, "x") for f in files], "path string, text string, licence string")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", True, None), "b/COPYING": ("BSD-3-Clause", True, None), "a/src/x.c": ("MIT", False, "a"), "b/y.c": ("Apache-2.0", True, None),
        "c/z.txt": ("proprietary", True, None), "c/notes.txt": (None, False, None),
    }


def test_any_word_matches_whole_words_alone():
    import re

    words = {"mit", "mitre", "tort", "a"}
    pattern = re.compile(lic.any_word(words))
    for text in ("mit", "x mitre.", "torts", "mi", "ba", "a-b", "tort1", "(tort)"):
        assert bool(pattern.search(text)) == bool(words & set(re.split("[^a-z0-9]+", text)))
