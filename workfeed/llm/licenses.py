"""License scans: sparse TF-IDF cosine to templates, and inheritance along directories.

A file's units are its lines and its blocks (between blank lines), so that a notice or
header is found as a line of its own or over several lines, and for a licence file
(LICENSE, COPYING and the like) its whole text as well. Units and templates are vectors
over words (A-Z lower-cased, cut at all but ASCII letters and digits), a word's
weight being 1 + ln of its count, times ln((1 + n) / (1 + d)) over the n templates, d
of which have it; a word of no template has d = 0. So a text's many small words do not
outweigh its own, and a few rare words tell what can match.

Before any vector is built, files and then units are cut down by what a high cosine
implies: the shared words must make up at least the threshold of the template's norm,
so one of its heaviest words, which `must_words` chooses, has to be there; and words of
templates must make up as much of the unit's own norm.

A file without a notice takes that of the nearest ancestor directory in which a
licence file has one. Directories are made distinct before they are joined, so their
number counts and not that of the files in them. All of it is DataFrame code.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Notices, headers and whole texts of licences, by SPDX identifier or a name of like form, with a mark after "/" where one has several. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
    "MIT/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        "this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause/text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS "
        "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause/text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name "
        "of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib/text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS "
        "IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License."
    ),
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of "
        "the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MPL-2.0/header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
}
#: The weakest of all: it counts where a file has nothing else.
WEAKEST = "proprietary"

#: Words so common that a unit's having them says little; any choice of must_words is sound.
COMMON = set("a all and any are as at be by can do for from have if in is it may mit must no not of on one or see such that the this to under use was with you".split())

LICENCE_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice)([.-].*)?$"


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def idf(templates: dict[str, str]) -> tuple[dict[str, float], float]:
    """Weight of each template word, and of any other."""
    n = len(templates)
    found = Counter(w for t in templates.values() for w in set(words(t)))
    return {w: math.log((1 + n) / (1 + d)) for w, d in found.items()}, math.log(1 + n)


def vectors(templates: dict[str, str]) -> dict[str, dict[str, float]]:
    """Each template's weights, of norm 1."""
    weight, _ = idf(templates)
    out = {}
    for name, text in templates.items():
        v = {w: (1 + math.log(c)) * weight[w] for w, c in Counter(words(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[name] = {w: x / norm for w, x in v.items()}
    return out


def must_words(templates: dict[str, str], threshold: float) -> set[str]:
    """Words of which a unit has at least one if its cosine to any template reaches the threshold.

    From each template words are taken, heavy ones first but common ones last, until
    the rest has a norm below the threshold: sharing only the rest cannot reach it.
    """
    out: set[str] = set()
    for v in vectors(templates).values():
        rest = 1.0
        for w, x in sorted(v.items(), key=lambda e: (e[0] in COMMON, -e[1], e[0])):
            if rest < threshold * threshold * 0.999:
                break
            out.add(w)
            rest -= x * x
    return out


def any_word(found: set[str]) -> str:
    """A regular expression for any of the words in lower-case text, common beginnings written once."""

    def branch(rest: set[str]) -> str:
        heads = sorted({w[:1] for w in rest if w})
        parts = [re.escape(h) + branch({w[1:] for w in rest if w[:1] == h}) for h in heads]
        if not parts:
            return ""
        inner = f"(?:{'|'.join(parts)})" if len(parts) > 1 or "" in rest else parts[0]
        return f"{inner}?" if "" in rest else inner

    return f"(?<![a-z0-9]){branch(set(found))}(?![a-z0-9])"


def _possible(weight: dict[str, float], other: float, threshold: float) -> Column:
    """Whether a unit of words, with its distinct ones and those of any template (mine), can reach the threshold.

    Its cosine to a template is at most the share of its norm that template words have,
    and each different word of no template adds at least its weight squared.
    """
    table = F.create_map(*(F.lit(x) for kv in sorted(weight.items()) for x in kv))
    value = lambda w: F.element_at(table, w) * (1 + F.log(F.size(F.filter("words", lambda x: x == w))))
    own = F.aggregate("mine", F.lit(0.0), lambda total, w: total + value(w) * value(w))
    rest = (F.size("distinct") - F.size("mine")) * F.lit(other * other)
    return own >= F.lit(threshold * threshold * 0.999) * (own + rest)


def unit_scores(units: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(path, licence, score) of every unit whose cosine to a template reaches the threshold; licence is the template's name.

    units: path, unit. Words are counted under the unit's number, so no text is shuffled.
    """
    weight, other = idf(templates)
    shares = vectors(templates)
    pattern = any_word(must_words(templates, threshold))
    lowered = units.select("path", F.monotonically_increasing_id().alias("number"), F.lower("unit").alias("unit"))
    likely = lowered.where(F.col("unit").rlike(pattern))
    found = F.filter(F.split("unit", "[^a-z0-9]+"), lambda w: w != "")
    known = F.array(*map(F.lit, sorted(weight)))
    cut = likely.select("path", "number", found.alias("words")).withColumn("distinct", F.array_distinct("words")).withColumn("mine", F.array_intersect("distinct", known))
    near = cut.where(_possible(weight, other, threshold))
    counts = near.select("path", "number", F.explode("words").alias("word")).groupBy("path", "number", "word").agg(F.count("*").alias("n"))
    # One row for each template word, with the templates that have it: as large as the argument, whatever the files are.
    has = lambda w: ", ".join(f"named_struct('name', '{name}', 'share', {v[w]!r}D)" for name, v in sorted(shares.items()) if w in v)
    entries = ", ".join(f"('{w}', {x!r}D, array({has(w)}))" for w, x in sorted(weight.items()))
    vocabulary = units.sparkSession.sql(f"SELECT * FROM VALUES {entries} AS v(word, weight, has)")
    valued = counts.join(F.broadcast(vocabulary), "word", "left").withColumn("value", (1 + F.log("n")) * F.coalesce("weight", F.lit(other)))
    # Each word adds to the unit's norm, under no name, and to the products with the templates that have it.
    own = F.array(F.struct(F.lit("").alias("name"), (F.col("value") * F.col("value")).alias("x")))
    each = F.transform(F.coalesce("has", F.array().cast("array<struct<name: string, share: double>>")), lambda h: F.struct(h["name"].alias("name"), (F.col("value") * h["share"]).alias("x")))
    sums = valued.select("path", "number", F.explode(F.concat(own, each)).alias("e")).groupBy("path", "number", "e.name").agg(F.sum("e.x").alias("x"))
    # At most one entry a template.
    unit = sums.groupBy("path", "number").agg(F.max(F.when(F.col("name") == "", F.sqrt("x"))).alias("norm"), F.collect_list(F.when(F.col("name") != "", F.struct("name", "x"))).alias("dots"))
    scored = unit.select("path", "norm", F.explode("dots").alias("d")).select("path", F.col("d.name").alias("licence"), F.round(F.col("d.x") / F.col("norm"), 6).alias("score"))
    return scored.where(F.col("score") >= threshold)


def best_notice(files: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(path, licence, score): the best template of any unit of each file that has one, by its name up to "/".

    "proprietary" counts where there is no other; of equal scores the first name wins.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    # A file whose words do not allow any match is left before it is cut up.
    likely = files.select("path", body.alias("body")).where(F.lower("body").rlike(any_word(must_words(templates, threshold))))
    whole = F.when(file_name(F.col("path")).rlike(LICENCE_FILE), F.array("body")).otherwise(F.array().cast("array<string>"))
    units = likely.select("path", F.explode(F.array_distinct(F.concat(F.split("body", "\n"), F.split("body", r"\n\s*\n"), whole))).alias("unit"))
    scores = unit_scores(units, templates, threshold).withColumn("licence", F.substring_index("licence", "/", 1))
    rank = F.struct((F.col("licence") == WEAKEST).alias("weak"), (-F.col("score")).alias("minus"), "licence")
    best = scores.groupBy("path").agg(F.min(rank).alias("b"))
    return best.select("path", "b.licence", (-F.col("b.minus")).alias("score"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory_of(path: Column) -> Column:
    """The path up to its last "/"; "" at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def nearest_licences(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, licence, from_dir): what each directory inherits from its nearest ancestor or itself.

    directories: dir; licensed: dir, licence, one row per directory.
    """
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    all_above = directories.distinct().select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "from_dir"))
    met = all_above.join(licensed.select(F.col("dir").alias("from_dir"), "licence"), "from_dir")
    return met.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "licence")).alias("m")).select("dir", "m.licence", "m.from_dir")


def scan(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.7) -> DataFrame:
    """(path, licence, score, own, from_dir), one row per row of files (path, text).

    own is true for a licence found in the file itself, with its cosine as score
    (rounded to 6 places); an inherited one has own false, no score, and the directory
    it comes from; a file without either has nulls and own false. Of several licence
    files in a directory the one with the best score, then the first name, counts. Rows that
    repeat a path are one file with the units of all of them; a null text has no
    notice; a null path is at no place in the tree: it is returned without a licence.
    An empty table gives an empty result; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    rows = files.select("path", "text")
    # Written: the texts are read once.
    notices = checkpoint(best_notice(rows.where("path IS NOT NULL"), templates, threshold))
    placed = notices.where(file_name(F.col("path")).rlike(LICENCE_FILE)).select(directory_of(F.col("path")).alias("dir"), "licence", "score")
    licensed = placed.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b")).select("dir", "b.licence")
    paths = rows.select("path", directory_of(F.col("path")).alias("dir"))
    # Written, so that a directory of very many files is split where it is joined.
    inherited = checkpoint(nearest_licences(paths.where("dir IS NOT NULL").select("dir"), licensed).withColumnRenamed("licence", "from_licence"))
    out = paths.join(notices, "path", "left").join(inherited, "dir", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        "path",
        F.coalesce("licence", "from_licence").alias("licence"),
        "score",
        own.alias("own"),
        F.when(~own, F.col("from_dir")).alias("from_dir"),
    )
