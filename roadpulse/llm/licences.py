"""Licence scan (operator 10).

Units of a file are its lines, its blocks (paragraphs of several lines, and runs
of comment lines, so that a notice wrapped over lines is one unit) and its text
as a whole (licence files).  A unit is compared with every template by the cosine of sparse TF-IDF vectors
over lower-cased runs of letters and digits.  Inverse document frequencies of
the templates' terms are counted over all files; other terms, which only
lengthen a unit's vector, get the templates' mean.

Most units share nothing telling with a template.  For each template, its
commonest terms whose joint weight stays below the threshold cannot reach it
alone (Cauchy-Schwarz), so a unit must have one of the others: an exact test
inside the row, made for the whole text first and then for each unit.  Only units that pass are exploded to terms, each distinct unit
once, and scored by joins with the template vectors (a table of fixed size).

A file's own licence is its best unit.  A file that is named like a licence
file, or whose whole text matches, holds for its directory; files without a
licence of their own take that of the nearest ancestor directory that has one:
distinct directories are exploded to their ancestors (as many rows as the path
is deep), joined with the licence directories, and the deepest match is joined
back by directory.

Only built-in functions are used; what reaches the driver is one row per
template term.

Defined cases: null and empty texts have no licence of their own; null paths
inherit nothing; ties go to the first template name, then the first path;
repeated rows each get a result; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import materialize

# fixed values: notices and texts of public licences
_BSD_GRANT = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
              "following conditions are met:")
_BSD_SOURCE = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
               "following disclaimer.")
_BSD_BINARY = ("2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
               "following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission.")
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {what} as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {what} for more details. You should have received a copy of "
    "the {what} along with this program. If not, see https://www.gnu.org/licenses/.")
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ "
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-2-Clause",
        f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        _GNU_NOTICE.format(what="GNU General Public License", version=2),
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _GNU_NOTICE.format(what="GNU General Public License", version=3),
    ],
    "ISC": [
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
        "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _GNU_NOTICE.format(what="GNU Lesser General Public License", version=3),
    ],
    "MIT": [
        "Released under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"


@dataclass(frozen=True)
class Scan:
    templates: dict = field(default_factory=lambda: TEMPLATES)
    min_line: float = 0.7
    min_text: float = 0.7
    #: a nameless file holds for its directory only if it is a licence's text, not a notice: terms at least
    min_text_terms: int = 50


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def template_terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def idf(files: DataFrame, vocabulary: list[str], text: str) -> dict[str, float]:
    """Smoothed inverse document frequency of each template term, over all files."""
    here = F.explode(F.array_intersect(terms_of(F.col(text)), strings(vocabulary)))
    found = {r["term"]: r["n"] for r in files.select(here.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = files.count()
    return {t: math.log((1 + total) / (1 + found.get(t, 0))) + 1 for t in vocabulary}


def unit_vector(terms: list[str], weight: dict[str, float]) -> dict[str, float]:
    v = {t: n * weight[t] for t, n in sorted(Counter(terms).items())}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / norm for t, x in v.items()}


def telling(vectors: list[dict[str, float]], least: float, weight: dict[str, float]) -> list[str]:
    """Terms of which a unit must have one to reach ``least`` with any template: all but each template's commonest."""
    keep = set()
    for v in vectors:
        light = 0.0
        for t, x in sorted(v.items(), key=lambda i: (weight[i[0]], i[0])):
            light += x * x
            if math.sqrt(light) >= least * (1 - 1e-9):
                keep.add(t)
    return sorted(keep)


#: A line that begins like a comment.
COMMENT = r"^[ \t]*(#|//|/?\*|--|;|%|<!--)"
CUT = "\x00"


def blocks(lines: Column) -> Column:
    """Texts of several lines: paragraphs (runs of lines with a letter or digit), and runs of comment lines."""
    def runs(inside: Callable[[Column], Column]) -> Column:
        marked = F.array_join(F.transform(lines, lambda x: F.when(inside(x), x).otherwise(CUT)), "\n")
        return F.split(marked, CUT)

    every = F.concat(runs(lambda x: x.rlike(r"[\p{L}\p{N}]")), runs(lambda x: x.rlike(COMMENT)))
    return F.array_distinct(F.filter(every, lambda x: F.contains(F.trim(x, F.lit("\n")), F.lit("\n"))))


def units(files: DataFrame, triggers: list[str]) -> DataFrame:
    """(rid, id, path, units): every row with its candidate units."""
    as_unit = lambda x, whole: F.struct(F.lit(whole).alias("whole"), terms_of(x).alias("terms"))
    told = lambda u: F.arrays_overlap(u["terms"], strings(triggers))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    parts = F.transform(F.concat(lines, blocks(lines)), lambda x: as_unit(x, False))
    # no unit has a term that the whole text lacks
    whole = as_unit(F.col("text"), True)
    found = files.select(F.monotonically_increasing_id().alias("rid"), "id", "path", "text", whole.alias("all"))
    candidates = F.when(told(F.col("all")), F.concat(F.filter(parts, told), F.array("all"))).otherwise(F.slice(F.array("all"), 1, 0))
    return found.select("rid", "id", "path", candidates.alias("units"))


def unit_scores(found: DataFrame, vectors: DataFrame, weights: DataFrame, other: float) -> DataFrame:
    """(h1, h2, best): the best (score, template) of each distinct unit."""
    distinct = found.groupBy("h1", "h2").agg(F.first("terms").alias("terms"))
    tf = distinct.select("h1", "h2", F.explode("terms").alias("term")).groupBy("h1", "h2", "term").agg(F.count(F.lit(1)).alias("tf"))
    x = F.col("tf") * F.coalesce("idf", F.lit(other))
    tf = materialize(tf.join(F.broadcast(weights), "term", "left").withColumn("x", x), "licence-terms")
    norm = tf.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = tf.join(F.broadcast(vectors), "term").groupBy("h1", "h2", "licence", "variant").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 4)
    best = dot.join(norm, ["h1", "h2"]).select("h1", "h2", "licence", score.alias("score"))
    return best.groupBy("h1", "h2").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))


def scanned(files: DataFrame, scan: Scan = Scan(), id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(id, path, licence, origin, score) for every row of ``files``; origin is
    header, file, inherited or none."""
    spark = files.sparkSession
    plain = files.select(F.col(id).alias("id"), F.col(path).alias("path"), F.col(text).alias("text"))
    named = [(name, k, template_terms(t)) for name, texts in sorted(scan.templates.items()) for k, t in enumerate(texts)]
    vocabulary = sorted({t for _, _, terms in named for t in terms})
    weight = idf(plain, vocabulary, "text")
    vectors = [(name, k, unit_vector(terms, weight)) for name, k, terms in named]
    triggers = telling([v for _, _, v in vectors], min(scan.min_line, scan.min_text), weight)
    vector_table = spark.createDataFrame([(n, k, t, w) for n, k, v in vectors for t, w in v.items()],
                                         "licence string, variant int, term string, w double")
    weight_table = spark.createDataFrame(sorted(weight.items()), "term string, idf double")

    rows = materialize(units(plain, triggers), "licence-units")
    found = rows.select("rid", F.explode("units").alias("u")).select("rid", "u.whole", "u.terms")
    found = found.select("rid", "whole", "terms", F.xxhash64("terms").alias("h1"), F.xxhash64(F.lit(1), "terms").alias("h2"))
    scores = materialize(unit_scores(found, vector_table, weight_table, sum(weight.values()) / len(weight)), "licence-scores")
    hit = found.withColumn("n", F.size("terms")).drop("terms").join(scores, ["h1", "h2"])
    enough = -F.col("best.minus") >= F.when(F.col("whole"), scan.min_text).otherwise(scan.min_line)
    own = hit.where(enough).groupBy("rid").agg(F.min("best").alias("best"), F.max(F.col("whole") & (F.col("n") >= scan.min_text_terms)).alias("whole"))
    own = rows.select("rid", "id", "path").join(own, "rid", "left").select(
        "id", "path", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"),
        (F.coalesce("whole", F.lit(False)) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))).alias("is_file"),
        F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    own = materialize(own, "own-licences")
    given = materialize(inherited(own), "directory-licences")  # written: a hot directory can then be split in the join
    return own.join(given, "dir", "left").select(
        F.col("id").alias(id), "path", F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(F.col("licence").isNotNull() & F.col("is_file"), "file").when(F.col("licence").isNotNull(), "header")
        .when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce("score", "dir_score").alias("score"))


def inherited(own: DataFrame) -> DataFrame:
    """(dir, dir_licence, dir_score) for directories under one that has a licence file."""
    files = own.where(F.col("is_file") & F.col("licence").isNotNull() & F.col("dir").isNotNull())
    files = files.groupBy(F.col("dir").alias("at")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence", "path")).alias("f"))
    dirs = own.where(F.col("licence").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))
    up = F.when(F.col("dir") == "", F.slice(up, 1, 1)).otherwise(up)
    above = dirs.select("dir", F.explode(up).alias("a")).select("dir", "a.depth", "a.at")
    # written, so that a root directory, under which all others meet, can be split or sent along in the join
    near = above.join(materialize(files, "licence-files"), "at").groupBy("dir").agg(F.max_by("f", "depth").alias("f"))
    return near.select("dir", F.col("f.licence").alias("dir_licence"), (-F.col("f.minus")).alias("dir_score"))
