"""Licence scan against plain loops over units, templates and ancestors."""
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadpulse.llm import licences as L
from roadpulse.llm import queries

GPL = L.TEMPLATES["GPL-3.0"][-1]
MIT = L.TEMPLATES["MIT"][-1]
BSD = L.TEMPLATES["BSD-3-Clause"][-1]


def wrapped(text, mark, width=60):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line += " " + w
    return "\n".join(f"{mark}{x}" for x in [*out, line])


def terms(text):
    return [t for t in re.split(r"[^\w]|_", (text or "").lower()) if t]


def unit_texts(text):
    lines = (text or "").split("\n")
    yield from ((x, False) for x in lines)
    for inside in (lambda x: re.search(r"[^\W_]", x), lambda x: re.search(L.COMMENT, x)):
        run = []
        for x in [*lines, None]:
            if x is not None and inside(x):
                run.append(x)
            else:
                if len(run) > 1:
                    yield "\n".join(run), False
                run = []
    yield text or "", True


def brute(files, scan=L.Scan()):
    """(id, path, licence, origin) of each file."""
    named = [(n, L.template_terms(t)) for n, texts in scan.templates.items() for t in texts]
    vocabulary = {t for _, w in named for t in w}
    held = Counter(t for _, _, text in files for t in set(terms(text)) & vocabulary)
    weight = {t: math.log((1 + len(files)) / (1 + held[t])) + 1 for t in vocabulary}
    other = sum(weight.values()) / len(weight)
    vec = lambda w: {t: n * weight.get(t, other) for t, n in Counter(w).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(n, vec(w)) for n, w in named]
    own = []
    for _, path, text in files:
        best, whole_hit = None, False
        for unit, whole in unit_texts(text):
            u = vec(terms(unit))
            if not u:
                continue
            name, score = min(((n, round(sum(x * v.get(t, 0) for t, x in u.items()) / norm(u) / norm(v), 4)) for n, v in templates), key=lambda x: (-x[1], x[0]))
            if score >= (scan.min_text if whole else scan.min_line):
                best = min(filter(None, (best, (-score, name))))
                whole_hit |= whole and len(terms(unit)) >= scan.min_text_terms
        own.append((best, bool(best) and (whole_hit or bool(re.search(L.FILE_NAME, path or "")))))
    folder = lambda p: p.rpartition("/")[0]
    at = {}
    for (_, path, _), (best, is_file) in zip(files, own):
        if is_file and path is not None:
            at.setdefault(folder(path), []).append((*best, path))
    out = []
    for (i, path, _), (best, is_file) in zip(files, own):
        if best:
            out.append((i, path, best[1], "file" if is_file else "header"))
            continue
        up = None if path is None else folder(path)
        while up is not None and up not in at:
            up = None if up == "" else folder(up)
        out.append((i, path, min(at[up])[1] if up is not None else None, "inherited" if up is not None else "none"))
    return sorted(out, key=str)


FILES = [
    (1, "p/src/gpl.py", wrapped(GPL, "# ") + "\n\nimport os\n" + "x = y\n" * 50),
    (2, "p/src/mit.c", "/*\n" + wrapped(MIT, " * ") + "\n */\n" + "".join(f"int value_{i} = {i};\n" for i in range(200))),
    (3, "p/LICENSE", "Copyright (c) 2001, Some One\nAll rights reserved.\n\n" + wrapped(BSD, "")),
    (4, "p/src/deep/er/plain.txt", "nothing of interest"), (5, "p/vendor/COPYING", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    (6, "p/vendor/x/a.c", None), (7, "q/a.c", ""), (8, None, "plain"), (9, "LICENSE.md", "Released under the MIT License."), (10, "top.txt", "text"),
    (11, "p/src/deep", "long " * 30_000), (None, "p/src/deep/er/plain.txt", "nothing of interest"), (4, "p/src/deep/er/plain.txt", "nothing of interest"),
    (12, "r/s.py", "# SPDX-License-Identifier: ISC\n"), (13, "r/apache.go", "// Copyright 2020\n//\n" + wrapped(L.TEMPLATES["Apache-2.0"][-1], "// ") + "\n\npackage r\n" + "func f() {}\n" * 100),
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string").withColumn("licence", F.lit(1)).withColumn("dir", F.lit(2)).withColumn("units", F.lit(3))
    got = sorted(((r.doc_id, r.path, r.licence, r.origin) for r in L.scanned(df).collect()), key=str)
    assert got == brute(FILES)
    named = {i: (x, o) for i, _, x, o in got if i}
    assert named[1] == ("GPL-3.0", "header") and named[2] == ("MIT", "header") and named[3] == ("BSD-3-Clause", "file")
    assert named[4] == ("BSD-3-Clause", "inherited") and named[6] == ("LGPL-3.0", "inherited") and named[7] == ("MIT", "inherited")
    assert named[8] == (None, "none") and named[10] == ("MIT", "inherited") and named[13] == ("Apache-2.0", "header")


@pytest.mark.parametrize("name, text", [(n, t) for n, texts in sorted(L.TEMPLATES.items()) for t in texts[2:]])
def test_each_notice_is_found_in_comments(spark, name, text):
    """By brute force, which the operator equals: wrapped over comment lines above code."""
    body = wrapped(text, "# ") + "\n\n" + "call(a, b)\n" * 100
    assert brute([(1, "x.py", body)]) == [(1, "x.py", name, "header")]


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op10_licences(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert sorted(((r.doc_id, r.path, r.licence, r.origin) for r in got), key=str) == brute([(r.doc_id, r.path, texts[r.doc_id]) for r in got])


def test_registered_query_has_all_origins(spark):
    origins = {r.origin: r["count"] for r in queries.op10_licences(spark, "/root/testdata/sf0.01").groupBy("origin").count().collect()}
    assert set(origins) == {"file", "header", "inherited", "none"} and origins["inherited"] > 20
