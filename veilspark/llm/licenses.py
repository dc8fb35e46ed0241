"""Licences of files: sparse TF-IDF cosine to templates, then inheritance by path.

A file's header lines, blocks of consecutive lines and its whole text are compared with licence templates as
sparse vectors of word weights (term count times inverse document frequency over
the templates; a word that no template has weighs the most). A line that is close
enough gives the file its licence; a file that is a licence as a whole (named as
a licence file, or no line of it is closer to a template than the whole) also
licenses its directory. Files without a licence of their own take that of the
nearest ancestor directory, found by joining the ancestors of paths with the
licensed directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.work import arrow_rows, keep

# Notices by which files state a licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights; CC0 1.0 public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
)
_SPDX = (
    "MIT ISC Unlicense CC0-1.0 Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 "
    "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"
).split()
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = TEMPLATES[1][1] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = TEMPLATES[9][1] + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_APACHE = TEMPLATES[3][1] + " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_AS_IS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
_GNU_AS_IS = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
_GNUS = (("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3"))
#: Full licence texts, headers as they stand in files, and short forms. Word weights stay those of TEMPLATES.
MORE = (
    ("Proprietary", "All rights reserved."),
    ("MIT", "MIT License"), ("MIT", "Licensed under the MIT License."), ("MIT", _MIT), ("MIT", f"{_MIT} {_AS_IS}"), ("MIT", f"MIT License Copyright (c) {_MIT} {_AS_IS}"),
    ("BSD-2-Clause", _BSD_2), ("BSD-2-Clause", f"{_BSD_2} {_BSD}"), ("BSD-3-Clause", _BSD_3), ("BSD-3-Clause", f"{_BSD_3} {_BSD}"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_AS_IS}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", TEMPLATES[11][1] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", TEMPLATES[18][1] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    *((key, _GNU.format(what=what, mark=":", name=name, v=v)) for key, what, name, v in _GNUS),
    *((key, _GNU.format(what=what, mark=":", name=name, v=v) + " " + _GNU_AS_IS.format(what=what, name=name)) for key, what, name, v in _GNUS),
    *((re.sub("-(only|or-later)$", "", x), f"SPDX-License-Identifier: {x}") for x in _SPDX),
)
#: The first of MORE stands beside other licences too, so it counts only where a file has no other.
WEAK = len(TEMPLATES)
LINE, FILE = 0.8, 0.8
#: Last parts of paths that name a licence file.
NAMED = "(?i)(^|/)[^/]*(licen[cs]e|copying|notice|copyright)[^/]*$"
WORDS = "[a-z0-9]+"
COMMENTED = re.compile(r"[ \t\n\f\r\v]*(?:[#/*;!%<>]|--|\"\"\"|'''|dnl |rem )", re.IGNORECASE)


def template_terms(more: tuple[tuple[str, str], ...] = ()) -> list[tuple[int, str, str, float]]:
    """(template, licence, term, weight) of TEMPLATES and ``more``, with weights of length one. Frequencies are those in TEMPLATES."""
    texts = TEMPLATES + more
    counts = [Counter(re.findall(WORDS, text.lower())) for _, text in texts]
    df = Counter(t for c in counts[: len(TEMPLATES)] for t in c)
    out = []
    for i, c in enumerate(counts):
        w = {t: n * idf(df[t]) for t, n in c.items()}
        size = math.sqrt(sum(v * v for v in w.values()))
        out += [(i, texts[i][0], t, v / size) for t, v in w.items()]
    return out


def idf(df: int) -> float:
    return math.log((1 + len(TEMPLATES)) / (1 + df)) + 1


def _frequencies(more: tuple[tuple[str, str], ...] = ()) -> dict[str, float]:
    df = Counter(t for _, _, t, _ in template_terms())
    return {t: idf(df[t]) for _, _, t, _ in template_terms(more)}


@lru_cache(maxsize=1)
def _compiled() -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Words of all templates by number, their idf, and a row of weights for each template."""
    freq = _frequencies(MORE)
    at = {t: i for i, t in enumerate(freq)}
    rows = np.zeros((len(TEMPLATES) + len(MORE), len(at)))
    for i, _, t, w in template_terms(MORE):
        rows[i, at[t]] = w
    return at, np.array(list(freq.values())), rows


def block_starts(lines: list[str]) -> list[tuple[int, int]]:
    """(first, behind last) of runs of two or more lines with words, all or none of them commented."""
    kinds = [bool(COMMENTED.match(x)) if re.search("[A-Za-z0-9]", x) else None for x in lines]
    edges = [0, *[i for i in range(1, len(lines)) if kinds[i] is not kinds[i - 1]], len(lines)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1 and kinds[a] is not None]


def _near(unit: np.ndarray, word: np.ndarray, units: int, least: float) -> np.ndarray:
    """Units (by number, given for each word) that can reach ``least``: the cosine is
    at most the length of the words that templates have to the length of all."""
    _, idf_of, _ = _compiled()
    known = word >= 0
    cell, n = np.unique(unit[known] * len(idf_of) + word[known], return_counts=True)
    own = np.bincount(cell // len(idf_of), (n * idf_of[cell % len(idf_of)]) ** 2, units)
    other = np.bincount(unit[~known], minlength=units) * idf(0) ** 2  # at least: a word that repeats weighs more
    return np.flatnonzero((own > 0) & (own >= (least - 1e-9) ** 2 * (own + other)))


def compare(path: str, text: str) -> Iterator[tuple[str, int, int, int, float]]:
    """(path, line, lines, template, score) of each line and block of lines that reaches LINE, and as line -1 of a whole text that reaches FILE."""
    at, idf_of, rows = _compiled()
    lines = text.split("\n")
    words = [re.findall(WORDS, x) for x in text.lower().split("\n")]
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    flat = [w for x in words for w in x]
    if not flat:
        return
    number = np.array([at.get(w, -1) for w in flat], np.int64)
    line = np.repeat(np.arange(len(words)), sizes)
    units = [(i, i + 1, i) for i in _near(line, number, len(words), LINE).tolist()]
    if len(lines) > 1:
        runs = block_starts(lines)
        begin = [int(ends[a] - sizes[a]) for a, _ in runs]
        stop = [int(ends[b - 1]) for _, b in runs]
        inside = np.concatenate([np.arange(a, b) for a, b in zip(begin, stop)]) if runs else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(runs)), np.array(stop, int) - np.array(begin, int)) if runs else inside
        units += [(*runs[i], runs[i][0]) for i in _near(owner, number[inside], len(runs), LINE).tolist()]
    units += [(0, len(words), -1) for _ in _near(np.zeros(len(flat), np.int64), number, 1, FILE).tolist()]
    for a, b, name in units:
        count = Counter(w for x in words[a:b] for w in x)
        v, size = np.zeros(len(idf_of)), 0.0
        for w, n in count.items():
            if (i := at.get(w)) is None:
                size += (n * idf(0)) ** 2
            else:
                v[i] = n * idf_of[i]
        scores = np.round(rows @ v / math.sqrt(size + float(v @ v)), 6)
        for i in np.flatnonzero(scores >= (FILE if name < 0 else LINE)).tolist():
            yield path, name, b - a if name >= 0 else 1, i, float(scores[i])


_FOUND = pa.schema([("path", pa.string()), ("line", pa.int32()), ("lines", pa.int32()), ("template", pa.int32()), ("score", pa.float64())])


def match_units(files: DataFrame) -> DataFrame:
    """(path, line, license, score, weak): each line and block of lines that reaches LINE, and as line -1 each whole text that reaches FILE, with its best template.

    Texts are compared where they lie; only what matches leaves a task.
    """
    good = files.select("path", "text").mapInArrow(arrow_rows(compare, _FOUND, ["path", "text"]), "path string, line int, lines int, template int, score double")
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES + MORE])
    good = good.withColumn("weak", (F.col("template") == WEAK).cast("int")).withColumn("license", F.get(names, F.col("template")))
    best = F.row_number().over(Window.partitionBy("path", "line").orderBy("weak", F.desc("score"), "template", "lines"))
    return good.withColumn("r", best).where("r = 1").select("path", "line", "license", "score", "weak")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """path, license, score, line, origin for every row of files (path, text).

    origin is "header" (a line or a block by its first line, the best; the first of equals), "file" (the whole
    text is a licence), "inherited" (from the nearest directory above that holds
    a licence file; of several files there the one with the least path) or null.
    line is the header's line, from 0. Null and empty texts have no licence of
    their own. Rows that repeat a path are read as parts of one file and each
    get the same answer; a null path has no directory and inherits nothing. An
    empty table gives an empty result; other columns are ignored.
    """
    files = files.select(F.coalesce("path", F.lit("\u0000")).alias("path"), "text")
    found = keep(match_units(files.where("text is not null")), "units")
    top = F.max(F.when(F.col("line") >= 0, F.col("score"))).over(Window.partitionBy("path"))
    found = found.withColumn("top", top).where((F.col("line") >= 0) | F.col("path").rlike(NAMED) | (F.col("score") >= F.coalesce("top", F.lit(0.0)))).drop("top")
    rank = F.row_number().over(Window.partitionBy("path").orderBy("weak", (F.col("line") >= 0).cast("int"), F.desc("score"), "line"))
    own = found.withColumn("r", rank).where("r = 1").drop("r")
    own = own.select("path", "license", "score", F.when(F.col("line") >= 0, F.col("line")).alias("line"), F.when(F.col("line") < 0, "file").otherwise("header").alias("origin"))
    dirs = own.where((F.col("origin") == "file") & (F.col("path") != "\u0000")).groupBy(_parent(F.col("path")).alias("dir"))
    dirs = dirs.agg(F.min(F.struct("path", "license", "score")).alias("f")).select("dir", F.col("f.license").alias("dir_license"), F.col("f.score").alias("dir_score"))
    steps = F.split(_parent(F.col("path")), "/")
    ups = files.select("path").distinct().join(own.select("path"), "path", "left_anti").where(F.col("path") != "\u0000")
    ups = ups.withColumn("s", steps).select("path", F.explode(F.sequence(F.lit(0), F.size("s"))).alias("depth"), "s").withColumn("dir", F.array_join(F.slice("s", 1, F.col("depth")), "/"))
    near = ups.join(dirs, "dir").groupBy("path").agg(F.max(F.struct("depth", "dir_license", "dir_score")).alias("m"))
    near = near.select("path", F.col("m.dir_license").alias("license"), F.col("m.dir_score").alias("score"), F.lit(None).cast("int").alias("line"), F.lit("inherited").alias("origin"))
    out = files.select("path").join(own.unionByName(near), "path", "left")
    return out.withColumn("path", F.when(F.col("path") != "\u0000", F.col("path"))).select("path", "license", "score", "line", "origin")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, license, score, line, origin: documents as files named source/lang/doc_id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    return scan(docs.select(path.alias("path"), "text")).select(F.regexp_extract("path", "[^/]*$", 0).try_cast("long").alias("doc_id"), "license", "score", "line", "origin")


def oracle() -> str:
    """The same over documents in DuckDB: each step a relation, every word of every line."""
    rows = ", ".join(f"({i}, '{name}', '{t}', {w!r}::DOUBLE)" for i, name, t, w in template_terms(MORE))
    freq = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in _frequencies(MORE).items())
    commented = r"^[ \t\n\f\r\v]*([#/*;!%<>]|--|\"\"\"|'''|dnl |rem )".replace("'", "''")
    return rf"""
WITH tmpl(template, license, term, weight) AS (VALUES {rows}),
known(term, idf) AS (VALUES {freq}),
files AS (SELECT concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), coalesce(doc_id::VARCHAR, 'none')) AS path, text, doc_id FROM documents),
lines AS (SELECT path, unnest(range(len(string_split(text, chr(10)))))::INT AS line, unnest(string_split(text, chr(10))) AS unit FROM files WHERE text IS NOT NULL),
kinds AS (SELECT *, CASE WHEN regexp_matches(unit, '[A-Za-z0-9]') THEN regexp_matches(unit, '{commented}', 'i') END AS kind FROM lines),
turns AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY path ORDER BY line) OR line = 0 THEN 1 ELSE 0 END AS fresh FROM kinds),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY line) AS island FROM turns),
blocks AS (SELECT path, min(line) AS line, count(*)::INT AS lines, string_agg(unit, chr(10) ORDER BY line) AS unit FROM islands WHERE kind IS NOT NULL GROUP BY path, island HAVING count(*) > 1),
units AS (SELECT path, line, 1 AS lines, unit FROM lines UNION ALL SELECT path, line, lines, unit FROM blocks UNION ALL SELECT path, -1, 1, text FROM files WHERE text IS NOT NULL),
words AS (SELECT path, line, lines, unnest(regexp_extract_all(lower(unit), '{WORDS}')) AS term FROM units),
tf AS (SELECT path, line, lines, term, count(*) AS n FROM words GROUP BY ALL),
w AS (SELECT tf.*, idf, n * coalesce(idf, {idf(0)!r}::DOUBLE) AS w FROM tf LEFT JOIN known USING (term)),
sizes AS (SELECT path, line, lines, sqrt(sum(w * w)) AS size FROM w GROUP BY ALL HAVING sum(w * w) FILTER (idf IS NOT NULL) >= 0.6 * sum(w * w)),
dots AS (SELECT path, line, lines, template, license, sum(w * weight) AS dot FROM w JOIN sizes USING (path, line, lines) JOIN tmpl USING (term) GROUP BY ALL),
scored AS (SELECT path, line, lines, template, license, round(dot / size, 6) AS score, (template = {WEAK})::INT AS weak FROM dots JOIN sizes USING (path, line, lines)),
found AS (SELECT * FROM scored WHERE score >= CASE WHEN line < 0 THEN {FILE} ELSE {LINE} END QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY weak, score DESC, template, lines) = 1),
tops AS (SELECT *, max(CASE WHEN line >= 0 THEN score END) OVER (PARTITION BY path) AS top FROM found),
best AS (SELECT * FROM tops WHERE line >= 0 OR regexp_matches(path, '{NAMED}') OR score >= coalesce(top, 0.0)),
own AS (SELECT path, license, score, CASE WHEN best.line >= 0 THEN best.line END AS line, CASE WHEN best.line < 0 THEN 'file' ELSE 'header' END AS origin
        FROM best QUALIFY row_number() OVER (PARTITION BY path ORDER BY weak, (best.line >= 0)::INT, score DESC, best.line) = 1),
dirs AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, arg_min(license, path) AS license, arg_min(score, path) AS score FROM own WHERE origin = 'file' GROUP BY 1),
near AS (SELECT f.path, d.license, d.score FROM files f JOIN dirs d ON f.path LIKE d.dir || '/%' WHERE f.path NOT IN (SELECT path FROM own)
         QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(d.dir) DESC) = 1),
every AS (SELECT * FROM own UNION ALL SELECT path, license, score, NULL, 'inherited' FROM near)
SELECT doc_id, license, score, line, origin FROM files LEFT JOIN every USING (path)
"""
