"""License scans on DataFrame functions alone: sparse TF-IDF cosine to templates, then inheritance by path joins.

What a text says of licences is compared with the templates: every line that speaks of them, every block of lines
(between blank lines, without comment signs, so that wrapped headers and licence files are read whole), and SPDX tags,
which are taken as they are. Terms are weighted by TF-IDF over the templates, which are a fixed, small set, so their
sparse vectors are literals in the expression and nothing is broadcast or shuffled to score. A licence only counts where
its distinctive terms stand (``NEEDED``: no MPL without Mozilla), and a short notice that denies one does not count. A
file has the licence of its best line or block, if the cosine reaches ``threshold``; a clause elsewhere in the file may
make it another of its family (``CLAUSES``). The texts are scanned once; what they say is stored.

Files that are a licence (by name, or because what they say of licences makes up more than half of their words) speak for their
directory. All others without a licence of their own inherit from the nearest ancestor directory: distinct directories
are exploded to their ancestors and joined by path, so a directory with a third of all files counts once; only then
do files join their directory.

Defined results: null and empty texts have no licence of their own, but may inherit. A null path neither gives nor
inherits. Of several licence files in a directory the best score counts, then the smaller path. Repeated rows are each
judged, extra columns stay (but results take the place of columns of their names), an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import private, table, with_results, written

#: Short notices, titles and headers by SPDX identifier.
_NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Simplified BSD License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EUPL-1.2", "Licensed under the EUPL 1.2"),
    ("EUPL-1.2", "European Union Public Licence V. 1.2"),
    ("Zlib", "zlib License"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
)
#: Terms that a text must have to be this licence at all; all those of one of the groups.
NEEDED = {
    "MIT": (("mit",), ("permission", "charge", "sublicense")), "Apache-2.0": (("apache",), ("basis", "conditions", "limitations")), "BSD-2-Clause": (("bsd", "2"), ("bsd", "simplified"), ("redistribution", "binary", "forms")),
    "BSD-3-Clause": (("bsd", "3"), ("bsd", "new"), ("neither", "endorse")), "MPL-2.0": (("mozilla",), ("mpl",)), "CC-BY-4.0": (("cc", "by"), ("creative", "commons")), "CC-BY-SA-4.0": (("cc", "sa"), ("commons", "sharealike")),
    "CC-BY-NC-4.0": (("cc", "nc"), ("commons", "noncommercial")), "CC0-1.0": (("cc0",),), "Unlicense": (("unencumbered",), ("unlicense",)), "ISC": (("isc",), ("permission", "fee", "copies")),
    "EPL-2.0": (("eclipse", "2"), ("epl", "2")), "EPL-1.0": (("eclipse", "1"), ("epl", "1")), "EUPL-1.2": (("eupl",), ("european", "union")), "Zlib": (("zlib",), ("misrepresented",)), "BSL-1.0": (("boost",),),
    "GPL": (("general", "public"),), "LGPL": (("lesser", "public"),), "AGPL": (("affero", "public"),),
}
#: What makes a licence another one, if the whole file has it.
CLAUSES = (("BSD-2-Clause", r"(?i)neither the names?\s+of", "BSD-3-Clause"),)
#: A short unit that says what does not hold names no licence.
DENIED, SHORT = r"(?i)\bnot\s+(?:\w+\s+){0,2}(?:under|subject to|covered by)\b", 400
#: The licences of one family, their versions, and the dates in the titles.
_FAMILY = (
    ("GPL", "General Public License", "program", "1.0", (("2", "2.0", "June 1991"), ("3", "3.0", "29 June 2007"))),
    ("LGPL", "Lesser General Public License", "library", "2.0", (("2.1", "2.1", "February 1999"), ("3", "3.0", "29 June 2007"))),
    ("AGPL", "Affero General Public License", "program", "1.0", (("3", "3.0", "19 November 2007"),)),
)


def _family():
    """Notices, titles and headers of the family, by version; without a version any of them may be chosen."""
    for short, name, work, oldest, versions in _FAMILY:
        for text in (f"GNU {name}", f"This {work} is licensed under the GNU {name}."):
            yield f"{short}-{oldest}-or-later", text
        for said, version, date in versions:
            header = f"This {work} is free software: you can redistribute it and/or modify it under the terms of"
            yield f"{short}-{version}-only", f"This work is licensed under the GNU {name}, version {said}."
            yield f"{short}-{version}-only", f"GNU {name} Version {said}, {date}"
            yield f"{short}-{version}-only", f"{header} version {said} of the GNU {name} as published by the Free Software Foundation."
            yield f"{short}-{version}-only", f"{header} the GNU {name} as published by the Free Software Foundation, version {said}."
            yield f"{short}-{version}-or-later", f"This work is licensed under the GNU {name}, version {said} or any later version."
            yield f"{short}-{version}-or-later", f"{header} the GNU {name} as published by the Free Software Foundation, either version {said} of the License, or (at your option) any later version."


TEMPLATES = (*_NOTICES, *_family())

TERM = "[a-z0-9]+"
_SPEAKS = "licen[cs]e|eupl|must not be misrepresented|spdx|copyright|permission is hereby|permission to use|redistribution and use|public domain|warranties or conditions"
LINE = f"(?imd)^.*(?:{_SPEAKS}).*$"
FILE_NAME = r"(?i)^(un)?licen[cs]e([.-].*)?$|^copying([.-].*)?$|^notice(\..*)?$"
#: A tag, and the identifiers whose bare version was given up.
SPDX = r"(?i)SPDX(?:-License-Identifier)?:[ \t]*\(?([a-z0-9.+-]*[a-z0-9+](?:[ \t]+(?:AND|OR|WITH)[ \t]+[a-z0-9.+-]*[a-z0-9+])*)"
BARE = r"\b((?:L|A)?GPL-[0-9][0-9.]*[0-9])"
COMMENT = r"^[ \t]*(?:/[/*]+|\*+/?|#+|;+|--+|<!--|%+|REM )?[ \t]*"
BLANK = r"\n[ \t\r]*(?:\n[ \t\r]*)+"
#: Numbers tell versions apart, so they weigh more than words.
NUMBERS = 2.0
THRESHOLD = 0.6


def needed(license_: str) -> tuple[tuple[str, ...], ...]:
    """The groups of terms of which a text must have one; versions of the GNU family share theirs."""
    return NEEDED[license_ if license_ in NEEDED else license_.split("-")[0]]


def weights(templates=TEMPLATES) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Inverse document frequency of each term, and each template's unit vector."""
    terms = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    df = Counter(t for c in terms for t in c)
    idf = {t: (math.log((1 + len(terms)) / (1 + n)) + 1) * (NUMBERS if t.isdigit() else 1) for t, n in df.items()}
    vectors = []
    for (name, _), counts in zip(templates, terms, strict=True):
        vector = {t: n * idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        vectors.append((name, {t: v / norm for t, v in vector.items()}))
    return idf, vectors


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def _dot(ws: Column, vector: Column) -> Column:
    return F.aggregate(ws, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(vector, x["t"]), F.lit(0.0)))


def best_template(line: Column, templates=TEMPLATES) -> Column:
    """Struct of score and license of the most similar template; ties go to the later identifier."""
    idf, vectors = weights(templates)
    unknown = math.log(1 + len(templates)) + 1  # of a term that no template has
    terms = F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))
    idf_map = _literal_map(idf)

    def counted(sorted_, ends):
        """From sorted terms and the place of the last of each: its weight."""
        n = lambda e, k: (e - F.when(k > 0, F.try_element_at(ends, k)).otherwise(0)).cast("double")
        return F.transform(ends, lambda e, k: F.struct(F.element_at(sorted_, e).alias("t"), (n(e, k) * F.coalesce(F.try_element_at(idf_map, F.element_at(sorted_, e)), F.lit(unknown))).alias("w")))

    def ends(sorted_):
        return F.filter(F.when(F.size(sorted_) > 0, F.sequence(F.lit(1), F.size(sorted_))).otherwise(F.expr("cast(array() as array<int>)")), lambda i: (i == F.size(sorted_)) | (F.element_at(sorted_, i) != F.try_element_at(sorted_, i + 1)))

    def bound(x, f):
        """f of a column that is made once."""
        return F.element_at(F.transform(F.array(x), f), 1)


    def scored(ws):
        norm = F.sqrt(F.aggregate(ws, F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
        has = lambda t: F.exists(ws, lambda x: x["t"] == t)
        scores = []
        for name, vector in vectors:
            dot = _dot(ws, _literal_map(vector))
            may = functools.reduce(operator.or_, [functools.reduce(operator.and_, map(has, group)) for group in needed(name)])
            scores.append(F.struct(F.when(may, F.round(dot / norm, 6)).otherwise(0.0).alias("score"), F.lit(name).alias("license")))
        return F.array_max(F.array(*scores))

    return bound(F.array_sort(terms), lambda s: bound(ends(s), lambda e: bound(counted(s, e), scored)))


def tag_of(line: Column) -> Column:
    """The expression of an SPDX tag, in the present identifiers; empty without."""
    said = F.regexp_extract(line, SPDX, 1)
    return F.regexp_replace(F.regexp_replace(said, BARE + r"\+", "$1-or-later"), BARE + r"(?!-|\.)(?=$|\s)", "$1-only")


def scan(files: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with ``own``: struct of license, score, line (the best line or block), share (of the words, in what speaks of licences); null without."""
    source = F.col(text)
    lines = F.regexp_extract_all(source, F.lit(LINE), F.lit(0))
    blocks = F.filter(F.split(F.regexp_replace(source, f"(?md){COMMENT}", F.lit("")), BLANK), lambda b: b.contains("\n") & b.rlike(f"(?i){_SPEAKS}"))
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))

    def judged(units):
        of = F.transform(units, lambda x: F.struct(F.when(tag_of(x) != "", F.struct(F.lit(1.0).alias("score"), tag_of(x).alias("license"))).otherwise(best_template(x)).alias("best"), x.alias("line")))
        return F.filter(of, lambda x: (x["best"]["score"] >= threshold) & ~((F.length(x["line"]) < SHORT) & x["line"].rlike(DENIED)))

    good, own_lines, own_blocks = private(files, "good", "lines", "blocks")
    spoken = [F.aggregate(c, F.lit(0), lambda n, x: n + words(x["line"])) for c in (own_lines, own_blocks)]
    best = F.array_max(good)
    name = best["best"]["license"]
    for bare, clause, other in CLAUSES:
        name = F.when((name == bare) & source.rlike(clause), other).otherwise(name)
    own = F.struct(name.alias("license"), best["best"]["score"].alias("score"), best["line"].alias("line"), (F.greatest(*spoken) / F.greatest(words(source), F.lit(1))).alias("share"))
    speaks = source.rlike(f"(?i){_SPEAKS}")
    out = files.withColumns({own_lines: F.when(speaks, judged(lines)), own_blocks: F.when(speaks, judged(blocks))})
    out = out.withColumn(good, F.concat(own_lines, own_blocks))
    return out.select(with_results(out, files.columns, {"own": F.when(F.size(good) > 0, own)}))


def directory(path: Column) -> Column:
    """The path without its last part; the top is the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", F.lit(""))).when(path.isNotNull(), F.lit(""))


def ancestors(folder: Column) -> Column:
    """A directory and all those above it, the top last."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_union(above, F.array(F.lit("")))


def inherit(scanned: DataFrame, path: str = "path") -> DataFrame:
    """Adds license, license_from (own, inherited or none) and license_dir to the result of ``scan``, which should be stored."""
    names = scanned.columns
    dir_, up, license_, far = private(scanned, "dir", "up", "license", "far")
    files = scanned.withColumn(dir_, directory(F.col(path)))
    speaks = F.col("own").isNotNull() & (F.element_at(F.split(path, "/"), -1).rlike(FILE_NAME) | (F.col("own.share") > 0.5))
    order = F.struct(-F.col("own.score"), F.col(path))
    given = files.filter(speaks & F.col(dir_).isNotNull()).groupBy(F.col(dir_).alias(up)).agg(F.min_by("own.license", order).alias(license_))
    folders = files.filter(F.col("own").isNull() & F.col(dir_).isNotNull()).select(dir_).distinct()
    lifted = folders.select(dir_, F.posexplode(ancestors(F.col(dir_))).alias(far, up)).join(given, up)
    nearest = lifted.groupBy(dir_).agg(F.min_by(license_, far).alias(license_), F.min_by(up, far).alias(up))
    out = files.join(nearest, dir_, "left")
    alone = F.col("own").isNotNull()
    results = {
        "license": F.when(alone, F.col("own.license")).otherwise(F.col(license_)),
        "license_from": F.when(alone, "own").when(F.col(license_).isNotNull(), "inherited").otherwise("none"),
        "license_dir": F.when(alone, F.lit(None)).otherwise(F.col(up)),
    }
    return out.select(with_results(out, names, results))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """``documents`` as files source/lang/doc_id: licence of each, with the line and score of its own notice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    found = inherit(written(scan(docs).drop("text"), "licenses"))
    return found.select("doc_id", "path", "license", "license_from", "license_dir", F.round("own.score", 4).alias("score"), F.col("own.line").alias("line"))


def _sql() -> str:
    idf, vectors = weights()
    term_rows = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in sorted(idf.items()))
    need_rows = ", ".join(f"('{n}', {a}, {len(group)}, '{t}')" for n in dict(vectors) for a, group in enumerate(needed(n)) for t in group)
    named = "o.license"
    for bare, clause, other in CLAUSES:
        named = f"CASE WHEN {named} = '{bare}' AND regexp_matches(text, '{clause}') THEN '{other}' ELSE {named} END"
    template_rows = ", ".join(f"({k}, '{name}', '{t}', {v!r}::DOUBLE)" for k, (name, vector) in enumerate(vectors) for t, v in sorted(vector.items()))
    return rf"""
WITH idf(t, v) AS (VALUES {term_rows}), template(k, license, t, v) AS (VALUES {template_rows}), need(license, a, terms, t) AS (VALUES {need_rows}),
doc AS (SELECT row_number() OVER () AS r, doc_id, text, source || '/' || lang AS dir, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents),
line AS (SELECT r, 0 AS kind, i, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM doc WHERE regexp_matches(text, '{_SPEAKS}', 'i')) WHERE regexp_matches(line, '{_SPEAKS}', 'i')
  UNION ALL SELECT r, 1, i, line FROM (SELECT r, unnest(b) AS line, generate_subscripts(b, 1) AS i FROM (SELECT r, string_split_regex(regexp_replace(text, '(?m){COMMENT}', '', 'g'), '{BLANK}') AS b FROM doc WHERE regexp_matches(text, '{_SPEAKS}', 'i'))) WHERE contains(line, chr(10)) AND regexp_matches(line, '{_SPEAKS}', 'i')),
term AS (SELECT r, kind, i, t, count(*) AS n FROM (SELECT r, kind, i, unnest(regexp_extract_all(lower(line), '{TERM}')) AS t FROM line) GROUP BY ALL),
weighed AS (SELECT r, kind, i, t, n * coalesce(v, {math.log(1 + len(vectors)) + 1!r}) AS w FROM term LEFT JOIN idf USING (t)),
may AS (SELECT DISTINCT r, kind, i, license FROM (SELECT r, kind, i, license, a FROM term JOIN need USING (t) GROUP BY ALL HAVING count(*) = any_value(terms))),
norm AS (SELECT r, kind, i, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
scored AS (SELECT r, kind, i, k, license, round(sum(w * v) / any_value(norm), 6) AS score FROM weighed JOIN template USING (t) JOIN may USING (r, kind, i, license) JOIN norm USING (r, kind, i) GROUP BY ALL),
tag AS (SELECT r, kind, i, regexp_replace(regexp_replace(regexp_extract(line, '{SPDX}', 1), '{BARE}\+', '\1-or-later', 'g'), '{BARE}($|\s)', '\1-only\2', 'g') AS tag FROM line),
best AS (SELECT r, kind, line, CASE WHEN tag <> '' THEN struct_pack(score := 1.0::DOUBLE, license := tag) ELSE b END AS b
  FROM line JOIN tag USING (r, kind, i) LEFT JOIN (SELECT r, kind, i, max(struct_pack(score := score, license := license)) AS b FROM scored GROUP BY ALL) USING (r, kind, i) WHERE (tag <> '' OR b.score >= {THRESHOLD}) AND NOT (length(line) < {SHORT} AND regexp_matches(line, '{DENIED}'))),
own AS (SELECT r, max(struct_pack(score := b.score, license := b.license, line := line)) AS o, greatest(sum(CASE kind WHEN 0 THEN len(regexp_extract_all(line, '\S+')) ELSE 0 END), sum(CASE kind WHEN 1 THEN len(regexp_extract_all(line, '\S+')) ELSE 0 END)) AS spoken FROM best GROUP BY r),
file AS (SELECT doc.*, CASE WHEN o IS NOT NULL THEN struct_pack(license := {named}, score := o.score, line := o.line) END AS o, spoken / greatest(len(regexp_extract_all(text, '\S+')), 1) AS share FROM doc LEFT JOIN own USING (r)),
given AS (SELECT dir, arg_min(o.license, struct_pack(s := -o.score, p := path)) AS license FROM file WHERE o IS NOT NULL AND share > 0.5 GROUP BY dir),
up AS (SELECT dir, dir AS up, 0 AS far FROM (SELECT DISTINCT dir FROM file) UNION ALL SELECT dir, split_part(dir, '/', 1), 1 FROM (SELECT DISTINCT dir FROM file) UNION ALL SELECT dir, '', 2 FROM (SELECT DISTINCT dir FROM file)),
near AS (SELECT up.dir, arg_min(license, far) AS license, arg_min(up, far) AS up FROM up JOIN given ON up.up = given.dir GROUP BY up.dir)
SELECT doc_id, path, CASE WHEN o IS NULL THEN near.license ELSE o.license END AS license,
       CASE WHEN o IS NOT NULL THEN 'own' WHEN near.license IS NULL THEN 'none' ELSE 'inherited' END AS license_from,
       CASE WHEN o IS NULL THEN near.up END AS license_dir, round(o.score, 4) AS score, o.line AS line
FROM file LEFT JOIN near ON file.dir = near.dir
"""


OP3_SQL = _sql()
