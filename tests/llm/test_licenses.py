import math
import re
from collections import Counter

import duckdb

from siltstone.llm import licenses

MIT = "Released under the MIT License."


def cosine(line):
    idf, vectors = licenses.weights()
    counts = Counter(re.findall("[a-z0-9]+", line.lower()))
    w = {t: n * idf.get(t, math.log(1 + len(vectors)) + 1) for t, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in w.values())) or 1
    may = lambda name: any(set(g) <= set(counts) for g in licenses.needed(name))
    return max((round(sum(w.get(t, 0) * v for t, v in vector.items()) / norm, 6) if may(name) else 0.0, name) for name, vector in vectors)


def test_templates_find_themselves(spark):
    lines = [t for _, t in licenses.TEMPLATES] + ["Licensed under CC BY-NC 4.0", "// license: Apache License 2.0, see file", "all about the driving license test of my friend", "", "!!"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [tuple(r[0]) for r in df.select(licenses.best_template(df.line)).collect()]
    for line, (score, name) in zip(lines, got, strict=True):
        want = cosine(line)
        assert abs(score - want[0]) < 2e-6 and (name == want[1] or score == 0)
    assert [n for _, n in got[: len(licenses.TEMPLATES)]] == [n for n, _ in licenses.TEMPLATES] and got[-3][0] < licenses.THRESHOLD


BSD_3 = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licences_that_resemble_each_other(spark):
    cases = [
        (BSD_3, "BSD-3-Clause"), (BSD_3.split("3. Neither")[0], "BSD-2-Clause"), ("Eclipse Public License - v 2.0", "EPL-2.0"), ("Licensed under the EUPL 1.2", "EUPL-1.2"), ("The BSD license", None),
        ("NOT released under the MIT License.", None), ("This is not licensed under the Apache License, Version 2.0.", None), ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"), ("Some Other Public License Version 2.0", None),
        ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented;", "Zlib"), ("Released under the MIT License.", "MIT"),
        ("Licensed under the Foo License, Version 2.0", None), ("This work is licensed under the Bar Public License, version 3.", None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k long, text string")
    got = {r.k: r.own and r.own.license for r in licenses.scan(df).collect()}
    assert {t[:40]: got[k] for k, (t, w) in enumerate(cases) if got[k] != w} == {}


GPL_HEADER = """/*
 * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty.
 */
int main() { return 0; }
"""


def test_headers_files_and_tags(spark):
    cases = [
        ("GNU GENERAL PUBLIC LICENSE", "GPL-1.0-or-later"), ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nEveryone is permitted", "GPL-2.0-only"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-2.1-only"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("// SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"),
        ("// SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1-or-later"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("SPDX: ISC", "ISC"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR Apache-2.0"), ("Mozilla Public License Version 2.0\n\n1. Definitions", "MPL-2.0"), (GPL_HEADER, "GPL-2.0-or-later"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-only"), ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-only"),
        ("my driving license came today\nand the dog barked", None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k long, text string")
    got = {r.k: r.own and r.own.license for r in licenses.scan(df).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a/LICENSE", MIT, 1, 2, 3, "x"), ("a/b", "code", 1, 2, 3, "x")], "path string, text string, _dir int, _up int, _good int, license string")
    got = licenses.inherit(licenses.scan(df))
    assert got.columns == ["path", "text", "_dir", "_up", "_good", "own", "license", "license_from", "license_dir"]
    assert {(r.path, r._dir, r.license) for r in got.collect()} == {("a/LICENSE", 1, "MIT"), ("a/b", 1, "MIT")}


def test_inheritance(spark):
    code = "x = 1\n" * 50
    rows = [("LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/x.py", code), ("a/x.py", code), ("a/b/y.py", code + MIT), ("z/only", MIT), ("z/q/w.py", None), ("top.py", ""), (None, code), (None, MIT), ("a/x.py", code)]
    df = spark.createDataFrame([(p, t, "n") for p, t in rows], "path string, text string, license_note string")
    got = sorted(((r.path, r.license, r.license_from, r.license_dir) for r in licenses.inherit(licenses.scan(df)).collect()), key=str)
    assert got == sorted(
        [("LICENSE", "Apache-2.0", "own", None), ("a/b/COPYING", "GPL-3.0-only", "own", None), ("a/b/c/x.py", "GPL-3.0-only", "inherited", "a/b"), ("a/x.py", "Apache-2.0", "inherited", ""), ("a/x.py", "Apache-2.0", "inherited", ""), ("a/b/y.py", "MIT", "own", None), ("z/only", "MIT", "own", None), ("z/q/w.py", "MIT", "inherited", "z"), ("top.py", "Apache-2.0", "inherited", ""), (None, None, "none", None), (None, "MIT", "own", None)], key=str
    )
    assert licenses.inherit(licenses.scan(df.limit(0))).count() == 0


def test_long_texts(spark):
    text = "word " * 200_000 + "\n" + MIT + "\n" + "license " * 1000
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.own.license == "MIT" and row.own.line == MIT


def test_sql_on_headers_and_tags(spark, tmp_path):
    texts = [GPL_HEADER, "# SPDX-License-Identifier: GPL-2.0+ \n\ncode", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nmore", "; a\n;\n; license\n\n\n x license y\nz", "SPDX: (GPL-2.0 OR MIT)", None, "", BSD_3, "NOT released under the MIT License.", "Eclipse Public License - v 2.0", "The BSD license", "Some Other Public License Version 2.0"]
    docs = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")


def test_query_against_sql(spark, sf01):
    compare(spark, sf01, f"{sf01}/documents.parquet")


def compare(spark, sf01, files):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    frame = licenses.op3_licenses(spark, sf01)
    cur = con.execute(licenses.OP3_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r)) for r in frame.select(names).collect()) == want
    assert re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString()) is None
