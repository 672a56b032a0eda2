"""License notices in documents: MinHash bands over text windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

from functools import lru_cache, reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import check_columns

# Identifiers of licenses, and the wording of their texts, heads and notices.
IDENTIFIERS = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "WTFPL", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later",
)
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
)
_NOTICE = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MIT", 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0-or-later", _NOTICE.format(";", "General Public License", ";", 2)),
    ("GPL-3.0-or-later", _NOTICE.format(":", "General Public License", ",", 3)),
    ("LGPL-2.1-or-later", _NOTICE.replace("program", "library").format(";", "Lesser General Public License", ";", 2.1)),
    ("AGPL-3.0-or-later", _NOTICE.format(":", "Affero General Public License", ",", 3)),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", f"{_BSD_HEAD}: {_BSD_TWO} {_BSD_END}"),
    ("BSD-3-Clause", _BSD_HEAD),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    *TEXTS,
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in COMMONS),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in COMMONS.items()),
    ("SPDX", "SPDX-License-Identifier:"),
)
#: The template after which an expression is read: licenses with AND and OR between them, in parentheses or not, and exceptions after WITH.
SPDX = len(TEMPLATES) - 1
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
EXPRESSION = rf"(?:SPDX|spdx)-(?:License|license)-(?:Identifier|identifier):[ \t]*([( \t]*{_ID}[) \t]*(?:(?:AND|OR|WITH)[( \t]+{_ID}[) \t]*)*)"
EXCEPTION = rf"WITH[ \t]+{_ID}"
#: Words: letters with digits and inner dots, lower case.
TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
#: Words of a shingle; notices may have as few.
WIDTH = 3
#: Least share of a template's shingles that a window holds.
CONTAINED = 0.8
#: A window is WINDOW blocks of a power of two, b, of shingles, and one starts at each block.  A template of m shingles
#: takes the least b with 3 b + 1 >= m, so that wherever it stands a window holds it whole, and m >= 1.5 b.  The Jaccard
#: similarity of window and template is then 0.27 at the least containment and 0.37 for a verbatim notice, and BANDS
#: bands of one row miss it with a chance of 3e-5 and 4e-7.
WINDOW, BANDS = 4, 32


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _shingles(words: str) -> Column:
    """Hashes of all runs of WIDTH words of an array column; none if it has fewer."""
    h = F.col(words)
    shingle = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)])
    return F.when(F.size(h) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), shingle)).otherwise(F.array().cast("array<long>"))


def block_of(n_shingles: int) -> int:
    """Shingles of a block of the windows for a template."""
    b = 1
    while (WINDOW - 1) * b + 1 < n_shingles:
        b *= 2
    return b


def _bands(shingles: str) -> str:
    """SQL: for each band, the shingle of the least hash and that hash."""
    return f"transform(sequence(1, {BANDS}), j -> array_min(transform({shingles}, x -> named_struct('h', xxhash64(x, j), 'x', x))))"


@lru_cache(maxsize=1)
def _library(spark: SparkSession) -> list[dict]:
    """The templates with their shingles and bands, computed by the plan's own expressions."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(TEMPLATES)]
    table = spark.range(1).select(F.inline(F.array(*rows))).withColumn("words", _tokens(F.col("text")))
    table = table.withColumn("shingles", F.array_distinct(_shingles("words"))).withColumn("bands", F.expr(_bands("shingles")))
    found = [r.asDict() | {"block": block_of(len(r.shingles)), "need": ceil(CONTAINED * len(r.shingles) - 1e-9)} for r in table.orderBy("template").collect()]
    for t, (differs, inside) in zip(found, near_templates([(t["license"], t["shingles"]) for t in found]), strict=True):
        t["differs"], t["inside"] = differs, inside
    return found


def near_templates(templates: list[tuple[str, list]]) -> list[tuple[list[list], list[int]]]:
    """For each template, of the templates of other licenses whose text holds enough of its shingles to be taken for it:
    the shingles that each of them lacks, and the numbers of those that lack none."""
    out = []
    for name, own in templates:
        need = ceil(CONTAINED * len(own) - 1e-9)
        near = [(u, [x for x in own if x not in set(other)]) for u, (license, other) in enumerate(templates) if license != name and len(set(own) & set(other)) >= need]
        differs = {tuple(d): d for _, d in near if d}
        out.append((list(differs.values()), [u for u, d in near if not d]))
    return out


def _needed(library: list[dict]) -> list[str]:
    """Words of which every text that holds enough of a template holds one.

    Of each template, the longest words are taken until the shingles without them
    are too few for CONTAINED.
    """
    taken: set[str] = set()
    for t in sorted(library, key=lambda t: len(t["words"])):
        words = t["words"]
        runs = {tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}
        order = sorted(set(words), key=lambda w: (-len(w), w))
        while sum(not taken & set(r) for r in runs) >= t["need"]:
            taken.add(next(w for w in order if w not in taken))
    return sorted(taken)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, licenses, n_notices) for every row: the licenses whose notices the text holds, joined by commas in order.

    Overlapping windows of the text look their MinHash bands up in the index of the
    templates' bands; a template that a window retrieves is verified by exact
    containment of CONTAINED of its shingles.  A band of a window can only be in the
    index if the shingle that gives its least hash gives a template's too, so only
    windows around such shingles have bands computed, and only texts with a word that
    each template's share needs have windows; both lose nothing.

    Versions and relatives are told apart by what they do not share: where another license's
    text would hold enough of a template, its window must also hold more than half of the shingles that
    the other lacks; a template that another one's text holds whole counts only where
    that one is not found.  What follows an SPDX tag is read by the grammar of its
    expressions: each license of it counts, exceptions do not, ``+`` means or later.

    The count is that of different templates.  A null or empty text has no license; repeated rows, null ids
    and other columns change nothing; an empty table gives no rows.
    """
    check_columns(docs, id_col, text_col)
    library = _library(docs.sparkSession)
    indexed = sorted({b["x"] for t in library for b in t["bands"]})
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("whole")).withColumn("text", F.lower("whole"))
    worth = reduce(or_, [F.col("text").contains(w) for w in _needed(library)])
    rows = rows.select("id", F.when(worth, F.col("whole")).alias("whole"), F.when(worth, _tokens(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("words"))
    rows = rows.select("id", "whole", _shingles("words").alias("sh"))
    hits = F.expr(f"filter(transform(sh, (s, i) -> CASE WHEN s IN ({_longs(indexed)}) THEN i END), i -> i IS NOT NULL)")
    rows = rows.withColumn("hits", F.when(F.size("sh") > 0, hits).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("sh", F.when(F.size("hits") > 0, F.col("sh")).otherwise(F.array().cast("array<long>")))
    found = ", ".join(_found(b, [t for t in library if t["block"] == b]) for b in sorted({t["block"] for t in library}))
    rows = rows.withColumn("found", F.when(F.size("hits") > 0, F.expr(f"array_distinct(concat({found}))")).otherwise(F.array().cast("array<int>")))
    inside = {t["template"]: t["inside"] for t in library if t["inside"]}
    if inside:
        held = " ".join(f"WHEN {t} THEN arrays_overlap(found, array({', '.join(map(str, u))}))" for t, u in inside.items())
        rows = rows.withColumn("found", F.expr(f"filter(found, t -> NOT CASE t {held} ELSE false END)"))
    names = F.expr("array(" + ", ".join(f"'{t['license']}'" for t in library) + ")")
    noticed = F.transform(F.filter("found", lambda i: i != SPDX), lambda i: F.get(names, i))
    tagged = F.when(F.array_contains("found", SPDX), expression_licenses(F.col("whole"))).otherwise(F.array().cast("array<string>"))
    licenses = F.array_join(F.array_sort(F.array_distinct(F.concat(noticed, tagged))), ",")
    return rows.select(F.col("id").alias(id_col), licenses.alias("licenses"), F.size("found").cast("long").alias("n_notices"))


def expression_licenses(text: Column) -> Column:
    """The licenses of all SPDX expressions of a text, known ones by their own spelling."""
    known = {name.lower(): name for name, _ in TEMPLATES if name != "SPDX"} | {name.lower(): name for name in IDENTIFIERS}
    spelled = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(1)), lambda e: F.split(F.regexp_replace(e, EXCEPTION, ""), r"[() \t]+")))
    named = F.transform(F.filter(parts, lambda x: ~x.isin("", "AND", "OR")), lambda x: F.regexp_replace(x, r"\+$", "-or-later"))
    return F.transform(named, lambda x: F.coalesce(F.element_at(spelled, F.lower(x)), x))


def _longs(values: list[int]) -> str:
    return ", ".join(f"{v}L" for v in values)


def _found(block: int, templates: list[dict]) -> str:
    """SQL: numbers of the templates of one block size that a text's windows retrieve and hold."""
    index = ", ".join(f"named_struct('j', {j}, 'h', {b['h']}L, 't', {t})" for t, one in enumerate(templates) for j, b in enumerate(one["bands"]))
    tables = ", ".join(f"array({_longs(t['shingles'])})" for t in templates)
    need, numbers = (", ".join(str(t[k]) for t in templates) for k in ("need", "template"))
    starts = f"array_distinct(flatten(transform(hits, p -> transform(sequence(0, {WINDOW - 1}), k -> greatest(CAST(p div {block} AS INT) - k, 0) * {block}))))"
    windows = f"transform({starts}, s -> array_distinct(slice(sh, s + 1, {WINDOW * block})))"
    with_bands = f"transform({windows}, w -> named_struct('w', w, 'b', {_bands('w')}))"
    retrieved = f"array_distinct(transform(filter(array({index}), e -> get(x.b, e.j).h = e.h), e -> e.t))"
    differs = ", ".join("CAST(array(" + ", ".join(f"array({_longs(d)})" for d in t["differs"]) + ") AS ARRAY<ARRAY<BIGINT>>)" for t in templates)
    apart = f"forall(get(array({differs}), t), d -> 2 * size(array_intersect(x.w, d)) > size(d))" if any(t["differs"] for t in templates) else "true"
    held = f"filter({retrieved}, t -> size(array_intersect(x.w, get(array({tables}), t))) >= get(array({need}), t) AND {apart})"
    return f"transform(flatten(transform({with_bands}, x -> {held})), t -> get(array({numbers}), t))"


def oracle() -> str:
    """The same licenses in DuckDB: every block's window against every template, by containment alone."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    runs = f"list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))"
    known = {name.lower(): name for name, _ in TEMPLATES if name != "SPDX"} | {name.lower(): name for name in IDENTIFIERS}
    spelled = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in known.items())
    return f"""
WITH t(template, license, text) AS (VALUES {rows}),
tw AS (SELECT template, license, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM t),
ts AS (SELECT DISTINCT template, license, unnest({runs}) AS shingle FROM tw),
tn AS (SELECT template, count(*) AS m, ceil({CONTAINED} * count(*) - 1e-9) AS need, (2 ** greatest(0, ceil(log2((count(*) - 1) / {WINDOW - 1}))))::BIGINT AS block FROM ts GROUP BY ALL),
near AS (SELECT a.template, b.template AS other FROM ts a JOIN ts b ON a.shingle = b.shingle AND a.license <> b.license JOIN tn ON tn.template = a.template GROUP BY ALL HAVING count(*) >= any_value(need)),
differs AS (SELECT near.template, other, a.shingle FROM near JOIN ts a ON a.template = near.template ANTI JOIN ts b ON b.template = near.other AND b.shingle = a.shingle),
least AS (SELECT template, other, count(*) AS n FROM differs GROUP BY ALL),
inside AS (SELECT * FROM near ANTI JOIN differs USING (template, other)),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM documents),
ds AS (SELECT doc_id, unnest({runs}) AS shingle, unnest(range(greatest(len(w) - {WIDTH - 1}, 0))) AS place FROM dw),
hit AS (SELECT doc_id, ts.template, license, shingle, place // block AS at_block, need FROM ds JOIN ts USING (shingle) JOIN tn ON tn.template = ts.template),
spread AS (SELECT DISTINCT doc_id, template, license, shingle, need, at_block - k AS start FROM hit, (SELECT unnest(range({WINDOW})) AS k) WHERE at_block - k >= 0),
held AS (SELECT doc_id, template, license, start FROM spread GROUP BY ALL HAVING count(*) >= any_value(need)),
told AS (SELECT h.doc_id, h.template, h.start, l.other FROM held h JOIN least l USING (template) JOIN differs d ON d.template = l.template AND d.other = l.other
  JOIN spread s ON s.doc_id = h.doc_id AND s.template = h.template AND s.start = h.start AND s.shingle = d.shingle GROUP BY ALL HAVING 2 * count(*) > any_value(l.n)),
apart AS (SELECT DISTINCT h.doc_id, h.template, h.license FROM held h WHERE (SELECT count(*) FROM least l WHERE l.template = h.template)
  = (SELECT count(*) FROM told t WHERE t.doc_id = h.doc_id AND t.template = h.template AND t.start = h.start)),
found AS (SELECT * FROM apart a WHERE NOT EXISTS (SELECT 1 FROM inside i JOIN apart b ON b.template = i.other WHERE i.template = a.template AND b.doc_id = a.doc_id)),
e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EXPRESSION}', 1)) AS e FROM documents SEMI JOIN (SELECT doc_id FROM found WHERE template = {SPDX}) USING (doc_id)),
x AS (SELECT doc_id, regexp_replace(unnest(list_filter(regexp_split_to_array(regexp_replace(e, '{EXCEPTION}', '', 'g'), '[() \\t]+'), lambda x: x NOT IN ('', 'AND', 'OR'))), '\\+$', '-or-later') AS x FROM e),
known(low, name) AS (VALUES {spelled}),
all_names AS (SELECT doc_id, license FROM found WHERE template <> {SPDX} UNION ALL SELECT doc_id, coalesce(name, x) FROM x LEFT JOIN known ON low = lower(x)),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM all_names GROUP BY ALL), c AS (SELECT doc_id, count(DISTINCT template) AS n FROM found GROUP BY ALL)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(c.n, 0)::BIGINT AS n_notices FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
