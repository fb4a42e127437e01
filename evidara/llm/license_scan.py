"""Licence recognition by sentence rules, in DataFrame functions.

Texts are normalised and cut into pieces where a line or a sentence ends. A known licence sentence
is a run of whole pieces that has its words: wrapped lines, blank lines and marks inside a sentence do
not hide it. Where runs overlap the first counts, and of those that start together the longest. The
identifiers found in a document, in order, are matched against ordered rules: the first rule whose identifiers occur one right after another is the document's licence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.session import plain, table

#: Identifier and wording of the known sentences (they are normalised like the texts).
SENTENCES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-you": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "You may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-ref": "Released under the MIT License.",
    "mit-ref2": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-title2": "The MIT License (MIT)",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ccbync4-ref": "Licensed under CC BY-NC 4.0.",
    "ccby4-ref": "Licensed under CC BY 4.0.",
    "ccbysa4-ref": "Licensed under CC BY-SA 4.0.",
    "cc0-ref": "Licensed under CC0 1.0.",
    "reserved": "All rights reserved.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-title": "ISC License",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd3-ref": "Licensed under the BSD 3-Clause License.",
    "bsd2-ref": "Licensed under the BSD 2-Clause License.",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost-grant": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "cc0-dedication": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
}
#: Rule, licence, identifiers in order; rules are tried from the first on.
RULES = (
    ("apache-header", "Apache-2.0", ("apache-you", "apache-comply", "apache-obtain")),
    ("gpl3-header", "GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("gpl2-header", "GPL-2.0-or-later", ("gpl2-free", "gpl-warranty")),
    ("lgpl21-header", "LGPL-2.1-or-later", ("lgpl21-free", "lgpl-warranty")),
    ("lgpl3-header", "LGPL-3.0-or-later", ("lgpl3-free", "lgpl-warranty")),
    ("agpl3-header", "AGPL-3.0-or-later", ("agpl3-free", "gpl-warranty")),
    ("mpl2-header", "MPL-2.0", ("mpl2-header", "mpl2-copy")),
    ("bsd3-full", "BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd2-full", "BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("bsd3-text", "BSD-3-Clause", ("bsd-redist", "bsd-endorse")),
    ("mit-full", "MIT", ("mit-grant", "mit-notice")),
    ("isc-full", "ISC", ("isc-title", "isc-grant")),
    ("mit-text", "MIT", ("mit-title", "mit-notice")),
    ("mit-text2", "MIT", ("mit-title2", "mit-notice")),
    ("apache-ref", "Apache-2.0", ("apache-ref",)),
    ("apache-ref2", "Apache-2.0", ("apache-you",)),
    ("mit-ref", "MIT", ("mit-ref",)),
    ("mit-ref2", "MIT", ("mit-ref2",)),
    ("gpl3-ref", "GPL-3.0-only", ("gpl3-ref",)),
    ("gpl3-free", "GPL-3.0-or-later", ("gpl-free",)),
    ("bsd-ref", "BSD-2-Clause", ("bsd-redist",)),
    ("ccbync4-ref", "CC-BY-NC-4.0", ("ccbync4-ref",)),
    ("ccby4-ref", "CC-BY-4.0", ("ccby4-ref",)),
    ("ccbysa4-ref", "CC-BY-SA-4.0", ("ccbysa4-ref",)),
    ("cc0-ref", "CC0-1.0", ("cc0-ref",)),
    ("gpl2-free", "GPL-2.0-or-later", ("gpl2-free",)),
    ("lgpl21-free", "LGPL-2.1-or-later", ("lgpl21-free",)),
    ("lgpl3-free", "LGPL-3.0-or-later", ("lgpl3-free",)),
    ("agpl3-free", "AGPL-3.0-or-later", ("agpl3-free",)),
    ("mpl2-ref", "MPL-2.0", ("mpl2-header",)),
    ("mit-grant", "MIT", ("mit-grant",)),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("bsd3-ref", "BSD-3-Clause", ("bsd3-ref",)),
    ("bsd2-ref", "BSD-2-Clause", ("bsd2-ref",)),
    ("boost", "BSL-1.0", ("boost-grant",)),
    ("zlib", "Zlib", ("zlib-grant",)),
    ("unlicense", "Unlicense", ("unlicense",)),
    ("cc0-text", "CC0-1.0", ("cc0-dedication",)),
    ("ccby4-work", "CC-BY-4.0", ("ccby4-work",)),
    ("ccbysa4-work", "CC-BY-SA-4.0", ("ccbysa4-work",)),
    ("ccbync4-work", "CC-BY-NC-4.0", ("ccbync4-work",)),
    ("epl2", "EPL-2.0", ("epl2-header",)),
    ("reserved", "proprietary", ("reserved",)),
)
#: Every known sentence holds one of these words, so texts without any are not cut up.
TRIGGERS = ("licen", "permission", "redistribut", "distributed", "reserved", "mpl", "unencumbered", "dedicated")


WORD = re.compile("[a-z0-9]+")


def pieces(text: Column) -> Column:
    """Lower-case words with a space between them, and one line break where a line or a sentence ends, at the start and at the end."""
    cut = F.regexp_replace(F.lower(text), r"(?<=[.!?;:])[ \t]+", "\n")
    words = F.regexp_replace(cut, r"[^a-z0-9\n]+", " ")
    return F.regexp_replace(F.concat(F.lit("\n"), words, F.lit("\n")), r" ?\n[ \n]*", "\n")


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_license_sentences, sentence_ids, rule, license) of every row.

    Null and empty texts, and texts without a known sentence, have 0, '', null and null. A
    sentence that occurs often is listed each time. Rows that repeat a doc_id must repeat its
    text; each is returned. An empty table gives an empty table; other columns are ignored."""
    d = plain(docs, "doc_id", "text")
    may = F.lit(False)
    for t in TRIGGERS:
        may = may | F.lower("text").contains(t)
    sids = {" ".join(WORD.findall(s.lower())): k for k, s in SENTENCES.items()}
    one_of = "|".join(n.replace(" ", r"[ \n]") for n in sorted(sids, key=len, reverse=True))  # the longest that fits counts
    names = F.create_map(*(F.lit(x) for pair in sids.items() for x in pair))  # the table of SENTENCES
    runs = F.regexp_extract_all(pieces(F.col("text")), F.lit(rf"(?<=\n)(?:{one_of})(?=\n)"), F.lit(0))
    d = d.select("doc_id", F.when(may, F.transform(runs, lambda r: names[F.translate(r, "\n", " ")])).alias("sids"))
    d = d.select("doc_id", F.coalesce(F.size("sids"), F.lit(0)).alias("n"), F.coalesce(F.array_join("sids", ","), F.lit("")).alias("ids"))
    listed = F.concat(F.lit(","), F.col("ids"), F.lit(","))
    hits = [F.when(listed.contains(",".join(["", *ids, ""])), F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"))) for r, lic, ids in RULES]
    d = d.select("doc_id", "n", "ids", F.coalesce(*hits).alias("b"))
    return d.select("doc_id", F.greatest("n", F.lit(0)).cast("long").alias("n_license_sentences"), F.col("ids").alias("sentence_ids"), "b.rule", "b.license")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
OP1_SQL = f"""
WITH known(sid, norm) AS (SELECT sid, {_NORM.format("s")} FROM (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in SENTENCES.items())}) t(sid, s)),
rules(rank, rule, license, needs) AS (VALUES {", ".join(f"({i}, {_sql_text(r)}, {_sql_text(lic)}, ',{','.join(ids)},')" for i, (r, lic, ids) in enumerate(RULES))}),
parts AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS s FROM
  (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS ps FROM documents WHERE text IS NOT NULL)),
found AS (SELECT doc_id, i, sid FROM (SELECT doc_id, i, {_NORM.format("s")} AS norm FROM parts) JOIN known USING (norm)),
per AS (SELECT doc_id, count(*) AS n, string_agg(sid, ',' ORDER BY i, sid) AS ids FROM found GROUP BY doc_id),
best AS (SELECT doc_id, min(rank) AS rank FROM per JOIN rules ON contains(',' || ids || ',', needs) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_license_sentences, coalesce(ids, '') AS sentence_ids, rule, license
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN rules USING (rank)
"""
