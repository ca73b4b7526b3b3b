"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences at end marks and, in a second reading, at line ends as well (notices wrap over lines or end without a mark). Sentences
are normalised to lower-case ASCII words and looked up among known licence sentences: those of public licence texts, and the
notices that the templates make of licence names. The identifiers found, in text order, are matched against rules, each an ordered
list of identifiers with anything between. A rule's finding is dropped where a finding that says more (``BEATEN_BY``) is made in the same
text. Everything happens within a row.

Only texts with one of HINTS, with anything but letters and digits between its words, can hold a known sentence, as every known sentence has
one; the others are not cut, and of a text's sentences only those with a hint are looked up.

Defined cases: null or empty texts have no findings; rows that repeat are scanned each; an empty table gives an empty
result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Each known sentence, normalised, has one of these.
HINTS = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "contributors", "released under", "distributed under", "misrepresented", "held liable", "advertising materials", "waived all", "available under the terms", "copy of the mpl")

# Public licences by identifier, with the names that notices give them.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License"],
    "0BSD": ["BSD Zero Clause License", "0BSD"],
    "ISC": ["ISC License", "ISC"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License"],
}
# The Creative Commons family.
_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_VERSIONS = {"2.0": "Generic", "3.0": "Unported", "4.0": "International"}
NAMES |= {
    f"CC-{code}-{version}": [f"CC {code} {version}", f"Creative Commons {words} {version} {kind} License", f"Creative Commons {words} {version} License"]
    for code, words in _PARTS.items() for version, kind in _VERSIONS.items()
}
# Notices that name a licence.
TEMPLATES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "Dual licensed under the {}.", "License: {}",
    "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the {}.", "This software is licensed under the {}.",
    "This program is licensed under the {}.", "This code is licensed under the {}.", "This file is licensed under the {}.", "This library is licensed under the {}.", "This package is licensed under the {}.",
    "This project is released under the {}.", "This software is released under the {}.", "This software is distributed under the {}.", "This document is licensed under the {}.",
]
# Sentences of public licence texts, by identifier; none has an end mark within, but for those with a colon or
# a semicolon at a line's end.
SENTENCES = [
    ("mit-name", "The MIT License (MIT)"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is-mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("apache-2-notice", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-2-comply", "you may not use this file except in compliance with the License."),
    ("apache-2-copy", "You may obtain a copy of the License at"),
    ("apache-2-as-is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-2-limits", "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"),
    ("gpl-2-later", "either version 2 of the License, or (at your option) any later version."),
    ("gpl-2-only", "version 2 of the License."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl-preamble", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("gpl-2-preamble", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("lgpl-3-notice", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"),
    ("lgpl-2-1-later", "either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("agpl-3-notice", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-names", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-as-is", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-as-is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("mpl-2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("mpl-2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-1-notice", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("epl-1-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-liable", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib-origin", "The origin of this software must not be misrepresented;"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("bsl-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("bsl-notice", "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain."),
    ("cc0-text", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("wtfpl-text", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("artistic-text", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("ofl-notice", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
]
# Licence, and the sentence identifiers that must follow each other for it; each name has a rule besides.
RULES = [
    ("AGPL-3.0-or-later", ["agpl-3-notice"]),
    ("Apache-2.0", ["apache-2-notice", "apache-2-comply"]),
    ("Apache-2.0", ["apache-2-notice", "apache-2-as-is"]),
    ("Apache-2.0", ["apache-2-comply", "apache-2-copy", "apache-2-as-is", "apache-2-limits"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("0BSD", ["0bsd-grant"]),
    ("CC0-1.0", ["cc0-text"]),
    ("EPL-1.0", ["epl-1-notice"]),
    ("EPL-2.0", ["epl-2-notice"]),
    ("GPL-2.0", ["gpl-terms", "gpl-2-only"]),
    ("GPL-2.0", ["gpl-2-preamble", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl-terms", "gpl-2-later"]),
    ("GPL-3.0", ["gpl-preamble", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-3-notice"]),
    ("ISC", ["isc-grant"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "lgpl-2-1-later"]),
    ("LGPL-3.0-or-later", ["lgpl-3-notice"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("BSL-1.0", ["bsl-grant", "bsl-notice"]),
    ("OFL-1.1", ["ofl-notice"]),
    ("Unlicense", ["unlicense-text"]),
    ("WTFPL", ["wtfpl-text"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant", "zlib-origin", "zlib-altered"]),
]
BEATEN_BY = {"BSD-2-Clause": "BSD-3-Clause", "BSD-3-Clause": "BSD-4-Clause", "GPL-2.0": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-or-later"}


def _name_id(licence: str) -> str:
    return licence.lower().replace(".", "-") + "-name"


RULES += [(licence, [_name_id(licence)]) for licence in NAMES]


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> list[tuple[str, str]]:
    """(normalised sentence, identifier): of names by template, and as headings where they say that they are licences, of identifier tags, and of
    licence texts."""
    out = {}
    for licence, names in NAMES.items():
        tags = [f"SPDX-License-Identifier: {licence}{more}" for more in ("", "-only", "-or-later", "+")]
        for sentence in [*(t.format(n) for n in names for t in TEMPLATES), *(n for n in names if "Licen" in n), *tags]:
            out.setdefault(normal(sentence), _name_id(licence))
    return list((out | {normal(sentence): name for name, sentence in SENTENCES}).items())


def _found(text: str, by_line: bool) -> str:
    """SQL: identifiers of the known sentences of the text column, in order."""
    known = known_sentences()
    keys = "array(" + ", ".join(f"'{k}'" for k, _ in known) + ")"
    names = "array(" + ", ".join(f"'{n}'" for _, n in known) + ")"
    flat = rf"{text}" if by_line else rf"regexp_replace({text}, '[\\s]+', ' ')"
    parts = rf"split(regexp_replace({flat}, '([.!?;:])\\s+', '$1\n'), '\n')"
    if by_line:  # identifier tags have a colon within
        parts = rf"split(regexp_replace({flat}, '(?<!dentifier)([.!?;:])\\s+', '$1\n'), '\n')"
    words = rf"filter(transform({parts}, x -> trim(regexp_replace(lower(x), '[^a-z0-9]+', ' '))), x -> x rlike '{'|'.join(HINTS)}')"
    return f"filter(transform({words}, x -> get({names}, cast(array_position({keys}, x) as int) - 1)), x -> x is not null)"


def _rules(ids: str) -> list[str]:
    """SQL: the licence of each rule that matches the comma-led and comma-ended identifier string, or null."""
    return [f"if({ids} rlike ',{',(?:[^,]+,)*'.join(need)},', '{licence}', null)" for licence, need in RULES]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_sentences (known ones), sentence_ids and licenses, both comma-joined, the latter sorted; they replace columns of these names."""
    new = ("n_sentences", "sentence_ids", "licenses")
    kept = [c for c in docs.columns if c not in new]
    hint = "|".join(h.replace(" ", "[^a-z0-9]+") for h in HINTS)
    # whatever docs' columns are called, the steps' own names do not meet theirs
    own = docs.select(F.struct(*kept).alias("row"), F.col(text).cast("string").alias("text"))
    own = own.select("row", "text", F.coalesce(F.col("text").rlike(f"(?i){hint}"), F.lit(False)).alias("hint"))
    own = own.select("row", *[F.expr(f"if(hint, {_found('text', lines)}, cast(array() as array<string>))").alias(n) for n, lines in (("a", False), ("b", True))])
    # the reading that recognises more sentences gives the sequence; the rules hold for either
    own = own.select("row", F.expr("if(size(a) > size(b), a, b)").alias("ids"), *[F.concat(F.lit(","), F.array_join(c, ","), F.lit(",")).alias(f"s{c}") for c in "ab"])
    own = own.withColumn("found", F.expr(f"if(size(ids) = 0, cast(array() as array<string>), array_sort(array_distinct(array_compact(array({', '.join(_rules('sa') + _rules('sb'))})))))"))
    beaten = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in BEATEN_BY.items()) + ")"
    final = F.expr(f"array_join(filter(found, x -> not coalesce(array_contains(found, element_at({beaten}, x)), false)), ',')")
    return own.select(*[F.col("row")[c].alias(c) for c in kept], F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), final.alias("licenses"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def oracle() -> str:
    """DuckDB SQL for op4: sentences as rows, joined with the known ones, and rules as patterns over the grouped identifiers."""
    known = ", ".join(f"('{k}', '{n}')" for k, n in known_sentences())
    rules = ", ".join(f"('{licence}', ',{',([^,]+,)*'.join(need)},')" for licence, need in RULES)
    beaten = ", ".join(f"('{k}', '{v}')" for k, v in BEATEN_BY.items())
    return rf"""
WITH known(sentence, name) AS (VALUES {known}), rules(license, pattern) AS (VALUES {rules}), beaten(low, high) AS (VALUES {beaten}),
readings AS (
  SELECT doc_id, 1 AS reading, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?;:])\s+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents
  UNION ALL
  SELECT doc_id, 2, string_split(replace(regexp_replace(replace(text, 'dentifier: ', 'dentifier' || chr(1)), '([.!?;:])\s+', '\1' || chr(10), 'g'), chr(1), ': '), chr(10)) FROM documents
), lines AS (SELECT doc_id, reading, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM readings
), found AS (
  SELECT l.doc_id, l.reading, string_agg(k.name, ',' ORDER BY l.n) AS ids, count(*) AS c
  FROM lines l JOIN known k ON trim(regexp_replace(lower(l.line), '[^a-z0-9]+', ' ', 'g')) = k.sentence GROUP BY 1, 2
), best AS (SELECT doc_id, arg_max(ids, c * 10 + reading) AS ids, max(c) AS c FROM found GROUP BY 1
), hits AS (SELECT DISTINCT f.doc_id, r.license FROM found f JOIN rules r ON regexp_matches(',' || f.ids || ',', r.pattern)
), kept AS (
  SELECT h.doc_id, string_agg(h.license, ',' ORDER BY h.license) AS licenses FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM beaten b JOIN hits o ON o.license = b.high WHERE b.low = h.license AND o.doc_id = h.doc_id) GROUP BY 1
)
SELECT d.doc_id, coalesce(b.c, 0) AS n_sentences, coalesce(b.ids, '') AS sentence_ids, coalesce(k.licenses, '') AS licenses
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


OP4_SQL = oracle()
