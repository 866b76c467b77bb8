"""Licence scans by sentence rules.

A text is freed of comment marks at the start of lines and cut into sentences, in
two ways: lines are joined where the next one starts in lower case, or wherever a
line ends without a stop; the way that finds more known sentences counts, the first
if both find as many. Each sentence is normalised (lower case, runs of other
characters than a-z and 0-9 as one blank, licence as license) and looked up among
known licence sentences. The organisation in "Neither the name of ... nor the names
of its contributors" may be any. The stops of "SPDX-License-Identifier: MIT", "v. 2.0"
and "Acme Inc. nor" end no sentence, and a line with an SPDX identifier is joined with no other.

The identifiers found, in text order, are matched against ordered rules: a rule holds
if its identifiers occur in this order, other known sentences in between allowed. A
rule that another held rule includes is not reported. An SPDX expression gives
``spdx-<id>`` for each licence of ``SPDX`` in it, whether joined by OR, AND or WITH, and
the licence ``<id>-named``; exceptions and other words in it give nothing.

Only DataFrame functions are used; the operator is narrow, without a shuffle.
Texts that hold none of ``KEYS`` cannot hold a known sentence (every sentence has
one of them; a test holds this) and are not cut.

Defined cases: null and empty texts, and texts without known sentences, get empty
results. A sentence that occurs twice is listed twice; a licence is listed once. Rows
are independent. Columns made on the way carry a ``_ls_`` prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences.
SENTENCES = {
    "mit-permission": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit-0-permission": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "isc-permission": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "0bsd-permission": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-warranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-permission": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
    "unlicense-permission": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "boost-permission": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ],
    "cc0-dedication": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "apache-licensed": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-warranty": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-warranty": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ],
    "gpl-free": ["This program is free software:", "This program is free software;"],
    "lgpl-free": ["This library is free software:", "This library is free software;"],
    "gpl3-terms": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "gpl3-only-terms": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    ],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "gpl2-only-terms": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "lgpl3-terms": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "agpl3-terms": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "gnu2-later": ["either version 2 of the License, or (at your option) any later version."],
    "gnu2.1-later": ["either version 2.1 of the License, or (at your option) any later version."],
    "gnu3-later": ["either version 3 of the License, or (at your option) any later version."],
    "gnu2-only": ["version 2 of the License.", "version 2 of the License only."],
    "gnu2.1-only": ["version 2.1 of the License.", "version 2.1 of the License only."],
    "gnu3-only": ["version 3 of the License.", "version 3 of the License only."],
    "mpl2-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "epl2-terms": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    ],
    "reserved": ["All rights reserved."],
}

# The usual ways to name a licence; each stands after each of LEADS.
NAMED = {
    "mit-statement": ["the MIT License", "the MIT license (MIT)", "MIT"],
    "apache-statement": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"],
    "bsd-2-statement": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "bsd-3-statement": ["the BSD 3-Clause License", "the New BSD License"],
    "isc-statement": ["the ISC License"],
    "zlib-statement": ["the zlib License"],
    "unlicense-statement": ["the Unlicense"],
    "boost-statement": ["the Boost Software License, Version 1.0"],
    "gpl2-statement": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2"],
    "gpl3-statement": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3"],
    "lgpl2.1-statement": ["the GNU Lesser General Public License, version 2.1"],
    "lgpl3-statement": ["the GNU Lesser General Public License, version 3"],
    "agpl3-statement": ["the GNU Affero General Public License, version 3"],
    "mpl2-statement": ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"],
    "epl2-statement": ["the Eclipse Public License 2.0"],
    "cc0-statement": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
    "cc-by-statement": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-statement": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nd-statement": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-statement": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-sa-statement": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd-statement": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
LEADS = ["Licensed under", "Released under", "Distributed under", "This project is licensed under", "This work is licensed under", "This software is licensed under"]

# Licences and the identifiers that make one up, in order; a licence may have several.
RULES = [
    ("mit", ["mit-permission", "mit-notice", "mit-warranty"]),
    ("mit-0", ["mit-0-permission", "mit-warranty"]),
    ("isc", ["isc-permission", "isc-warranty"]),
    ("0bsd", ["0bsd-permission", "isc-warranty"]),
    ("zlib", ["zlib-warranty", "zlib-liability", "zlib-permission"]),
    ("unlicense", ["unlicense-domain", "unlicense-permission"]),
    ("bsl-1.0", ["boost-permission"]),
    ("cc0-1.0", ["cc0-dedication"]),
    ("apache-2.0", ["apache-licensed", "apache-compliance", "apache-copy", "apache-warranty"]),
    ("bsd-2-clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("bsd-3-clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd-4-clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"]),
    ("gpl-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("gpl-3.0-only", ["gpl-free", "gpl3-only-terms"]),
    ("gpl-2.0-or-later", ["gpl-free", "gpl-terms", "gnu2-later"]),
    ("gpl-2.0-only", ["gpl-free", "gpl-terms", "gnu2-only"]),
    ("gpl-2.0-only", ["gpl-free", "gpl2-only-terms"]),
    ("gpl-3.0-or-later", ["gpl-free", "gpl-terms", "gnu3-later"]),
    ("gpl-3.0-only", ["gpl-free", "gpl-terms", "gnu3-only"]),
    ("lgpl-2.1-or-later", ["lgpl-free", "lgpl-terms", "gnu2.1-later"]),
    ("lgpl-2.1-only", ["lgpl-free", "lgpl-terms", "gnu2.1-only"]),
    ("lgpl-3.0-or-later", ["lgpl3-terms"]),
    ("lgpl-3.0-or-later", ["lgpl-free", "lgpl-terms", "gnu3-later"]),
    ("agpl-3.0-or-later", ["gpl-free", "agpl3-terms"]),
    ("mpl-2.0", ["mpl2-terms"]),
    ("epl-2.0", ["epl2-terms"]),
    ("mit-named", ["mit-statement"]),
    ("apache-2.0-named", ["apache-statement"]),
    ("bsd-2-clause-named", ["bsd-2-statement"]),
    ("bsd-3-clause-named", ["bsd-3-statement"]),
    ("isc-named", ["isc-statement"]),
    ("zlib-named", ["zlib-statement"]),
    ("unlicense-named", ["unlicense-statement"]),
    ("bsl-1.0-named", ["boost-statement"]),
    ("gpl-2.0-named", ["gpl2-statement"]),
    ("gpl-3.0-named", ["gpl3-statement"]),
    ("lgpl-2.1-named", ["lgpl2.1-statement"]),
    ("lgpl-3.0-named", ["lgpl3-statement"]),
    ("agpl-3.0-named", ["agpl3-statement"]),
    ("mpl-2.0-named", ["mpl2-statement"]),
    ("epl-2.0-named", ["epl2-statement"]),
    ("cc0-1.0-named", ["cc0-statement"]),
    ("cc-by-4.0-named", ["cc-by-statement"]),
    ("cc-by-sa-4.0-named", ["cc-by-sa-statement"]),
    ("cc-by-nd-4.0-named", ["cc-by-nd-statement"]),
    ("cc-by-nc-4.0-named", ["cc-by-nc-statement"]),
    ("cc-by-nc-sa-4.0-named", ["cc-by-nc-sa-statement"]),
    ("cc-by-nc-nd-4.0-named", ["cc-by-nc-nd-statement"]),
    ("all-rights-reserved", ["reserved"]),
]

# SPDX identifiers of licences; a trailing + stands for -or-later.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 "
    "CC0-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CDDL-1.0 CECILL-2.1 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only "
    "LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 Unlicense UPL-1.0 W3C WTFPL X11 Zlib"
).split()

#: Every known sentence holds one of these: single words, which no line break or other blank can part.
KEYS = "licen|copy|permission|distribut|released|warrant|reserved|software|advertising"

_MARKED = r"(^|\n)[ \t]*(?:[#*/;%!-]+|dnl\b|rem\b|REM\b|\.\.|')[ \t]*"
_WRAPPED = r"([^.!?:;\n])\n([a-z(])"
_ANY_WRAPPED = r"([^.!?:;\n])\n([^\n])"
_ENDED = r"([.!?:;])[ \t\r]+"
_INNER = r"(?i)(spdx-license-identifier(?=:)|\bv(?=\.[ \t\r\n]+[0-9])|\b(?:inc|ltd|corp|co)(?=\.[ \t\r\n]+nor\b))[:.][ \t\r\n]*"
_TAGGED = r"(?i)(?:^|\n)([^\n]*spdx-license-identifier [^\n]*)"  # from a line's start, so that long lines are searched once
_TAG = "spdx license identifier "
#: How a normalised sentence may go on behind the name of a licence.
_TAIL = " see (the )?((license|copying|notice)( (md|txt|rst))? ){1,2}(file )?for (more |further )?(details|information)$"
_HOLDER = "^neither the name of .* nor the names of its contributors "
_ANY_HOLDER = "neither the name of the copyright holder nor the names of its contributors "


def sentences() -> dict[str, list[str]]:
    """Identifier -> its sentences, those of NAMED written out."""
    return SENTENCES | {name: [f"{lead} {x}." for lead in LEADS for x in names] for name, names in NAMED.items()}


def normalised(text: str) -> str:
    """One sentence as it is looked up; for the operator's tables, on the driver."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().replace("licence", "license")


def known() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out = {}
    for name, texts in sentences().items():
        for text in texts:
            if out.setdefault(normalised(text), name) != name:
                raise ValueError(f"{name} and {out[normalised(text)]} share the sentence {text!r}")
    return out


def included(k: int) -> list[int]:
    """Places of the rules that include the identifiers of the k-th one in order."""

    def holds(small: list[str], large: list[str]) -> bool:
        rest = iter(large)
        return all(x in rest for x in small)

    return [j for j, (_, ids) in enumerate(RULES) if j != k and holds(RULES[k][1], ids)]


def pattern(rule: list[str]) -> str:
    """The LIKE pattern of a rule over identifiers, each between blanks."""
    return "%" + "%".join(f" {x} " for x in rule) + "%"


def _pieces(text: Column, wrapped: str) -> Column:
    bare = F.regexp_replace(text, _MARKED, "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, _INNER, "$1 "), _TAGGED, "\n\n$1\n")
    return F.split(F.regexp_replace(F.regexp_replace(bare, wrapped, "$1 $2"), _ENDED, "$1\n"), "\n")


def _ids_in(text: Column, wrapped: str) -> Column:
    """The identifiers of a text's known sentences, in order."""
    sentence_ids = known()
    table = F.create_map(*[F.lit(x) for pair in sentence_ids.items() for x in pair])
    ids = {x.lower().removesuffix("+"): f"spdx-{x.lower()}" for x in SPDX}
    ids |= {f"{x.lower()}+": f"spdx-{x.lower()}-or-later" for x in SPDX if not x.endswith(("-only", "-or-later"))}
    spdx = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    none = F.array().cast("array<string>")

    def found(piece: Column) -> Column:
        plain = F.replace(F.trim(F.regexp_replace(F.lower(piece), "[^a-z0-9]+", " ")), F.lit("licence"), F.lit("license"))
        plain = F.when(plain.startswith("neither the name of "), F.regexp_replace(plain, _HOLDER, _ANY_HOLDER)).otherwise(plain)
        plain = F.when(F.contains(plain, F.lit(" see ")), F.regexp_replace(plain, _TAIL, "")).otherwise(plain)
        words = F.split(F.regexp_replace(F.lower(piece), r"(?s)^.*spdx-license-identifier\s*", ""), r"[^a-z0-9.+-]+")
        named = F.array_compact(F.transform(words, lambda w: F.try_element_at(spdx, F.rtrim(w, F.lit(".")))))
        tagged = plain.startswith(_TAG) | F.contains(plain, F.lit(" " + _TAG))
        return F.when(plain.isin(*sentence_ids), F.array(F.try_element_at(table, plain))).when(tagged, named).otherwise(none)

    return F.flatten(F.transform(_pieces(text, wrapped), found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, sentence_ids and licenses (arrays, the first in text order, the second sorted)."""
    text = F.col(text_col)
    none = F.array().cast("array<string>")

    def found_in(wrapped: str) -> Column:
        return F.when(F.lower(text).rlike(KEYS), _ids_in(text, wrapped)).otherwise(none)

    both = docs.select(F.col(id_col), F.coalesce(found_in(_WRAPPED), none).alias("_ls_a"), F.coalesce(found_in(_ANY_WRAPPED), none).alias("_ls_b"))
    ids = F.when(F.size("_ls_b") > F.size("_ls_a"), F.col("_ls_b")).otherwise(F.col("_ls_a"))
    line = both.select(id_col, ids.alias("sentence_ids")).withColumn("_ls_line", F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")))
    held = [F.col("_ls_line").like(pattern(ids)) for _, ids in RULES]
    found = []
    for k, (name, _) in enumerate(RULES):
        alone = held[k]
        for j in included(k):
            alone = alone & ~held[j]
        found.append(F.when(alone, F.lit(name)))
    tagged = F.transform(F.filter("sentence_ids", lambda x: x.startswith("spdx-")), lambda x: F.concat(F.substring(x, 6, 100), F.lit("-named")))
    told = F.sort_array(F.array_distinct(F.concat(F.array_compact(F.array(*found)), tagged)))
    return line.select(id_col, "sentence_ids", F.when(F.size("sentence_ids") > 0, told).otherwise(none).alias("licenses"))
