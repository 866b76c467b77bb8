"""Licence scans against written-out expectations, and against the SQL."""

import re

import duckdb
import pytest

from framewright.llm import license_scan, license_sql

GPL_FREE = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Copyright 2021 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """3. Neither the name of Acme Widgets, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""


def commented(text, mark):
    return "\n".join(mark + x for x in text.split("\n"))


# Headers as they stand in files, with the licences that a reader finds in them.
HEADERS = [
    (MIT, ["mit"]),
    (commented(MIT, "# "), ["mit"]),
    (commented(MIT, " * "), ["mit"]),
    (MIT.replace("Permission is hereby", "And more. Permission is hereby"), ["mit"]),
    (APACHE, ["apache-2.0"]),
    (commented(APACHE, "// "), ["apache-2.0"]),
    (commented(APACHE, "-- "), ["apache-2.0"]),
    (APACHE.split("Unless")[0], []),
    (BSD, ["bsd-2-clause"]),
    (BSD3, ["bsd-3-clause"]),
    (commented(BSD3, " * "), ["bsd-3-clause"]),
    (BSD3.replace("Acme Widgets, Inc.", "the University"), ["bsd-3-clause"]),
    (ISC, ["isc"]),
    (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), ["0bsd"]),
    (ZLIB, ["zlib"]),
    (GPL_FREE, ["gpl-3.0-or-later"]),
    (commented(GPL_FREE, "# "), ["gpl-3.0-or-later"]),
    (GPL_FREE.replace("either version 3 of the License, or\n(at your option) any later version", "version 3 of the License"), ["gpl-3.0-only"]),
    (GPL2, ["gpl-2.0-or-later"]),
    (GPL2.replace("either version 2 of the License, or (at your option) any later version", "version 2 of the License"), ["gpl-2.0-only"]),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", ["gpl-2.0-only"]),
    (GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of"), ["lgpl-2.1-or-later"]),
    (GPL_FREE.replace("GNU General", "GNU Lesser General"), ["lgpl-3.0-or-later"]),
    (GPL_FREE.replace("GNU General", "GNU Affero General"), ["agpl-3.0-or-later"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", ["mpl-2.0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", []),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n\nSPDX-License-Identifier: EPL-2.0", ["epl-2.0", "epl-2.0-named"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", ["unlicense"]),
    ("// SPDX-License-Identifier: MIT\nint main;", ["mit-named"]),
    ("/* SPDX-License-Identifier: GPL-2.0-only */\n#include <x.h>", ["gpl-2.0-only-named"]),
    ("# SPDX-License-Identifier: GPL-2.0+\n", ["gpl-2.0-or-later-named"]),
    ("// SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) OR BSD-3-Clause", ["bsd-3-clause-named", "gpl-2.0-named"]),
    ("<!-- SPDX-License-Identifier: Apache-2.0 OR MIT. -->", ["apache-2.0-named", "mit-named"]),
    ("SPDX-License-Identifier: LicenseRef-Own", []),
    ("-- spdx-license-identifier: isc\nAll rights reserved.", ["all-rights-reserved", "isc-named"]),
    ("Released under the MIT License.", ["mit-named"]),
    ("This work is licensed under\nCC BY-NC-SA 4.0.", ["cc-by-nc-sa-4.0-named"]),
    ("This project is licenced under the Apache License, Version 2.0.", ["apache-2.0-named"]),
    ("All rights\nreserved.", ["all-rights-reserved"]),
    ("Licensed under the Boost Software License, Version 1.0.", ["bsl-1.0-named"]),
    ("Licensed under CC0 1.0. Distributed under the GNU GPL v3.", ["cc0-1.0-named", "gpl-3.0-named"]),
    ("the MIT License is short, and the licence of this text is not stated.", []),
    ("We were licensed under other terms; permission, copy and software are words.", []),
    (MIT + "\n\n" + APACHE, ["apache-2.0", "mit"]),
]


def scanned(spark, texts):
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["sentence_ids"], r["licenses"]) for r in sorted(license_scan.scan(made).collect(), key=lambda r: r["doc_id"])]


def by_sql(texts):
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    rows = duck.execute(f"select sentence_ids, licenses from ({license_sql.duckdb_sql()}) order by doc_id").fetchall()
    return [tuple([y for y in x.split(",") if y] for x in r) for r in rows]


def test_headers(spark):
    got = [x for _, x in scanned(spark, [t for t, _ in HEADERS])]
    assert got == [want for _, want in HEADERS]


def test_headers_by_sql():
    assert [x for _, x in by_sql([t for t, _ in HEADERS])] == [want for _, want in HEADERS]


def test_odd_texts_like_the_sql(spark, odd):
    texts = [r["text"] for r in odd.collect()] + [t[k:] for t, _ in HEADERS[:6] for k in (1, 7, 40)]
    assert scanned(spark, texts) == by_sql(texts)


def test_licences_of_odd_rows(spark, odd, nothing):
    rows = {r["doc_id"]: r for r in license_scan.scan(odd).collect()}
    assert rows[-14]["licenses"] == ["all-rights-reserved", "mit-named"] and rows[1]["licenses"] == [] and rows[4]["sentence_ids"] == []
    assert license_scan.scan(nothing).count() == 0


def test_every_known_sentence_has_a_key():
    assert all(re.search(license_scan.KEYS, x) for x in license_scan.known())


def test_every_sentence_wrapped_at_every_blank(spark):
    """Each sentence gives its own identifier only, on one line, and broken at any blank, with and without comment marks."""
    texts, want = [], []
    for name, sentences in license_scan.sentences().items():
        for text in sentences[:3]:
            words = text.split(" ")
            cuts = [0, *range(1, len(words), 1 if len(words) < 12 else 5)]
            for mark in ("", "# ", " * "):
                for k in cuts:
                    first = " ".join(words[:k])
                    if not (first and first[-1] in ".!?:;"):  # a stop there ends the sentence
                        texts.append(mark + (first + "\n" + mark if k else "") + " ".join(words[k:]))
                        want.append([name])
    got = [ids for ids, _ in scanned(spark, texts)]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def test_no_two_identifiers_share_a_sentence(monkeypatch):
    monkeypatch.setitem(license_scan.SENTENCES, "again", ["released under the MIT license"])
    with pytest.raises(ValueError, match="share the sentence"):
        license_scan.known()


def test_rules_name_known_identifiers():
    names = set(license_scan.sentences())
    assert all(set(ids) <= names for _, ids in license_scan.RULES) and len(license_scan.RULES) >= 45


TAILED = [
    "This project is licensed under the MIT License - see the LICENSE file for details.",
    "This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details",
    "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details.",
    "Released under the MIT License, see LICENSE for more information.",
    "dnl Released under the MIT License.",
    "REM Released under the MIT License.",
    ".. Released under the MIT License.",
    "' Released under the MIT License.",
]


def test_tails_and_marks(spark):
    want = [(["mit-statement"], ["mit-named"])] * len(TAILED)
    assert scanned(spark, TAILED) == want
    assert by_sql(TAILED) == want
    assert scanned(spark, ["Released under the MIT License and see the license of the others for details."]) == [([], [])]
