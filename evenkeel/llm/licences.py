"""Licence scans by canonical digests, with DataFrame functions alone.

A text is canonical after lower-casing, dropping copyright lines ("copyright (c)",
or a year after it, so that no wrapped line of a text goes) and the headings that
it begins with, making equivalent spellings one and turning every run of other
signs into one space. The digest of the whole text is joined to the digests of
known licence texts; lines that are or begin with a known notice are looked up.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices. TEXTS, NOTICES and COPYRIGHT are those of the SQL, which stays as it is;
# MORE_TEXTS, OTHER_TEXTS, DIGESTS and MORE_NOTICES come on top, and COPYRIGHT_LINE takes the place of COPYRIGHT.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
_BSD3 = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED BY", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY")
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_END = "\nFor more information, please refer to <{}://unlicense.org{}>"
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
OTHER_TEXTS = [("Unlicense", _UNLICENSE), *[("Unlicense", _UNLICENSE + _UNLICENSE_END.format(a, b)) for a in ("http", "https") for b in ("", "/")], ("BSL-1.0", _BSL), ("BSL-1.0", _BSL.split("\n", 1)[1])]
MORE_TEXTS = [("BSD-3-Clause", _BSD3), ("BSD-3-Clause", re.sub(r"(?m)^[0-9]\. ", "", _BSD3)), ("BSD-2-Clause", re.sub(r"(?m)^[0-9]\. ", "", TEXTS["BSD-2-Clause"]))]
#: Digests of long texts as published, with and without their appendix or end mark, with links by http and https.
DIGESTS = {
    "Apache-2.0": ["b006954ca49c595831e44592054eb7df00763beda6df38e52e9d36a02a916ef5", "5798ac8eb1382cf0a7e6f4107e13e06cb0117b5965f904a099074b1fa2514c29", "b7901703ca7de49fb934ca388db46676217c8b5502d35203ff525c15b226b8e1", "7b0bb1d8dbcbea1c802d3a288b3fd4d1c82b219c4c4282bea036884ebf036aea"],
    "GPL-3.0": ["04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3", "c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64", "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2", "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19"],
    "GPL-2.0": ["29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f", "b519669ce969d79c162f16dca67a0abab53b46986efb528afe3e105936cc0050", "639c69262acf6777ee0c163867caf39bdb5ec90b59bad9412c9e6101fb65e404"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "MPL-1.1": ["204340b226fd810b187f231a87e223ea2dbfae06c8790568e1868cfecf8d4bac", "0660d1922f9d3acf19bf9040a5c9636739265bae8625a5643a955e9e5283dec1"],
    "GFDL-1.3": ["7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"],
    "MPL-2.0": ["c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3", "ca15f9cdd3f2fd06a41df42402a3886e1de25f02b077725084c5d8d535cfcec4"],
}
MORE_NOTICES = [
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("licenced", "licensed"), ("organisation", "organization"), ("authoris", "authoriz"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("sub-license", "sublicense"), ("per cent", "percent")]
COPYRIGHT = "^(c )?copyright( c)? |^(c )?copyright( c)?$|^c [0-9]{4}|^all rights reserved$"
COPYRIGHT_LINE = r"^(portions )?(c )?copyright( c)?( by)? ([0-9]{4}|yyyy|year)( |$)|^(portions )?copyright c( |$)|^c copyright( |$)|^c ([0-9]{4}|year)( |$)|^all rights reserved$"
_NAMES = "(?:mit|expat|isc|0bsd|bsd|zlib|apache|gnu general public|mozilla public|(?:bsd )?zero clause(?: bsd)?|bsd [023] clause(?: new or revised| new| revised| modified| simplified)?|(?:new|modified|simplified|revised) bsd|[023] clause bsd)"
HEADING = rf"(?:the )?{_NAMES} license(?: (?:agreement|mit|expat|isc|bsd|0bsd|zlib))*(?: v?(?:version )?[0-9](?: [0-9])?)?(?: january 2004| 29 june 2007)?|license|licensing|mit|isc|version 2 0 january 2004|version 3 29 june 2007|https? www apache org licenses"


def normal(text: Column) -> Column:
    """Lower case, one spelling, one space for every run of other signs; line ends stay."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")


def canonical_lines(text: Column) -> Column:
    """The lines in canonical form, without empty and copyright lines."""
    return F.filter(F.transform(F.split(normal(text), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(COPYRIGHT_LINE))


def canonical_text(lines: Column) -> Column:
    """The canonical lines as one, without the headings that they begin with; headings alone stay."""
    return F.translate(F.regexp_replace(F.array_join(lines, "\n"), rf"^(?:(?:{HEADING})\n)+", ""), "\n", " ")


def _known(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    d = spark.createDataFrame(rows, "licence string, text string")
    return d.select("licence", canonical_text(canonical_lines(F.col("text"))).alias("canon")).select("licence", "canon", F.sha2("canon", 256).alias("digest")).dropDuplicates(["digest"])


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: id, ``digest`` (SHA-256 of the canonical text), ``licence`` (null if unknown),
    ``n_notices`` (lines that are or begin with a known notice), ``notices`` (their licences, sorted,
    comma-separated) and ``reserved`` (a line ends in "all rights reserved").

    An SPDX identifier must be the whole line, as more signs make another identifier of it.
    A null text is empty, and an empty text has the digest of no bytes and no licence.
    Repeated rows each get a row; other columns are ignored.
    """
    spark = df.sparkSession
    known = _known(spark, list(texts.items()) if texts else list(TEXTS.items()) + MORE_TEXTS + OTHER_TEXTS).select("licence", "digest")
    if not texts:
        known = known.unionByName(spark.createDataFrame([(k, d) for k, v in DIGESTS.items() for d in v], "licence string, digest string"))
    notice = {r["canon"]: r["licence"] for r in _known(spark, NOTICES + MORE_NOTICES if notices is None else notices).collect()}  # the given list, no rows of df
    d = df.select(F.col(id_col).alias(id_col), canonical_lines(F.col(text_col)).alias("lines"), normal(F.col(text_col)).rlike(r"(^|[ \n])all rights reserved *(\n|$)").alias("reserved"))
    first = sorted(notice, key=len, reverse=True)  # the longest that fits counts
    pattern = "^(" + "|".join(x + ("$" if x.startswith("spdx ") else "(?= |$)") for x in first) + ")"
    table = F.create_map(*[F.lit(x) for kv in notice.items() for x in kv]) if notice else None
    hits = F.transform(F.filter("lines", lambda x: x.rlike(pattern)), lambda x: table[F.regexp_extract(x, pattern, 1)]) if notice else F.array().cast("array<string>")
    d = d.select(id_col, F.sha2(canonical_text(F.col("lines")), 256).alias("digest"), hits.alias("hits"), "reserved")
    d = d.join(F.broadcast(known), "digest", "left")  # a fixed list
    return d.select(id_col, "digest", "licence", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"), "reserved")


def oracle(table: str = "documents") -> str:
    """The same over ``table`` as SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def lines(col: str) -> str:
        t = f"lower(coalesce({col}, ''))"
        for a, b in SPELLINGS:
            t = f"replace({t}, {q(a)}, {q(b)})"
        t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, {q(COPYRIGHT)}))"

    rows = lambda kv: ", ".join(f"({q(a)}, {q(b)})" for a, b in kv)
    return f"""
WITH t AS (SELECT column0 licence, sha256(array_to_string({lines('column1')}, ' ')) digest FROM (VALUES {rows(TEXTS.items())}) v(column0, column1)),
n AS (SELECT column0 licence, array_to_string({lines('column1')}, ' ') canon FROM (VALUES {rows(NOTICES)}) v(column0, column1)),
d AS (SELECT doc_id, {lines('text')} AS lines FROM {table}),
m AS (SELECT map_from_entries(list((canon, licence))) AS tab, list(canon) AS canons FROM n),
h AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) digest, list_transform(list_filter(lines, lambda x: list_contains(canons, x)), lambda x: tab[x]) hits FROM d, m)
SELECT doc_id, h.digest, licence, len(hits)::BIGINT n_notices, array_to_string(list_sort(list_distinct(hits)), ',') notices
FROM h LEFT JOIN t ON t.digest = h.digest"""
