"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is brought to canonical form: A-Z in lower case, lines that state a
copyright dropped, spellings that count as equal made equal, punctuation and
space runs turned into one space. The digest of the whole canonical text is
hash-joined to the digests of the known texts. Lines that hold a cue word are
looked up alike, as notices that stand inside other texts.

Null texts count as empty. Texts without anything left have the digest of ""
and no licence. Very long texts are taken whole, and whitespace and punctuation
runs of any length are one space. Null ids and repeated rows each give a row,
an empty table gives an empty result; other columns are never looked at,
whatever their names. The table of known texts is fixed, so it is broadcast.
It holds short licences whole and, of long ones, the standard header only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2, _BSD_3 = f"{_BSD_HEAD}\n{_BSD_TAIL}", f"{_BSD_HEAD}\n{_BSD_NAMES}\n{_BSD_TAIL}"
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT_0 = _MIT.replace(", subject to the following conditions:", ".").replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n", "")
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_LINK = "For more information, please refer to <https://unlicense.org>"
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GPL_WARRANTY = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
""" + _GPL_WARRANTY + """
You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Known licence texts, standard headers of licences that are too long to stand here, and notices, with the name of each.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("Zlib", _ZLIB),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_2),
    ("BSD-2-Clause", "The 2-Clause BSD License\n" + _BSD_2),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_3),
    ("BSD-3-Clause", "The 3-Clause BSD License\n" + _BSD_3),
    ("0BSD", _0BSD),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD),
    ("MIT-0", _MIT_0),
    ("MIT-0", "MIT No Attribution\n" + _MIT_0),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n" + _UNLICENSE_LINK),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("WTFPL", _WTFPL),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n" + _WTFPL),
    ("Apache-2.0", _APACHE_HEADER),
    ("MPL-2.0", _MPL_HEADER),
    ("GPL-3.0", _GPL_HEADER.format(name="General Public License", version="3")),
    ("AGPL-3.0", _GPL_HEADER.format(name="Affero General Public License", version="3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
]
#: Pattern and replacement, applied to the lower-cased text in this order. Java and RE2 read them alike.
STEPS: list[tuple[str, str]] = [
    # a line of a text's own that begins with the word is marked; then lines that state a copyright go, with a year, a sign or a short name
    (r"(?m)^([ \t]*)copyright([ \t]+(holders?|notices?|owners?|laws?|statements?|licen[cs]es?|interests?|and|or|in|is|are|by|to)\b)", "$1\x01copyright$2"),
    (r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$", " "),
    (r"(?m)^[ \t]*(copyright[ \t]*)?(\(c\)|©)[^\n]*$", " "),
    (r"(?m)^[ \t]*copyright([ \t]+[^ \t\n]+){1,6}[ \t]*$", " "),
    (r"[!-/:-@\[-`{-~©“”‘’–—\x00-\x20]+", " "),
    (r"\blicence", "license"),
    (r"\bsub[ -]license", "sublicense"),
    (r"\bnon infringement", "noninfringement"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\b(organi|recogni|authori|merchandi)s(e|ed|es|ing|ation)\b", r"$1z$2"),
    (r"\bwhilst\b", "while"),
    (r"\bfavour", "favor"),
    (r"^ +| +$", ""),
]
CUE = "(?i)licen[cs]e|copyright|all rights|spdx"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new)
    return out


def known_digests(spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame(KNOWN, "name string, known string")
    return table.groupBy(F.sha2(canonical(F.col("known")), 256).alias("digest")).agg(F.min("name").alias("name"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, digest (of the whole canonical text), licence (or null), notices, n_notices.

    ``notices`` names the known licences of the text's lines, each once, sorted, comma-joined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a fixed table, a row for each known text
    known = known_digests(docs.sparkSession)
    names = F.create_map(*[F.lit(x) for r in known.collect() for x in (r.digest, r.name)])
    lines = F.when(text.rlike(CUE), F.filter(F.split(text, "\n"), lambda line: line.rlike(CUE))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(canonical(text), 256).alias("digest"),
        F.transform(lines, lambda line: F.element_at(names, F.sha2(canonical(line), 256))).alias("lines"),
    )
    found = F.filter("lines", lambda n: n.isNotNull())
    return rows.join(F.broadcast(known), "digest", "left").select(
        "doc_id", "digest", F.col("name").alias("licence"),
        F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"), F.size(found).cast("long").alias("n_notices"),
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(column: str) -> str:
    out = f"translate({column}, '{_UPPER}', '{_LOWER}')"
    for pattern, new in STEPS:
        out = f"regexp_replace({out}, {_sql_text(pattern)}, {_sql_text(new.replace('$', chr(92)))}, 'g')"
    return out


#: The same over ``documents`` in DuckDB's SQL.
LICENCE_SQL = f"""
WITH known AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(n) AS name
               FROM (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in KNOWN)}) v(n, t) GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, sha256({_sql_canonical("line")}) AS digest
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs WHERE regexp_matches(text, '{CUE}'))
          WHERE regexp_matches(line, '{CUE}')),
notices AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(*) AS n FROM lines JOIN known USING (digest) GROUP BY 1),
whole AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM docs)
SELECT w.doc_id, w.digest, k.name AS licence, coalesce(n.notices, '') AS notices, coalesce(n.n, 0)::BIGINT AS n_notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notices n ON w.doc_id = n.doc_id
"""
