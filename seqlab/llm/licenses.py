"""Licence scans by canonical digest: whole texts against known licences.

A text is brought to canonical form (lower case, without copyright statements, "all rights reserved" and
a heading that names the licence, equivalent spellings made one, punctuation and white space to single
spaces) and its SHA-256 is joined to the digests of known licences. White space is all one, so a wrapped
text equals an unwrapped one; a copyright statement is a line that begins with the word or sign and goes
on with a sign, a year, a place for these, or a holder's name, so that lines which only begin with the
word stay. Lines that name a licence are looked up in the same way, each line as a text of its own, so a
one-line notice inside a document is found too.

Known are the digests of KNOWN and KNOWN_DIGESTS; callers add theirs with registry, a table made by
registry_of() from whole texts of any number.

Null and empty texts have the digest of the empty text and no licence. Texts of any length are taken
whole. Every row of the input has a row; ids may repeat or be null; an empty table gives no rows, and
extra columns play no part. The built-in digests are a fixed table, so their join broadcasts a proven few
rows; that of callers is joined as Spark sees fit.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# The texts of common licences.
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + ISC.split("\n\n")[2]
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
KNOWN = [
    ("MIT", MIT), ("ISC", ISC), ("BSD-2-Clause", BSD_HEAD + BSD_1 + BSD_2 + BSD_TAIL), ("BSD-3-Clause", BSD_HEAD + BSD_1 + BSD_2 + BSD_3 + BSD_TAIL),
    ("Zlib", ZLIB), ("BSL-1.0", BSL), ("Unlicense", UNLICENSE), ("Unlicense", UNLICENSE.rpartition("\n\n")[0]), ("0BSD", ZERO_BSD),
    ("Apache-2.0", APACHE_NOTICE), ("MPL-2.0", MPL_NOTICE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
]
# Digests of the canonical forms of long licences, made by digest_of() from the texts that Linux distributions ship as common licences.
KNOWN_DIGESTS = [
    ("Apache-2.0", "7efb483548d7d7aab0df860d55961ea316cd97c18c31758fd55bfa5795985eb3"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-3.0", "e45fdf2ecb0f05dd188636cd45a7e9be8d0af6c375e83667e79460782b04dd25"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "65563a4aa777e765df3559c529e0417e293e01dfedce1a4036858cd408aa4f5d"),
    ("MPL-2.0", "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
]
# Spellings that count as one, where punctuation is single spaces already; after the licence list's matching guidelines.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisation", "capitalization"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("fulfill", "fulfil"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("http ", "https "),
]
#: A line that begins with the word and two capitalised ones, before lower case.
NAMED_HOLDER = r"(^|\n)[^\p{L}\p{N}\n]*([Pp]ortions )?[Cc]opyright (by )?\p{Lu}\p{Ll}+ \p{Lu}[^\n]{0,60}"
#: How a statement begins: the word or sign, more than once or after "portions".
STATED = r"(^|\n)[^\p{L}\p{N}\n]*(portions )?((copyright|©|\(c\))[^\p{L}\p{N}\n]*)+"
#: A statement of years alone, with the holder on the line below and then an empty line.
HOLDER_BELOW = STATED + r"[12][0-9]{3}[^\p{L}\n]*\n[^\p{L}\p{N}\n]*\p{L}[^\n]{0,60}\n[^\p{L}\p{N}\n]*\n"
#: The word and two to four others alone on a line, before an empty line.
PLAIN_HOLDER = r"(^|\n)[^\p{L}\p{N}\n]*(portions )?copyright (by )?\p{L}+( \p{L}+){1,3}[ \t\r]*\n[^\p{L}\p{N}\n]*\n"
#: A line that begins so and goes on with a sign, a year or a place for them, or names an organisation.
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(portions )?(((copyright|©|\(c\))[^\p{L}\p{N}\n]*)+(c\)|[12][0-9]{3}|©|<|\[|\{)|copyright [^\n]{0,80}\b(authors|inc|llc|ltd|gmbh|corporation|foundation|developers)\b)[^\n]*"
#: A first line that names the licence by its identifier, with text behind it.
IDENTIFIER = r"^[^\p{L}\p{N}]*spdx-license-identifier:[^\n]*\n"
LINES = (HOLDER_BELOW, PLAIN_HOLDER, COPYRIGHT_LINE)
RESERVED = "all rights reserved"
#: A first line that names the licence.
HEADING = r"^[^\p{L}\p{N}]*(the )?(mit|isc|x11|expat|zlib|bsd|new bsd|modified bsd|revised bsd|simplified bsd|boost software|apache)\b[^\n]{0,60}licen[cs]e\b[^\n]{0,40}\n"
SEPARATORS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    # a statement has the word or a sign; texts without them are as the patterns would leave them
    low = F.lower(text)
    named = F.lower(F.when(low.contains("copyright"), F.regexp_replace(text, F.lit(NAMED_HOLDER), F.lit("\n"))).otherwise(text))
    out = F.regexp_replace(named, F.lit(IDENTIFIER), F.lit(""))
    stated = out
    for line in LINES:
        stated = F.regexp_replace(stated, F.lit(line), F.lit("\n"))
    out = F.when(low.contains("copyright") | low.contains("(c)") | low.contains("©"), stated).otherwise(out)
    out = F.replace(out, F.lit(RESERVED), F.lit(" "))
    out = F.regexp_replace(F.regexp_replace(out, F.lit(HEADING), F.lit("")), F.lit(SEPARATORS), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def digest_of(text: str) -> str:
    """The same in Python, for the fixed texts."""
    text = regex.sub(IDENTIFIER, "", regex.sub(NAMED_HOLDER, "\n", text).lower())
    for line in LINES:
        text = regex.sub(line, "\n", text)
    text = text.replace(RESERVED, " ")
    text = regex.sub(SEPARATORS, " ", regex.sub(HEADING, "", text))
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return hashlib.sha256(text.strip(" ").encode()).hexdigest()


def known_digests() -> dict[str, str]:
    """Digest to licence."""
    return {digest_of(text): name for name, text in KNOWN} | {d: name for name, d in KNOWN_DIGESTS}


def registry_of(texts: DataFrame, name_col: str = "licence", text_col: str = "text") -> DataFrame:
    """text_digest and licence of whole licence texts; of names with one digest the first in order. Rows without a name are left out."""
    named = texts.filter(F.col(name_col).isNotNull()).select(digest(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_digest"), F.col(name_col).alias("licence"))
    return named.groupBy("text_digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", registry: DataFrame | None = None) -> DataFrame:
    """One row per row: id_col, text_digest, licence (of the whole text, or null) and notices (built-in licences that single lines name, sorted, joined by commas)."""
    known = sorted(known_digests().items())
    own = docs.sparkSession.createDataFrame(known, "text_digest string, built_in string")
    names = F.create_map(*(F.lit(x) for pair in known for x in pair))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("licen[cs]e"))
    notices = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: names[digest(x)]), lambda x: x.isNotNull())))
    rows = docs.select(F.col(id_col).alias("id"), digest(text).alias("text_digest"), F.array_join(notices, ",").alias("notices"))
    out, licence = rows.join(F.broadcast(own), "text_digest", "left"), F.col("built_in")
    if registry is not None:
        out, licence = out.join(registry.select("text_digest", F.col("licence").alias("added")), "text_digest", "left"), F.coalesce("added", "built_in")
    return out.select(F.col("id").alias(id_col), "text_digest", licence.alias("licence"), "notices")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql(x: str) -> str:
    out = f"lower(regexp_replace({x}, '{NAMED_HOLDER}', chr(10), 'g'))"
    out = f"regexp_replace({out}, '{IDENTIFIER}', '')"
    for line in LINES:
        out = f"regexp_replace({out}, '{line}', chr(10), 'g')"
    out = f"replace({out}, '{RESERVED}', ' ')"
    out = f"regexp_replace(regexp_replace({out}, '{HEADING}', ''), '{SEPARATORS}', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"sha256(trim({out}))"


OP7_SQL = f"""
with known(d, licence) as (values {", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))}),
docs as (select doc_id, coalesce(text, '') as t from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) as x from docs),
named as (select doc_id, licence from lines join known on d = {_sql("x")} where regexp_matches(lower(x), 'licen[cs]e') group by doc_id, licence),
notices as (select doc_id, string_agg(licence, ',' order by licence) as n from named group by doc_id),
whole as (select doc_id, {_sql("t")} as text_digest from docs)
select w.doc_id, w.text_digest, k.licence, coalesce(n.n, '') as notices
from whole w left join known k on k.d = w.text_digest left join notices n on n.doc_id = w.doc_id
"""
