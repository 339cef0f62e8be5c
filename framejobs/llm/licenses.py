"""Licence scans by canonical digest.

A text is brought to a canonical form (case, punctuation and white space, copyright lines, equivalent spellings) and its SHA-256 is looked up among
the digests of known licence texts: whole documents by a hash join, and each line of a document as a notice of its own. All of it is built-in
expressions; the table of known texts is a fixed list, so it is broadcast.

Defined results: a null text is empty; texts with nothing left in canonical form match no licence; equal rows are scanned each; of known
texts with one canonical form the smallest id counts; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Known texts: (id, text). Whole licences first, then one-line notices.
KNOWN = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + _AS_IS),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("reserved", "All rights reserved."),
]
# Equivalent spellings, as whole words, or as beginnings of words if they end with *.
SPELLINGS = [
    ("acknowledgement*", "acknowledgment"), ("analogue", "analog"), ("analyse*", "analyze"), ("artefact*", "artifact"), ("authoris*", "authoriz"), ("behaviour*", "behavior"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue*", "catalog"), ("categoris*", "categoriz"), ("centre", "center"), ("colour*", "color"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("customis*", "customiz"), ("emphasise*", "emphasize"), ("favour*", "favor"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("honour*", "honor"), ("initialis*", "initializ"), ("judgement*", "judgment"), ("labelled", "labeled"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence*", "license"), ("maximis*", "maximiz"), ("merchantibility", "merchantability"), ("minimis*", "minimiz"),
    ("modelled", "modeled"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("offence*", "offense"), ("optimis*", "optimiz"),
    ("organis*", "organiz"), ("per cent", "percent"), ("practise*", "practice"), ("programme", "program"), ("realis*", "realiz"), ("recognis*", "recogniz"),
    ("signalling", "signaling"), ("sub licence*", "sublicense"), ("sub license*", "sublicense"), ("sublicence*", "sublicense"), ("utilis*", "utiliz"), ("whilst", "while"),
    ("wilful*", "willful"),
]
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = "\\n[ \\t*/#;-]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*"
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F\\x{A0}\\x{A9}\\x{2013}\\x{2014}\\x{2018}\\x{2019}\\x{201C}\\x{201D}]+"


def canonical(text: Column, whole: bool) -> Column:
    """The canonical form; of whole texts without their copyright lines."""
    t = F.translate(text, UPPER, LOWER)
    if whole:
        t = F.regexp_replace(F.concat(F.lit("\n"), t), COPYRIGHT_LINE, "")
    t = F.trim(F.regexp_replace(t, NO_WORD, " "))
    # Bound by a lambda, so that it is made once; only texts that have one of the spellings are respelled.
    return F.transform(F.array(t), lambda x: F.when(x.rlike(ANY_SPELLING), _respelled(x)).otherwise(x))[0]


def _respelled(t: Column) -> Column:
    """Words are put apart by two blanks, so that each has one of its own on either side."""
    t = F.concat(F.lit(" "), F.replace(t, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in _padded():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.replace(F.trim(t), F.lit("  "), F.lit(" "))


def _padded() -> list[tuple[str, str]]:
    pad = lambda a, end: " " + a.replace(" ", "  ") + end
    return [(pad(a.rstrip("*"), "" if a.endswith("*") else " "), pad(b, "" if a.endswith("*") else " ")) for a, b in SPELLINGS]


#: What every text with one of the spellings has.
_FIRST = {a[0]: [b.rstrip("*")[1:] for b, _ in SPELLINGS if b[0] == a[0]] for a, _ in SPELLINGS}  # one branch for each first letter
ANY_SPELLING = "\\b(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(_FIRST.items())) + ")"


def digest(text: Column, whole: bool) -> Column:
    return F.sha2(canonical(text, whole), 256)


#: Title and copyright lines at the head of a licence file, up to 40; lines of the body stay, however they are wrapped.
HEAD = (
    "\\A(?:\\s*+[*/#; \\t-]*+(?:(?:the )?(?:mit|expat|isc|zlib|0bsd|zero[ -]clause bsd|(?:(?:new|modified|simplified|revised) )?bsd)[^\\n]{0,40}"
    "|(?:copyright|\\(c\\)|©|all rights reserved)[^\\n]*+)(?:\\n|\\z)){0,40}"
)
#: Body digests of whole licences that are too long to list, as their publishers word them.
LONG = {
    "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25": "Apache-2.0",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "8870e5967f922b7e719ec6ce8608bc36161428a3f91512359450b97f2443130f": "GFDL-1.2",
    "06f2f604013cdf1f77b2c7422a98715eb317ca58e126d18e1620acca4e12ce1c": "GFDL-1.3",
    "d408d9dad6e4560274412e743ec3ba01007197655029f60544c308bc54f80499": "GPL-1.0",
    "0bfb659bf7eeb9921df1446a6a93beba70e0dc947eec10a42d26bb310dccd498": "GPL-2.0",
    "7d478223d8fcde6480339b8bbaadacf6b93d7007d04a13fbd30f71a80fd981a0": "GPL-3.0",
    "9ccbf81e2fd78db81966e466a22ed39318d0a4b4550cd69d1144dcf09722ff10": "LGPL-2.0",
    "a9cc8dda4023821e198a2e1bee36afc3e68fce90828780c7bac37ffe33565e15": "LGPL-2.1",
    "3ce770135de37fc153de7af30789ebf6cf1e9ad54eb9b487647ea8aa9ccae9c2": "LGPL-3.0",
    "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}


def body_digest(text: Column) -> Column:
    """The digest of a licence file without its head."""
    return F.sha2(canonical(F.regexp_replace(F.translate(text, UPPER, LOWER), HEAD, ""), False), 256)


#: Every known text has one of these beginnings of words, however it is spelled; BEGIN letters at the start of a word are the same in all spellings.
IN_WHOLE, BEGIN = "copyright|software|licen|reserved", 3
assert all(a[:BEGIN] == b[:BEGIN] for a, b in SPELLINGS)


def _may_begin(line: Column, forms: list[str]) -> Column:
    """Whether a line's first word begins like that of a canonical form. A line that doesn't has none of them."""
    begins = sorted({f.split(" ")[0][:BEGIN] for f in forms})
    return line.rlike(f"\\A{NO_WORD[:-1]}*(?i:{'|'.join(map(re.escape, begins))})") if begins else F.lit(False)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, text_digest, license_id (of the whole text, or null), n_notices (lines that are known), notices (their ids)."""
    spark = docs.sparkSession
    table = spark.createDataFrame(known if known is not None else KNOWN, "license_id string, known_text string")
    forms = lambda whole: table.select("license_id", digest(F.col("known_text"), whole).alias("digest")).filter(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    lines = {r["digest"]: r["license_id"] for r in forms(False).collect()}  # the fixed list
    plain = [r["form"] for r in table.select(canonical(F.col("known_text"), False).alias("form")).filter("form <> ''").collect()]
    names = F.create_map(*(F.lit(x) for item in sorted(lines.items()) for x in item)) if lines else F.create_map().cast("map<string,string>")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    notices = F.filter(F.split("text", "\n"), lambda line: _may_begin(line, plain))
    found = F.filter(F.transform(notices, lambda line: names[digest(line, False)]), lambda i: i.isNotNull())
    bodies = LONG if known is None else {}
    bodies = bodies | {r["digest"]: r["license_id"] for r in table.groupBy(body_digest(F.col("known_text")).alias("digest")).agg(F.min("license_id").alias("license_id")).collect()}
    bodies.pop(EMPTY, None)
    by_body = F.create_map(*(F.lit(x) for item in sorted(bodies.items()) for x in item)) if bodies else F.create_map().cast("map<string,string>")
    whole = f"(?i){IN_WHOLE}" if all(re.search(IN_WHOLE, f) for f in plain) else ""
    cut = base.select("doc_id", digest(F.col("text"), True).alias("text_digest"), F.when(F.col("text").rlike(whole), by_body[body_digest(F.col("text"))]).alias("by_body"), found.alias("found"))
    joined = cut.join(F.broadcast(forms(True)), F.col("text_digest") == F.col("digest"), "left")
    notices = F.array_join(F.array_sort(F.array_distinct("found")), ",")
    license_id = F.coalesce("license_id", "by_body").alias("license_id")
    return joined.select("doc_id", "text_digest", license_id, F.size("found").cast("long").alias("n_notices"), notices.alias("notices"))


def op9_license(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_digest(text: str, whole: bool) -> str:
    t = f"translate({text}, '{UPPER}', '{LOWER}')"
    if whole:
        t = f"regexp_replace(chr(10) || {t}, {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    t = f"' ' || replace(trim(regexp_replace({t}, {_sql_text(NO_WORD)}, ' ', 'g')), ' ', '  ') || ' '"
    for a, b in _padded():
        t = f"replace({t}, '{a}', '{b}')"
    return f"sha256(replace(trim({t}), '  ', ' '))"


OP9_SQL = f"""
with known(license_id, t) as (values {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)}),
whole as (select {_sql_digest("t", True)} as digest, min(license_id) as license_id from known group by 1 having digest <> sha256('')),
lines as (select {_sql_digest("t", False)} as digest, min(license_id) as license_id from known group by 1 having digest <> sha256('')),
d as (select doc_id, row_number() over () as n, coalesce(text, '') as text from documents),
l as (select n, unnest(string_split(text, chr(10))) as line from d),
m as (select n, count(*) as n_notices, array_to_string(list_sort(list_distinct(list(license_id))), ',') as notices
      from (select n, {_sql_digest("line", False)} as digest from l) join lines using (digest) group by n),
w as (select doc_id, n, {_sql_digest("text", True)} as text_digest from d)
select doc_id, text_digest, license_id, coalesce(n_notices, 0) as n_notices, coalesce(notices, '') as notices
from w left join whole on text_digest = digest left join m using (n)
"""
