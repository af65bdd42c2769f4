"""Licence scan by canonical digest, in DataFrame operations only.

Whole texts are brought to a canonical form (case, copyright lines, punctuation, blanks
and equivalent spellings made equal), digested, and hash-joined to the digests of known
licence texts.  Every line is looked up in the same way among known one-line notices, so
that a text which only names its licence is found as well.

The known digests are broadcast where they are few (FEW, counted), so that documents are
scanned once and not shuffled; a larger table of the caller's is joined by shuffle.

Rules: a null or wordless text has the digest of the empty form and no licence.  Two
known licences of one canonical form give the name that sorts first.  Lines end at LF; a
CR before it does not count.  Repeated rows each get a row; other columns play no part,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import named, table

#: Up to this many known digests (some 100 bytes each) are broadcast.
FEW = 20_000
#: A line that states whose copyright it is: no part of a licence's text.  It begins with a mark, a year or `by` after the
#: word, or with the word in its usual spelling and a name; words by which licence texts themselves go on are no names.
OPENING, NO_NAME = r"[ \t#*/;-]*", r"(?:Holder|Owner|Licen[cs]e|Law|Act|Notice|Statement)s?\b"
MARKED = r"(?i:(?:portions[ \t]+)?copyright[ \t]*(?:\(c\)|©|,?[ \t]*[0-9]{4}|by )|\(c\)|©)"
OWNED = r"(?:Portions[ \t]+)?Copyright[ \t]+"
COPYRIGHT_LINE = rf"(?md)^{OPENING}(?:(?:{MARKED}|{OWNED}(?!{NO_NAME})\p{{Lu}})[^\n]*|(?i:all rights reserved)[. \t]*\r?)$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Words and pairs of words that count as equal, after public matching guidelines for licence texts.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "organisation": "organization",
    "authorised": "authorized",
    "whilst": "while",
    "acknowledgement": "acknowledgment",
    "favour": "favor",
    "non infringement": "noninfringement",
    "copyright holder": "copyright owner",
    "copyright holders": "copyright owners",
    "per cent": "percent",
    "wilful": "willful",
    "fulfil": "fulfill",
    "https": "http",
}

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Public licence texts by short name, each with and without its title.
LICENSES = {
    "MIT": (MIT, "MIT License\n\n" + MIT, "The MIT License\n\n" + MIT, "The MIT License (MIT)\n\n" + MIT),
    "ISC": (ISC_GRANT + ISC_NOTICE + ISC_END, "ISC License\n\n" + ISC_GRANT + ISC_NOTICE + ISC_END),
    "0BSD": (ISC_GRANT + "." + ISC_END, "BSD Zero Clause License\n\n" + ISC_GRANT + "." + ISC_END),
    "BSD-2-Clause": (BSD_START + BSD_END, "BSD 2-Clause License\n\n" + BSD_START + BSD_END),
    "BSD-3-Clause": (BSD_START + BSD_NAMES + BSD_END, "BSD 3-Clause License\n\n" + BSD_START + BSD_NAMES + BSD_END),
    "Zlib": (ZLIB, "zlib License\n\n" + ZLIB),
    "Unlicense": (UNLICENSE,),
    "BSL-1.0": (BOOST, "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BOOST),
}
#: Digests of the canonical form of long public licence texts, as their publishers give them.
DIGESTS = {
    "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052": "Apache-2.0",
    "f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c": "Apache-2.0",
    "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793": "Apache-2.0",
    "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a": "Artistic-1.0",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd": "GFDL-1.2",
    "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd": "GFDL-1.3",
    "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f": "GPL-1.0",
    "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6": "GPL-2.0",
    "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8": "GPL-3.0",
    "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e": "LGPL-2.0",
    "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6": "MPL-1.1",
    "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9": "MPL-2.0",
}
#: Lines that name a licence, by its short name.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
}


#: One look for all spellings that are replaced, between the double blanks of `words_made_equal`.
ANY_SPELLING = f" (?:{'|'.join(old.replace(' ', '  ') for old in SPELLINGS)}) "


def words_made_equal(text: Column) -> Column:
    """Words set apart by one blank each, spellings made equal; words are whole words only.

    Texts without any such spelling are told by one expression and left as they are."""

    def respelled(x: Column) -> Column:
        out = x
        for old, new in SPELLINGS.items():
            out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
        return F.when(x.rlike(ANY_SPELLING), out).otherwise(x)

    # two blanks between words while replacing, so that neighbouring words do not share one
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, NOT_WORD, "  ")), F.lit(" "))
    return F.trim(F.replace(F.get(F.transform(F.array(spaced), respelled), F.lit(0)), F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical form of a whole text; one without the words of a copyright line has none to look for."""
    given = F.coalesce(text, F.lit(""))
    low = F.lower(given)
    may = low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights reserved")
    return words_made_equal(F.when(may, F.lower(F.regexp_replace(given, COPYRIGHT_LINE, ""))).otherwise(low))


def digests(spark: SparkSession, licenses: dict[str, Sequence[str]], known: dict[str, str] | None = None) -> DataFrame:
    """(license, digest), one row a digest, of licence texts and of digests already known."""
    rows = [(name, text, None) for name, texts in licenses.items() for text in texts] + [(name, None, digest) for digest, name in (known or {}).items()]
    given = spark.createDataFrame(rows, "license string, text string, digest string")
    return given.select("license", F.coalesce("digest", F.sha2(canonical(F.col("text")), 256)).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def notices(text: Column, known: dict[str, Sequence[str]]) -> Column:
    """array<string>: the licences whose notices are lines of the text, sorted, each once."""
    entries = [part for name, lines in known.items() for line in lines for part in (F.sha2(words_made_equal(F.lower(F.lit(line))), 256), F.lit(name))]
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
    if all("licen" in line.lower() for held in known.values() for line in held):
        lines = F.filter(lines, lambda x: x.contains("licen"))  # the digest of any other line differs
    found = F.transform(lines, lambda x: F.element_at(F.create_map(*entries), F.sha2(words_made_equal(x), 256)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def scan(df: DataFrame, known: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), lines: dict[str, Sequence[str]] = NOTICES) -> DataFrame:
    """Columns `keep` plus digest, license (null if none) and notices; `known` is a table of the caller's, joined by digest."""
    kept = [named(k).alias(f"k{i}") for i, k in enumerate(keep)]
    marked = df.select(*kept, F.sha2(canonical(named(text)), 256).alias("digest"), notices(named(text), lines).alias("notices"))
    few = known.limit(FEW + 1).count() <= FEW
    joined = marked.join(F.broadcast(known) if few else known, "digest", "left")
    return joined.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "digest", "license", "notices")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), digests(spark, LICENSES, DIGESTS)).withColumn("notices", F.concat_ws(",", "notices"))


# The SQL works by lists of lines and of words, where the operator works by expressions over the whole text.


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_words(text: str) -> str:
    single = {k: v for k, v in SPELLINGS.items() if " " not in k}
    words = f"list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), lambda w: CASE w {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in single.items())} ELSE w END)"
    out = f"'|' || array_to_string({words}, '||') || '|'"
    for old, new in SPELLINGS.items():
        if " " in old:
            out = f"replace({out}, '|{old.replace(' ', '||')}|', '|{new.replace(' ', '||')}|')"
    return f"trim(replace(replace({out}, '||', ' '), '|', ' '))"


def _sql_canonical(text: str) -> str:
    owned = f"regexp_matches(l, '^{OPENING}{OWNED}\\p{{Lu}}') AND NOT regexp_matches(l, '^{OPENING}{OWNED}{NO_NAME}')"
    owner = f"regexp_matches(l, '^{OPENING}{MARKED}') OR ({owned}) OR regexp_full_match(l, '{OPENING}(?i:all rights reserved)[. \\t]*\\r?')"
    lines = f"list_transform(list_filter(string_split(coalesce({text}, ''), chr(10)), lambda l: NOT ({owner})), lambda l: lower(l))"
    return _sql_words(f"array_to_string({lines}, chr(10))")


OP6_SQL = f"""
WITH known AS (
  SELECT min(license) AS license, digest FROM (
    SELECT license, sha256({_sql_canonical("t")}) AS digest FROM (VALUES {", ".join(f"('{name}', {_sql_text(text)})" for name, texts in LICENSES.items() for text in texts)}) AS v(license, t)
    UNION ALL SELECT * FROM (VALUES {", ".join(f"('{name}', '{digest}')" for digest, name in DIGESTS.items())}) AS v(license, digest)
  ) GROUP BY digest
), notice AS (
  SELECT license, sha256({_sql_words("lower(t)")}) AS digest FROM (VALUES {", ".join(f"('{name}', {_sql_text(text)})" for name, texts in NOTICES.items() for text in texts)}) AS v(license, t)
), lines AS (SELECT DISTINCT text, unnest(string_split(lower(text), chr(10))) AS line FROM documents WHERE text IS NOT NULL
), named AS (
  SELECT text, list_sort(list_distinct(list(license))) AS notices FROM lines JOIN notice ON sha256({_sql_words("line")}) = digest GROUP BY text
), d AS (SELECT doc_id, text, sha256({_sql_canonical("text")}) AS digest FROM documents)
SELECT doc_id, digest, license, coalesce(array_to_string(notices, ','), '') AS notices
FROM d LEFT JOIN known USING (digest) LEFT JOIN named USING (text)
"""
