"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought to a canonical form - lower case, without copyright lines, with one
spelling for words that licence texts spell in several ways, and with every run of
other characters than letters and digits as one space - and its SHA-256 is joined to
those of known licences. The whole document is compared, and each of its lines as a
text of its own, as licence notices are mostly single lines. Every line is brought to its form
once; the whole text's form is that of its lines put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: equivalent spellings, in the order they are replaced ---------
SPELLINGS = (
    ("&", " and "),
    ("https:", "http:"),
    ("licence", "license"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("recognise", "recognize"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("non-commercial", "noncommercial"),
    ("sub-license", "sublicense"),
    ("copyright owner", "copyright holder"),
)
# --- fixed values: patterns, valid for Java's and for RE2's regular expressions --
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
RUN = r"[^\p{L}\p{N}]+"
#: The first pattern for a text that is one line.
COPYRIGHT_TEXT = COPYRIGHT_LINE.removeprefix("(?m)")

_MIT = """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """Copyright (c) <year> <holder>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (licence, text): public licence texts and usual notices. A caller may pass others.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _MIT.removeprefix("MIT License")),
    ("ISC", _ISC),
    ("ISC", _ISC.removeprefix("ISC License")),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("0BSD", _ZERO_BSD),
    ("0BSD", "Zero-Clause BSD\n" + _ZERO_BSD),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


def line_form(line: Column) -> Column:
    """The canonical form of a text without a line end; empty if nothing is left."""
    out = F.regexp_replace(F.lower(line), COPYRIGHT_TEXT, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, RUN, " "))


def line_forms(text: Column) -> Column:
    """The forms of a text's lines, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), line_form), lambda form: form != "")


def canonical(text: Column) -> Column:
    """The canonical form; empty if nothing is left, null for null. Lines end at a line feed only."""
    return F.array_join(line_forms(text), " ")


def known_licences(spark: SparkSession) -> DataFrame:
    """The built-in texts as a table (licence, text)."""
    rows = F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(t).alias("text")) for k, t in KNOWN])
    return spark.range(1).select(F.explode(rows).alias("k")).select("k.licence", "k.text")


def digests(known: DataFrame, licence_col: str = "licence", text_col: str = "text") -> DataFrame:
    """(digest, licence) of known texts. A text of two licences goes to the first by name; empty texts are left out."""
    form = known.select(F.col(licence_col).alias("licence"), canonical(F.col(text_col)).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, whole_text, n_lines) of each document and licence found.

    whole_text: the entire document is the licence's text; n_lines: so many of its
    lines are. Null, empty and other texts without a licence give no row; rows with
    one id are one document, also those with a null id. A digest of known texts is joined as Spark sees fit: it is
    broadcast only if its measured size allows."""
    known = digests(known if known is not None else known_licences(docs.sparkSession))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    unit = lambda whole, form: F.struct(F.lit(whole).alias("whole"), F.sha2(form, 256).alias("digest"))
    several = F.contains("text", F.lit("\n"))

    def units(forms: Column) -> Column:
        """The whole text, unless nothing is left of it, and its lines if there are several."""
        whole = F.when(F.size(forms) > 0, F.array(unit(True, F.array_join(forms, " "))))
        lines = F.when(several, F.transform(forms, lambda form: unit(False, form)))
        return F.flatten(F.filter(F.array(whole, lines), lambda x: x.isNotNull()))

    # a lambda's argument is computed once, and an outer explode adds no filter on the array: one pass over each line
    found = rows.select("doc_id", F.explode_outer(F.transform(F.array(line_forms(F.col("text"))), units)[0]).alias("u"))
    found = found.select("doc_id", "u.whole", "u.digest").join(known, "digest")
    return found.groupBy("doc_id", "licence").agg(
        F.max("whole").alias("whole_text"), F.count(F.when(~F.col("whole"), 1)).alias("n_lines")
    )


def _sql_canonical(text: str) -> str:
    pattern = COPYRIGHT_LINE.replace("'", "''")
    out = f"regexp_replace(lower({text}), '{pattern}', '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '{RUN}', ' ', 'g'))"


def scan_sql(table: str = "documents") -> str:
    """The scan in DuckDB's SQL."""
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256(form) AS digest, min(licence) AS licence
  FROM (SELECT licence, {_sql_canonical("text")} AS form FROM (VALUES {values}) AS v(licence, text))
  WHERE form <> '' GROUP BY 1),
units AS (
  SELECT doc_id, TRUE AS whole, text AS unit FROM {table} WHERE text <> ''
  UNION ALL
  SELECT doc_id, FALSE, unnest(string_split(text, chr(10))) FROM {table} WHERE contains(text, chr(10))),
forms AS (SELECT doc_id, whole, {_sql_canonical("unit")} AS form FROM units)
SELECT doc_id, licence, bool_or(whole) AS whole_text, count(*) FILTER (WHERE NOT whole) AS n_lines
FROM forms JOIN known ON sha256(form) = digest WHERE form <> '' GROUP BY doc_id, licence"""
