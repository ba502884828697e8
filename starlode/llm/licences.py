"""Operator 7: licence scans by canonical digest lookup.

A text's canonical form has A-Z in lower case, no copyright lines, equivalent spellings made one,
runs of punctuation and white space made one blank, none at its ends. Its SHA-256 is joined to the
digests of known licence texts: a whole text is that licence or it isn't. The known table has
``len(TABLE)`` rows, a bound that doesn't depend on the input, so it is broadcast; documents are
neither shuffled nor grouped. All steps are SQL functions; ``oracle_sql`` has the same in DuckDB.

Defined results: a null text counts as empty; an empty canonical form matches nothing; of known texts
with equal digests the licence that sorts first counts; null and repeated ids are kept; a very long text is
held by one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A copyright notice: the word with a sign, a year, "by" or a place-holder after it, or a sign with a year.
#: A line of a text that merely begins with the word ("copyright notice and ...") isn't one.
COPYRIGHT = r"(^|\n)[ \t#*/;-]*(copyright[ \t:]*(\(c\)|\x{a9}|[0-9]{4}|by[ \t]|\[|<)|\(c\)[ \t]*(copyright|[0-9]{4})|\x{a9}|all rights reserved[ \t.]*(\n|$))[^\n]*"
BREAKS = r"[^a-z0-9\x{80}-\x{10ffff}]+"
#: Each a whole word between blanks, applied in this order after BREAKS.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("behaviour", "behavior"), ("favour", "favor"), ("organisation", "organization"), ("authorised", "authorized"), ("recognised", "recognized"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (licence, text), public texts and the short notices that stand for them.
KNOWN = (
    ("MIT", _MIT), ("MIT", "The MIT License\n\n" + _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "Released under the MIT License."),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_REST}"), ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("BSD-2-Clause", _BSD_TOP + "\n" + _BSD_END), ("BSD-3-Clause", _BSD_TOP + "\n" + _BSD_THIRD + "\n" + _BSD_END), ("Zlib", _ZLIB), ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Whole licence texts, each named by its file.
FULL = tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
TABLE = KNOWN + FULL


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    out = F.regexp_replace(out, COPYRIGHT, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, BREAKS, " "), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "utf-8"), 256)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", known: tuple[tuple[str, str], ...] = TABLE) -> DataFrame:
    """key, digest and license (null: none) of every row."""
    texts = df.sparkSession.createDataFrame([*known], "license string, text string")
    table = texts.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))
    rows = df.select(df[key], digest(df[text]).alias("digest"))
    return rows.join(F.broadcast(table), "digest", "left").select(key, "digest", "license")


def oracle(known: tuple[tuple[str, str], ...] = TABLE) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"regexp_replace(translate(coalesce({x}, ''), {q(ascii_uppercase)}, {q(ascii_lowercase)}), {q(COPYRIGHT)}, chr(10), 'g')"
        x = f"' ' || regexp_replace({x}, {q(BREAKS)}, ' ', 'g') || ' '"
        for a, b in EQUIVALENT:
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"trim({x}, ' ')"

    rows = ", ".join(f"({q(a)}, {q(b)})" for a, b in known)
    return f"""
        with known as (select sha256({form("text")}) digest, min(license) license from (values {rows}) k(license, text) where {form("text")} != '' group by 1),
        rows as (select doc_id, sha256({form("text")}) digest from documents)
        select doc_id, digest, license from rows left join known using (digest)"""
