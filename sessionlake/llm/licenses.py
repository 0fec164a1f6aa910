"""License scans by canonical digest lookup.

A text is normalised (letter case, copyright lines, punctuation, spacing and equivalent
spellings) and hashed as a whole; the digest is joined to those of known licences. Built-in
functions only; the join is by hash, on one 64-character key.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.llm.common import ascii_lower

#: Known sides of at most so many rows are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_ROWS = 100_000

# Lines that start so are copyright notices and don't count. A wrapped line of a
# licence's body may start with the word copyright, or with (c) as the mark of an item.
NOTICE_LINE = r"^[ \t\r]*(copyright[ \t]*(\(c\)|©|[<\[]|[0-9]{4})|\(c\)|©|all rights reserved)"
ITEM_LINE = r"^[ \t\r]*\(c\)[ \t]+you must"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Spellings that licence-matching guidelines treat as equal.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasise", "emphasize"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
# The same for phrases of several words.
EQUIVALENT_PHRASES = (("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"))

# Texts of common short licences, without their copyright lines.
_PERMISSION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", _PERMISSION + _SOURCE + _BINARY + _AS_IS),
    ("BSD-3-Clause", _PERMISSION + _SOURCE + _BINARY + _NAMES + _AS_IS),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
)

# Titles that stand above the short licences.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
}
FULL_TEXTS = Path(__file__).with_name("license_texts")
TERMS_END = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): the short texts with and without titles, the long ones with and without what follows their terms."""
    known = [*KNOWN, *((i, f"{title}\n{text}") for i, text in KNOWN for title in TITLES.get(i, ()))]
    for f in sorted(FULL_TEXTS.glob("*.txt")):
        text = f.read_text(encoding="utf-8")
        known.append((f.stem, text))
        if TERMS_END in text:
            terms = text[: text.index(TERMS_END)]
            known += [(f.stem, terms), (f.stem, terms + TERMS_END)]
    return known


def canonical(text: Column) -> Column:
    """The normal form: words of letters, digits and non-ASCII characters, one space apart."""
    notice = lambda x: x.rlike(NOTICE_LINE) & ~x.rlike(ITEM_LINE)
    lines = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: ~notice(x))
    words = F.filter(F.split(F.array_join(lines, "\n"), NOT_WORD), lambda w: w != "")
    same = F.create_map(*[F.lit(v) for pair in EQUIVALENT for v in pair])
    least, most = (f(len(a) for a, _ in EQUIVALENT) for f in (min, max))
    spelt = F.transform(words, lambda w: F.when(F.length(w).between(least, most), F.coalesce(F.try_element_at(same, w), w)).otherwise(w))
    apart = F.concat(F.lit(" "), F.array_join(spelt, "  "), F.lit(" "))  # each word has two spaces of its own, so phrases side by side share none
    for a, b in EQUIVALENT_PHRASES:
        apart = F.replace(apart, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.btrim(F.replace(apart, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known: tuple | None = None) -> DataFrame:
    """(digest, license_id): one row for each digest; of equal ones the least id."""
    rows = spark.createDataFrame(known_texts() if known is None else list(known), "license_id string, text string")
    return rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license_id (null if unknown) of every row.

    known: (digest, license_id). Null, blank and punctuation-only texts have the digest of
    the empty text and no licence; long texts are normalised whole. Of licences with equal
    digests the least id counts. Repeated rows come back as often as they came; an empty table
    gives no rows; other columns are ignored.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256))
    side = F.broadcast(known) if known.count() <= MAX_BROADCAST_ROWS else known
    return docs.select(F.col(doc_id).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("digest")).join(side, "digest", "left").select("doc_id", "digest", "license_id")


def sql() -> str:
    """The same in DuckDB SQL over the table documents, word by word."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    notice = f"regexp_matches(x, {quote(NOTICE_LINE)}) and not regexp_matches(x, {quote(ITEM_LINE)})"
    lines = f"list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)), lambda x: not ({notice}))"
    spelt = "case z " + " ".join(f"when {quote(a)} then {quote(b)}" for a, b in EQUIVALENT) + " else z end"
    pairs = [(*a.split(" "), b) for a, b in EQUIVALENT_PHRASES]
    joined = " ".join(f"when w[i] = {quote(x)} and w[i + 1] = {quote(y)} then {quote(b)} when w[i] = {quote(y)} and w[i - 1] = {quote(x)} then null" for x, y, b in pairs)
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known_texts())
    return f"""with t as (select 'known' as side, license_id as id, null as doc_id, text from (values {values}) as v(license_id, text) union all select 'doc', null, doc_id, text from documents),
 s as (select side, id, doc_id, list_transform(list_filter(string_split_regex(array_to_string({lines}, chr(10)), {quote(NOT_WORD)}), lambda z: z <> ''), lambda z: {spelt}) as w from t),
 c as (select side, id, doc_id, sha256(coalesce(array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case {joined} else w[i] end), lambda z: z is not null), ' '), '')) as digest from s),
 k as (select min(id) as license_id, digest from c where side = 'known' group by digest)
 select doc_id, digest, license_id from c left join k using (digest) where side = 'doc'"""
