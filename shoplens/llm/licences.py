"""Licence scan by canonical digest lookup, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal.
EQUIVALENTS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"),
    ("version 3 0", "version 3"), ("https", "http"),
)
# Patterns of a line that only says who holds the rights.
RIGHTS_LINE = r"^[^\p{L}\p{N}]*(copyright[^\p{L}\p{N}]*(\(c\)|©|[0-9]{4})|\(c\)[^\p{L}\p{N}]*[0-9]{4}|©|all rights reserved).*$"
NO_WORD = r"[^\p{L}\p{N}]+"

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO'
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
    " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS"
    " IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER"
    " IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE"
    " USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Licence texts and the one-line notices that stand for a licence.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n" + _MIT_GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
     " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
     + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
     " hereby granted.\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
)


def canonical_line(line: Column) -> Column:
    """Lower case, no rights line, words joined by one space, one spelling of each word."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), RIGHTS_LINE, ""), NO_WORD, " "))
    for other, chosen in EQUIVALENTS:
        words = F.replace(words, F.lit(other), F.lit(chosen))
    return words


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\r\n|\r|\n"), canonical_line), lambda x: x != "")


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``digest``, ``licence`` of the known texts; of equal texts, the first name."""
    texts = spark.createDataFrame(list(known), "licence string, body string")
    digest = F.sha2(F.array_join(canonical_lines(F.col("body")), " "), 256)
    return texts.groupBy(digest.alias("digest")).agg(F.min("licence").alias("licence"))


def scan_licences(
    docs: DataFrame, id: str = "doc_id", text: str = "text", known: tuple[tuple[str, str], ...] = KNOWN
) -> DataFrame:
    """Licences of every row's whole text and of its single lines.

    Returns ``id``, text_digest (SHA-256 of the canonical text), licence (of the known
    text with that digest, null if none) and line_licences (sorted names of the known
    notices that a line of the text equals, joined by commas; empty if none).
    A null text is an empty text and has no licence. Every row gives one row, repeated
    ones too; no row is shuffled. The join's small side has a row per known text.
    """
    # As bounded as the list of known texts, so a literal: lines are looked up without a join of their own.
    digests = known_digests(docs.sparkSession, known).collect()
    lookup = F.create_map(*(F.lit(x) for row in digests for x in row))
    pairs = docs.sparkSession.createDataFrame(digests, "digest string, licence string")
    lines = docs.select(F.col(id), canonical_lines(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_lines"))
    found = F.filter(F.transform("_lines", lambda x: lookup[F.sha2(x, 256)]), lambda x: x.isNotNull())
    named = lines.select(
        id,
        F.sha2(F.array_join("_lines", " "), 256).alias("text_digest"),
        F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("line_licences"),
    )
    return named.join(F.broadcast(pairs), named.text_digest == pairs.digest, "left").select(
        id, "text_digest", "licence", "line_licences"
    )
