"""Licence scans by canonical digests of entire texts.

A text is brought to a canonical form: lower case, no copyright lines, punctuation and white
space as single blanks, one spelling of words that are spelled in several ways. Its SHA-256
is joined to the digests of known licences brought to the same form. A whole document is one
text, and so is each of its lines, which finds one-line notices. Only column functions.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import session
from provena.llm import common
from provena.sources.tables import literal

#: Spellings that licences treat as the same word, each one word for one.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("cancelled", "canceled"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("honour", "honor"), ("judgement", "judgment"), ("labour", "labor"), ("merchantibility", "merchantability"),
    ("organisation", "organization"), ("organisations", "organizations"), ("programme", "program"),
    ("recognised", "recognized"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("https", "http"),
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

#: Public licence texts and notices, each a whole text to match.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
     "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies. " + _AUTHOR),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AUTHOR),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION "
     "0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("FSFAP", "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided "
     "the copyright notice and this notice are preserved. This file is offered as-is, without any warranty."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
     'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License"),
}
#: The same texts below their title line.
KNOWN += tuple((i, f"{title}\n{text}") for i, text in KNOWN[:3] for title in _TITLES[i])


def _table() -> tuple[tuple[str, str], ...]:
    """Further whole licences and notices, a row for each text and what may stand before it."""
    rows = map(json.loads, Path(__file__).with_name("licenses.jsonl").read_text("utf-8").splitlines())
    return tuple((r["license_id"], f"{title}\n{r['text']}" if title else r["text"]) for r in rows for title in r["titles"])


KNOWN += _table()

#: A line that only states who holds the rights.
COPYRIGHT = r"(^|\n)[ \t]*(?:copyright (?:\(c\)|©|[0-9])|\(c\)|©|all rights reserved)[^\n]*"


def _worded(text: Column) -> Column:
    """Lower-case words between single blanks, one before and after, without copyright lines."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT, "$1")
    return F.regexp_replace(F.concat(F.lit(" "), bare, F.lit(" ")), r"[^a-z0-9\x{80}-\x{10FFFF}]+", " ")


def _count(worded: Column) -> Column:
    """How many words; the same in any spelling."""
    return F.length(worded) - F.length(F.replace(worded, F.lit(" "), F.lit(""))) - 1


def _spelled(words: Column) -> Column:
    # Blanks are doubled so that neighbours do not share the one between them.
    words = F.replace(words, F.lit(" "), F.lit("  "))
    for other, usual in SPELLINGS:
        words = F.replace(words, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(F.regexp_replace(words, " +", " "))


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    return _spelled(_worded(text))


def _digest(text: Column, counts: list[int]) -> Column:
    """The digest of the canonical form, null where no known text has as many words."""
    # Bound once: a filter and a projection would each work out the words.
    return F.transform(F.array(_worded(text)), lambda w: F.when(_count(w).isin(counts), F.sha2(_spelled(w), 256)))[0]


def digests(known: DataFrame) -> DataFrame:
    """license_id and digest of known texts; of licences with one digest the first stays."""
    form = canonical(F.col("text"))
    return known.where(form != "").groupBy(F.sha2(form, 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def built_in(spark: SparkSession) -> DataFrame:
    return literal(spark, list(KNOWN), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each whole document and each line that equals a known licence text.

    ``docs`` has doc_id and text, ``known`` license_id and text; further columns are not
    read. line_no is 0 for the whole text and else counts lines from 1; a one-line document
    is reported once, as the whole. Null and empty texts match nothing; repeated rows are
    reported as often as they stand. ``known`` is a list of licences: where they
    are counted as few, its digests are broadcast, else both sides are shuffled.
    """
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    lines = F.split("text", "\n", -1)
    whole = texts.select("doc_id", F.lit(0).alias("line_no"), F.col("text").alias("unit"))
    single = texts.where(F.contains("text", F.lit("\n"))).select("doc_id", F.posexplode(lines).alias("line_no", "unit"))
    single = single.select("doc_id", (F.col("line_no") + 1).alias("line_no"), "unit").where(F.trim("unit") != "")
    counts = [r[0] for r in known.where(F.col("text").isNotNull()).select(_count(_worded(F.col("text")))).distinct().collect()]
    found = whole.unionByName(single).select("doc_id", "line_no", _digest(F.col("unit"), counts).alias("digest"))
    table = common.sized(session.settle(digests(known), "license-digests"))
    return found.join(table, "digest").select("doc_id", "line_no", "license_id", "digest")
