"""Licence scans: normalised passages compared with licence templates by Dice over word bigrams.

DataFrame functions only, and no shuffle: every step is a projection or filter of one scan. A passage is
the whole text (passage 0) or one of its lines (passages 1, 2, ... where there are several). With
a and b distinct bigrams and s shared ones, Dice = 2s / (a + b); as s <= min(a, b), only sizes from
t / (2 - t) b to (2 - t) / t b can reach t, and a passage without any template bigram cannot match.
Templates are literals of the plan: a parameter of bounded size, not data.

Defined results: null and empty texts, and passages of fewer than two words, match nothing; every template
at or above the threshold is returned, ties included; repeated rows give repeated results; other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.registry import register, table

THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Usual licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "MIT notice": "Released under the MIT License",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0",
    "CC-BY-4.0 long notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0 notice": "To the extent possible under law, the author has dedicated all copyright and related and "
    "neighboring rights to this work to the public domain worldwide",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
    "specific language governing permissions and limitations under the License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
    "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
    "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _once(value: Column) -> Column:
    """The value as a generated column: filters above are not pushed below it, which would compute it again for each."""
    return F.explode(F.array(value))


def license_matches(
    documents: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    text: str = "text",
    id_: str = "doc_id",
) -> DataFrame:
    """doc_id, passage, license, n_passage, n_template, n_shared and dice of every match."""
    known = {n: b for n, t in (TEMPLATES if templates is None else templates).items() if (b := template_bigrams(t))}
    low = {n: math.ceil(threshold / (2 - threshold) * len(b) - 1e-9) for n, b in known.items()}
    high = {n: math.floor((2 - threshold) / threshold * len(b) + 1e-9) for n, b in known.items()}
    body = F.translate(F.col(text), UPPER, LOWER)
    lines = F.when(F.instr(body, "\n") > 0, F.split(body, "\n"))
    passages = documents.where(F.col(text).isNotNull()).select(
        F.col(id_).alias("doc_id"), F.posexplode(F.concat(F.array(body), F.coalesce(lines, F.array()))).alias("passage", "_p")
    )
    words = passages.select("doc_id", "passage", _once(F.regexp_extract_all("_p", F.lit(WORD), F.lit(0))).alias("_w"))
    least, most = min(low.values(), default=1), max(high.values(), default=0)
    words = words.where(F.size("_w") > least)  # n words hold fewer than n bigrams
    n = F.greatest(F.size("_w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = words.select("doc_id", "passage", _once(F.array_distinct(pairs)).alias("_b"))
    every = _strings(sorted({g for b in known.values() for g in b}))
    near = grams.where(F.size("_b").between(least, most)).where(F.arrays_overlap("_b", every))
    tried = F.array(
        *[
            F.when(
                F.size("_b").between(low[n], high[n]),
                F.struct(F.lit(n).alias("license"), F.lit(len(b)).alias("n_template"), F.size(F.array_intersect("_b", _strings(b))).alias("n_shared")),
            )
            for n, b in known.items()
        ]
    )
    tried = near.select("doc_id", "passage", F.size("_b").alias("n_passage"), F.explode(F.array_compact(tried)).alias("_t"))
    return (
        tried.select("doc_id", "passage", "_t.license", "n_passage", "_t.n_template", "_t.n_shared")
        .withColumn("dice", 2.0 * F.col("n_shared") / (F.col("n_passage") + F.col("n_template")))
        .where(F.col("dice") >= threshold)
    )


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''")) for n, t in TEMPLATES.items())
    words = rf"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '{WORD}')"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH t AS (SELECT n AS license, {words.format("x")} AS w FROM (VALUES {quoted}) AS v(n, x)),
tb AS (SELECT license, {grams.format("w")} AS tb FROM t),
p AS (SELECT doc_id, 0 AS passage, text AS x FROM documents WHERE text IS NOT NULL
      UNION ALL
      SELECT doc_id, unnest(range(1, len(l) + 1)) AS passage, unnest(l) AS x
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE contains(text, chr(10)))),
w AS (SELECT doc_id, passage, {words.format("x")} AS w FROM p),
b AS (SELECT doc_id, passage, {grams.format("w")} AS b FROM w WHERE len(w) >= 2),
m AS (SELECT doc_id, passage, license, len(b) AS n_passage, len(tb) AS n_template, len(list_intersect(b, tb)) AS n_shared FROM b, tb)
SELECT doc_id, CAST(passage AS INTEGER) AS passage, license, CAST(n_passage AS INTEGER) AS n_passage,
       CAST(n_template AS INTEGER) AS n_template, CAST(n_shared AS INTEGER) AS n_shared,
       2.0::DOUBLE * n_shared / (n_passage + n_template) AS dice
FROM m WHERE 2.0::DOUBLE * n_shared / (n_passage + n_template) >= {THRESHOLD}::DOUBLE
"""


@register("op6_license_scan", _sql())
def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents").select("doc_id", "text"))
