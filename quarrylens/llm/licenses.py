"""License scans: MinHash bands of text windows retrieve license notices.

Words are runs of letters and digits in lower case; shingles are five words.

Retrieval. A text is cut into overlapping windows of ``WIDTH`` shingles, one
starting every ``STEP``. A window's signature holds ``BANDS * ROWS`` MinHash
values (the least hash under an exclusive or with a constant of its own); every
``ROWS`` values are a band. Templates are cut into overlapping runs of
``PROBE = WIDTH - STEP + 1`` shingles, so an occurrence of a run lies whole in
some window: their similarity is 9/12, and a band collides with probability
1 - (1 - 0.75^2)^20 = 1 - 6.5e-8. If the text lacks one shingle of the run, the
similarity is 8/13 and the probability 1 - 7.2e-5; if it lacks two, 1/2 and
1 - 3.2e-3. A template of which the text holds 0.8 has a run that lacks at most
two, and every one of its runs has a chance of its own. Templates too short for
a run have windows of one shingle, which are their own signature. Band keys are
made row by row in generated code, and only those of a template go on.

Verification. Where a template is retrieved, its containment is exact: windows
of ``WINDOW`` shingles start every ``WINDOW / 2``, templates are cut into parts
of at most ``WINDOW / 2``, and the containment is the sum over the parts of the
most shingles held in one window, over all the template's shingles. Rows with
at least ``THRESHOLD`` are returned.

Templates are a bounded list (``MOST_SHINGLES`` in all), known when the query
is planned; texts are never shuffled.

Defined cases: null, empty and short texts (under five words) match nothing;
repeated rows of one doc_id and text give one row per template, rows of one
doc_id with different texts the greatest containment; rows without doc_id are
left out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm._common import let, stored

WORDS, WINDOW, THRESHOLD = 5, 64, 0.8
WIDTH, STEP, BANDS, ROWS = 12, 4, 20, 2
PROBE = WIDTH - STEP + 1
MOST_SHINGLES = 100_000

# Public license notices.
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. " + _BSD_WARRANTY
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details. You should have received a copy of the GNU General Public License along with this program. If not, "
        "see <https://www.gnu.org/licenses/>."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
}


def shingles(text: Column) -> Column:
    """array<long>: hash of every five words, in text order."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))
    return let(words, lambda w: F.when(
        F.size(w) >= WORDS,
        F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])),
    ).otherwise(F.array().cast("array<bigint>")))


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A table of values known when the query is planned."""
    def value(x) -> str:
        if isinstance(x, list):
            return f"array({', '.join(map(value, x))})"
        return f"{x}L" if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    if not rows:
        raise ValueError("no templates")
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)} AS t({names})")


def band_keys(windows: DataFrame) -> DataFrame:
    """``windows`` (key columns, window: array<long>) with, for each of its
    bands, a row with the column ``key`` in place of the window."""
    draw = random.Random(2)
    masks = [[draw.getrandbits(64) - (1 << 63) for _ in range(ROWS)] for _ in range(BANDS)]
    bands = F.array(*[F.struct(F.lit(b).alias("b"), *[F.lit(m).alias(f"m{r}") for r, m in enumerate(of)]) for b, of in enumerate(masks)])
    others = [c for c in windows.columns if c != "window"]
    flat = windows.select(*others, *[F.get("window", F.lit(j)).alias(f"_{j}") for j in range(WIDTH)])
    each = flat.select("*", F.explode(bands).alias("band"))
    least = lambda r: F.least(*[F.col(f"_{j}").bitwiseXOR(F.col(f"band.m{r}")) for j in range(WIDTH)])
    return each.select(*others, F.xxhash64("band.b", *[least(r) for r in range(ROWS)]).alias("key"))


def template_shingles(spark: SparkSession, templates: dict[str, str]) -> dict[str, list[int]]:
    """The shingles of each template, in order."""
    table = _table(spark, list(templates.items()), "license_id, text")
    out = {r["license_id"]: r["shingles"] for r in table.select("license_id", shingles(F.col("text")).alias("shingles")).collect()}
    if sum(map(len, out.values())) > MOST_SHINGLES:
        raise ValueError("too many templates for one plan")
    return out


def retrieve(docs: DataFrame, templates: dict[str, list[int]]) -> DataFrame:
    """(doc_id, license_id) of the templates of at least one run that share a
    band with a window of the text. Small: a row where something is found."""
    spark = docs.sparkSession
    runs = [(name, s[at : at + PROBE]) for name, s in templates.items() if len(s) >= PROBE
            for at in sorted({*range(0, len(s) - PROBE, STEP), len(s) - PROBE})]
    if not runs:
        return docs.select("doc_id", F.lit("").alias("license_id")).where("false")
    keys = band_keys(_table(spark, runs, "license_id, window")).distinct()  # bounded by MOST_SHINGLES
    starts = lambda s: F.sequence(F.lit(0), F.floor((F.size(s) - 1) / STEP).cast("int"))
    cut = let(shingles(F.coalesce("text", F.lit(""))), lambda s: F.when(
        F.size(s) > 0, F.transform(starts(s), lambda i: F.slice(s, i * STEP + 1, F.lit(WIDTH)))))
    # explode_outer: no filter on the windows is planned below, which would compute them again
    found = band_keys(docs.select("doc_id", F.explode_outer(cut).alias("window"))).join(F.broadcast(keys), "key")
    return found.select("doc_id", "license_id").distinct()


def _windows_with(values: list[int]):
    """Of shingles: the windows that hold one of the values, array<struct<w,
    held>>."""
    half = WINDOW // 2

    def numbers(at: Column) -> Column:
        last = F.transform(at, lambda i: F.floor(i / half).cast("int"))
        before = F.transform(F.filter(at, lambda i: i >= half), lambda i: F.floor(i / half).cast("int") - 1)
        return F.array_distinct(F.concat(last, before))

    def windows(s: Column) -> Column:
        at = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i).isin(values)))
        return let(at, lambda a: F.transform(numbers(a), lambda w: F.struct(
            w.alias("w"), F.slice(s, w * half + 1, F.lit(WINDOW)).alias("held"))))

    return windows


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license_id, n_shingles, matched, containment) of the notices
    found in each document."""
    spark, half = docs.sparkSession, WINDOW // 2
    of = {name: s for name, s in template_shingles(spark, templates).items() if s}
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    values = sorted({x for s in of.values() for x in s})
    held = stored(rows.select("doc_id", F.explode_outer(let(shingles(F.coalesce("text", F.lit(""))), _windows_with(values))).alias("x"))
                  .where("x IS NOT NULL").select("doc_id", "x.held"), "license-windows")

    short = [(x, name) for name, s in of.items() if len(s) < PROBE for x in sorted(set(s))]
    found = retrieve(rows, of)
    if short:
        keys = F.broadcast(_table(spark, short, "key, license_id"))
        found = found.union(held.select("doc_id", F.explode("held").alias("key")).join(keys, "key").select("doc_id", "license_id")).distinct()

    parts = [(name, at // half, sorted(set(s[at : at + half]))) for name, s in of.items() for at in range(0, len(s), half)]
    table = F.broadcast(_table(spark, parts, "license_id, part, whole"))  # bounded by MOST_SHINGLES
    exact = held.join(found, "doc_id").join(table, "license_id").withColumn("matched", F.size(F.array_intersect("held", "whole")))
    best = exact.groupBy("doc_id", "license_id", "part").agg(F.max("matched").alias("matched"))
    sizes = _table(spark, [(name, sum(len(x) for n, _, x in parts if n == name)) for name in of], "license_id, n_shingles")
    total = best.groupBy("doc_id", "license_id").agg(F.sum("matched").alias("matched")).join(F.broadcast(sizes), "license_id")
    share = F.col("matched") / F.col("n_shingles")
    return total.select("doc_id", "license_id", "n_shingles", "matched", share.alias("containment")).where(
        F.col("containment") >= threshold)


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    half = WINDOW // 2

    def grams(source: str, key: str) -> str:
        return (f"SELECT {key}, unnest(range(0, greatest(len(a) - 4, 0))) AS i, "
                f"unnest(list_transform(range(1, greatest(len(a) - 3, 1)), lambda j: array_to_string(a[j:j + 4], ' '))) AS g FROM {source}")

    return f"""
WITH t(license_id, x) AS (VALUES {values}),
ta AS (SELECT license_id, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+') AS a FROM t),
tg AS (SELECT DISTINCT license_id, i // {half} AS part, g FROM ({grams('ta', 'license_id')})),
tn AS (SELECT license_id, count(*) AS n FROM tg GROUP BY license_id),
da AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS a FROM documents WHERE doc_id IS NOT NULL),
dg AS ({grams('da', 'doc_id')}),
m AS (SELECT doc_id, i, license_id, part, tg.g FROM dg JOIN tg ON dg.g = tg.g),
w AS (SELECT doc_id, i // {half} AS w, license_id, part, g FROM m UNION ALL SELECT doc_id, i // {half} - 1, license_id, part, g FROM m WHERE i >= {half}),
c AS (SELECT doc_id, w, license_id, part, count(DISTINCT g) AS k FROM w GROUP BY ALL),
b AS (SELECT doc_id, license_id, part, max(k) AS k FROM c GROUP BY ALL),
f AS (SELECT doc_id, license_id, sum(k)::BIGINT AS matched FROM b GROUP BY ALL)
SELECT doc_id, f.license_id, n AS n_shingles, matched, matched / n AS containment FROM f JOIN tn ON tn.license_id = f.license_id
WHERE matched / n >= {THRESHOLD}
"""


ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
