"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams, all native.

Every line of a text, and the whole text, is a unit. Units and templates are normalised to lower-case words (letters and
digits), and a unit's distinct bigrams (as 64-bit hashes) meet those of a template only if the sizes allow the threshold:
2 * min(a, b) / (a + b) >= t. The templates are compiled into the projection, so the scan has no join and no shuffle.

Defined cases: null and empty texts and units of under two words have no bigrams and match nothing; a text of one line
gives a row as a line and one as a text; ties go to the template later in name order; null ids are carried; repeated
rows give repeated results; a very long text is scanned whole, in one task; an empty table gives an empty table; other columns,
whatever their names, are not read.

``scan_runs`` finds what is wrapped over lines or stands inside a longer text: for each template, the runs of adjacent lines
with the best coefficient. Texts that do not hold two thirds of a template's bigrams, which any match needs, are set aside by
intersections of arrays; in the rest every line with a bigram of the template is tried as the first of a run, and every later
line as the last. Its templates are those of ``scan`` and the full texts in the folder ``licences``.
Defined cases: runs of one template that overlap give the best of them (ties: the earliest); a run holds at most
twice the template's bigrams, repeats counted; otherwise as above.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import table

THRESHOLD = 0.8
_WORDS = r"[\p{L}\p{N}]+"

# Notices and texts of public licences.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-notice": "Licensed under the BSD License.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "public-domain-notice": "This work has been released into the public domain.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def _template_bigrams(text: str) -> list[tuple[str, str]]:
    import re

    words = re.findall(r"[^\W_]+", text.lower())
    return sorted(set(zip(words, words[1:], strict=False)))


def _matches(bigrams: Column, threshold: float, templates: dict[str, str]) -> Column:
    """At most one (dice, template, template_bigrams): the best of a unit's distinct bigrams, at or over the threshold."""
    n = F.size(bigrams)
    tried = []
    for name, text in sorted(templates.items()):
        own = _template_bigrams(text)
        fits = 2 * F.least(n, F.lit(len(own))) >= threshold * (n + len(own))
        dice = 2.0 * F.size(F.array_intersect(bigrams, F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in own]))) / (n + len(own))
        tried.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(name).alias("template"), F.lit(len(own)).alias("template_bigrams"))))
    found = F.filter(F.array(*tried), lambda x: x.isNotNull() & (x["dice"] >= threshold))
    return F.slice(F.sort_array(found, asc=False), 1, 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each unit that matches: doc_id, unit ('line' or 'text'), line (0-based; -1 for a text), template, dice, n_bigrams, template_bigrams.

    Rows are dropped by explode and not by filters, which the optimizer would push down and so evaluate twice.
    """
    templates = templates or TEMPLATES
    least = min(len(_template_bigrams(t)) for t in templates.values()) * threshold / (2 - threshold)
    words = F.transform(F.split(F.lower(text), "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(_WORDS), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("l"))
    large = lambda w: F.size(w) - 1 >= least
    lines = F.filter(F.transform("l", lambda w, i: F.struct(i.cast("long").alias("line"), w.alias("w"))), lambda u: large(u["w"]))
    whole = F.filter(F.array(F.struct(F.lit(-1).cast("long").alias("line"), F.flatten("l").alias("w"))), lambda u: large(u["w"]))
    units = rows.select("doc_id", F.explode(F.concat(lines, whole)).alias("u")).select("doc_id", "u.*")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.xxhash64(a, b))
    units = units.select("doc_id", "line", F.array_distinct(pairs).alias("b"))
    units = units.select("doc_id", "line", F.size("b").cast("long").alias("n_bigrams"), F.explode(_matches(F.col("b"), threshold, templates)).alias("m"))
    unit = F.when(F.col("line") < 0, "text").otherwise("line").alias("unit")
    return units.select("doc_id", unit, "line", "m.template", "m.dice", "n_bigrams", F.col("m.template_bigrams").cast("long").alias("template_bigrams"))


def full_texts() -> dict[str, str]:
    """Whole licences by name, as published."""
    return {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _longs(values) -> str:
    return f"array({', '.join(f'{x}L' if x > -(2**63) else 'bigint(-9223372036854775808)' for x in values)})"


def _best_end(start: Column) -> Column:
    """The run from a start (line, k) with the best coefficient: at each line's last word, over the bigrams not met since k."""
    ln, t = F.col("ln"), F.col("t")
    part = F.slice("pos", start["k"] + 1, F.least(2 * t["words"], F.size("pos") - start["k"]))
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("h"), F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("last"), F.lit(0).alias("n")).alias("best"))

    def step(s: Column, x: Column) -> Column:
        new = (x["prev"] < start["k"]).cast("int")
        a, h = s["a"] + new, s["h"] + new * x["hit"]
        dice = 2.0 * h / (a + t["n"])
        ends = F.coalesce(F.get(ln, x["k"] + 2) != F.get(ln, x["k"] + 1), F.lit(True))
        best = F.when(ends & ((dice > s["best"]["dice"]) | ((dice == s["best"]["dice"]) & (x["hit"] == 1))), F.struct(dice.alias("dice"), F.get(ln, x["k"] + 1).alias("last"), a.alias("n"))).otherwise(s["best"])
        return F.struct(a.alias("a"), h.alias("h"), best.alias("best"))

    return F.aggregate(part, zero, step, lambda s: F.struct(s["best"]["dice"].alias("dice"), (-start["line"]).alias("back"), s["best"]["last"].alias("last"), s["best"]["n"].alias("n")))


def scan_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each run of lines that matches: doc_id, line, last_line (0-based), template, dice, n_bigrams, template_bigrams."""
    templates = templates or TEMPLATES | full_texts()
    extract = lambda x: F.regexp_extract_all(F.lower(x), F.lit(_WORDS), F.lit(0))
    own = docs.sparkSession.range(1).select(*[_pairs(extract(F.lit(x))).alias(f"c{i}") for i, x in enumerate(templates.values())]).first()
    share = threshold / (2 - threshold)  # of a template's bigrams, the least that a match holds
    rows = [(name, len(b), sorted(set(b))) for name, b in zip(templates, own, strict=True)]
    # two groups, so that few texts meet the many bigrams of whole licences
    groups = [[r for r in rows if (len(r[2]) > 400) == large] for large in (False, True)]
    tables, unions = [], []
    for g in groups:
        made = ", ".join(f"struct('{name}' AS name, {words} AS words, {len(b)} AS n, {_longs(b)} AS b)" for name, words, b in g)
        tables.append(F.expr(f"array({made})") if g else None)
        unions.append((min((len(b) for _, _, b in g), default=0) * share, F.expr(_longs(sorted({x for r in g for x in r[2]}))) if g else None))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), extract).alias("l"))
    lines = lines.select("doc_id", "l", _pairs(F.flatten("l")).alias("b"))
    met = [F.when(F.size("b") >= least, F.array_intersect("b", u)).alias(f"h{i}") for i, (least, u) in enumerate(unions) if u is not None]
    lines = lines.select("doc_id", "l", "b", *met)
    holds = lambda h: lambda t: (F.size(h) >= share * t["n"]) & (F.size(F.array_intersect(h, t["b"])) >= share * t["n"])
    likely = [F.filter(made, holds(F.col(f"h{i}"))) for i, made in enumerate(tables) if made is not None]
    likely = lines.select("doc_id", "l", "b", F.explode(F.concat(*likely)).alias("t"))
    ln = F.flatten(F.transform("l", lambda x, i: F.array_repeat(i, F.size(x))))
    order = F.array_sort(F.transform("b", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    likely = likely.select("doc_id", "t", ln.alias("ln"), F.array_intersect("b", F.col("t")["b"]).alias("hits"), order.alias("o"))
    before = lambda i: F.get(F.col("o"), i - 1)
    pos = F.transform(
        "o",
        lambda x, i: F.struct(
            x["k"].alias("k"), F.when(before(i)["h"] == x["h"], before(i)["k"]).otherwise(-1).alias("prev"), F.array_contains("hits", x["h"]).cast("int").alias("hit")
        ),
    )
    likely = likely.select("doc_id", "t", "ln", F.array_sort(pos).alias("pos"))
    firsts = F.filter(F.transform("ln", lambda x, k: F.struct(x.alias("line"), k.alias("k"))), lambda s: (s["k"] == 0) | (F.get(F.col("ln"), s["k"] - 1) != s["line"]))
    touched = F.array_distinct(F.transform(F.filter("pos", lambda x: x["hit"] == 1), lambda x: F.get(F.col("ln"), x["k"])))
    likely = likely.select("doc_id", "t", "ln", "pos", firsts.alias("firsts"), touched.alias("touched"))
    starts = F.filter("firsts", lambda s: F.array_contains("touched", s["line"]))
    likely = likely.select("doc_id", "t", F.transform(starts, _best_end).alias("runs"))
    likely = likely.select("doc_id", "t", F.sort_array(F.filter("runs", lambda r: r["dice"] >= threshold), asc=False).alias("runs"))
    apart = F.aggregate(
        "runs", F.slice("runs", 1, 0), lambda got, x: F.when(F.exists(got, lambda y: (-y["back"] <= x["last"]) & (-x["back"] <= y["last"])), got).otherwise(F.concat(got, F.array(x)))
    )
    found = likely.select("doc_id", F.col("t.name").alias("template"), F.col("t.n").alias("size"), F.explode(apart).alias("r"))
    return found.select(
        "doc_id", (-F.col("r.back")).cast("long").alias("line"), F.col("r.last").cast("long").alias("last_line"), "template", "r.dice",
        F.col("r.n").cast("long").alias("n_bigrams"), F.col("size").cast("long").alias("template_bigrams"),
    )


def query_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_runs(table(spark, sf_dir, "documents"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    rows = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{a} {b}'" for a, b in _template_bigrams(text))) for name, text in sorted(TEMPLATES.items()))
    return rf"""
WITH tpl(template, tb) AS (VALUES {rows}),
u AS (SELECT doc_id, 'line' AS unit, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 'text', -1, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unit, line, regexp_extract_all(lower(t), '{_WORDS}') AS w FROM u),
b AS (SELECT doc_id, unit, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
s AS (SELECT doc_id, unit, line, template, len(b)::BIGINT AS n_bigrams, len(tb)::BIGINT AS template_bigrams,
             (2.0::DOUBLE * len(list_intersect(b, tb))) / (len(b) + len(tb)) AS dice
      FROM b JOIN tpl ON 2 * least(len(b), len(tb)) >= {THRESHOLD} * (len(b) + len(tb)))
SELECT doc_id, unit, line::BIGINT AS line, template, dice, n_bigrams, template_bigrams FROM s WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, line ORDER BY dice DESC, template DESC) = 1"""
