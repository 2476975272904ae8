"""Licence scan: Dice coefficient of word bigrams against templates, in DataFrame operations.

A text is compared as a whole, by paragraph, by line and by runs of neighbouring lines. A unit and
a template that differ too much in size cannot reach the threshold, so a template is only compared
with units inside its size bounds, and with those that hold enough bigrams of any template. Runs are
cut for a template only in texts that hold enough of its bigrams. All happens inside a row: nothing
is shuffled or exploded.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, text_of

THRESHOLD = 0.8

#: Notices and texts of licences.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "CC0-1.0": "Licensed under CC0 1.0 Universal",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0",
    "ISC": "Licensed under the ISC License",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "proprietary": "All rights reserved",
}
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not
use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under
the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no
event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an acknowledgment
in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v.
2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone
is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means. In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met: 1. Redistributions of
source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
OF SUCH DAMAGE.""",
}
#: What the BSD licence of three clauses says more, before its disclaimer.
THIRD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written
permission. """


def templates() -> list[tuple[str, str]]:
    """(licence, template): the fixed ones, and families of notices made by rule."""
    made = [*NOTICES.items(), *TEXTS.items()]
    made += [
        (name, text.replace(*change))
        for name, text in NOTICES.items()
        for change in (("Licensed", "Released"), ("Released", "Licensed"))
        if change[0] in text
    ]
    for version in ("3.0", "4.0"):
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
            made.append((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}"))
    for family, name in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")):
        for version in ("2", "2.1", "3"):
            if (family, version) in (("GPL", "2.1"), ("AGPL", "2"), ("AGPL", "2.1")):
                continue
            text = f"This work is licensed under the GNU {name}General Public License, version "
            licence = f"{family}-{version if '.' in version else version + '.0'}"
            made.append((licence, text + version))
            if licence != "GPL-3.0":
                notice = TEXTS["GPL-3.0"].replace("GNU General", f"GNU {name}General")
                made.append((licence, notice.replace("version 3", f"version {version}")))
    two = TEXTS["BSD-2-Clause"]
    made.append(("BSD-3-Clause", two.replace("THIS SOFTWARE", THIRD_CLAUSE + "THIS SOFTWARE", 1)))
    return sorted(made)


def words_of(text: str) -> list[str]:
    """Runs of a-z and 0-9 after A-Z in lower case: how templates and texts are normalised."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return "".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in low).split()


def bigrams_of(words: list[str]) -> list[str]:
    """Distinct neighbouring pairs of words; a single word stands for itself."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]  # noqa: B905
    return sorted(set(pairs or words))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes that a set may have for its Dice coefficient with one of ``size`` to be reached."""
    slack = 1e-9
    low = ceil(size * threshold / (2 - threshold) - slack)
    return max(low, 1), floor(size * (2 - threshold) / threshold + slack)


def _compared(threshold: float) -> list[tuple[str, list[str], int, int]]:
    """(licence, bigrams, least and most bigrams of a unit) of each template."""
    made = []
    for name, text in templates():
        pairs = bigrams_of(words_of(text))
        made.append((name, pairs, *size_bounds(len(pairs), threshold)))
    return made


def least_shared(size: int, threshold: float) -> int:
    """Bigrams of a template of ``size`` that whatever reaches the threshold has at least."""
    return max(ceil(size * threshold / (2 - threshold) - 1e-9), 1)


def most_words(template: str, threshold: float) -> int:
    """Words that a run of lines may have for a template."""
    return size_bounds(len(words_of(template)), threshold)[1]


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_distinct(F.when(n > 1, pairs).otherwise(words))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _near(threshold: float) -> Column:
    """The templates of which ``shared``, the template bigrams of the whole text, holds enough."""
    known = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(-rank).alias("rank"),
                F.array(*map(F.lit, bigrams_of(words_of(text)))).alias("pairs"),
                F.lit(least_shared(len(bigrams_of(words_of(text))), threshold)).alias("need"),
                F.lit(most_words(text, threshold)).alias("words"),
            )
            for rank, (name, text) in enumerate(templates())
        ]
    )
    return F.filter(
        known,
        lambda t: (F.size("shared") >= t["need"]) & (_shared(F.col("shared"), t["pairs"]) >= t["need"]),
    )


def _runs(threshold: float) -> Column:
    """The runs of ``lines`` (words) that reach the threshold: dice, rank, name, start, end.

    For every template in ``near`` and every first line the best run.
    """

    def scored(t: Column, a: Column, z: Column) -> Column:
        words = F.flatten(F.slice("lines", a, z - a + 1))
        unit = F.when(F.size(words) <= t["words"], _bigrams(words))
        return F.transform(
            F.array(unit),
            lambda u: F.when(
                u.isNotNull(),
                F.struct(
                    (F.lit(2.0) * _shared(u, t["pairs"]) / (F.size(u) + F.size(t["pairs"]))).alias("dice"),
                    t["rank"].alias("rank"),
                    t["name"].alias("name"),
                    a.alias("start"),
                    z.alias("end"),
                ),
            ),
        )[0]

    def of_template(t: Column) -> Column:
        own = F.filter(
            F.when(F.size("lines") > 1, F.sequence(F.lit(1), F.size("lines"))),
            lambda i: F.exists(
                F.array(_bigrams(F.element_at("lines", i))),
                lambda b: 2 * _shared(b, t["pairs"]) >= F.size(b),
            ),
        )
        # A run has no more lines than words, so no more of these lines either.
        return F.flatten(
            F.transform(
                F.array(own),
                lambda ends: F.transform(
                    ends,
                    lambda a, k: F.array_max(
                        F.transform(
                            F.filter(
                                F.slice(ends, k + 2, t["words"]), lambda z: z - a < t["words"]
                            ),
                            lambda z: scored(t, a, z),
                        )
                    ),
                ),
            )
        )

    found = F.filter(
        F.flatten(F.transform("near", of_template)),
        lambda r: r.isNotNull() & (r["dice"] >= threshold),
    )
    return F.coalesce(found, F.expr("array()").cast(
        "array<struct<dice:double,rank:int,name:string,start:int,end:int>>"
    ))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, licenses, n_units, best_license and best_dice for every row of ``docs``.

    ``licenses`` lists the licences found, sorted, with commas between; ``n_units`` counts the
    different units (whole text, paragraphs, lines, as normalised) that reach the threshold;
    each counts for its best template, ties to the first name. Besides, a licence is found in a
    run of lines that begins and ends with a line of which at least half the bigrams are the
    template's, blank lines left out, and that has no more words than its size bounds allow; a
    run counts unless a better one, by Dice and then by name, shares a line with it. A null or
    empty text has none: an empty list, 0 and nulls. Repeated rows are scanned each; an empty
    table gives no rows.
    """
    compared = _compared(threshold)
    least, most = min(c[2] for c in compared), max(c[3] for c in compared)
    known = sorted({p for c in compared for p in c[1]})

    kept = F.regexp_replace(lowered(text_of(text_col)), r"[^a-z0-9\n]+", " ")
    flat = F.trim(F.regexp_replace("kept", r"[ \n]+", " "))
    paragraphs = F.transform(
        F.split("kept", r"\n ?\n[ \n]*"), lambda p: F.trim(F.regexp_replace(p, r"[ \n]+", " "))
    )
    lines = F.transform(F.split("kept", r"\n"), lambda u: F.trim(u))
    rows = docs.select(F.col(id_col).alias("doc_id"), kept.alias("kept")).select(
        "doc_id",
        F.filter(lines, lambda u: u != "").alias("lines"),
        F.array_distinct(F.concat(F.array(flat), paragraphs, lines)).alias("units"),
    )
    # A unit of n words has n - 1 spaces and at most n - 1 different bigrams.
    split = F.transform("units", lambda u: F.split(u, " "))
    long_enough = F.filter(split, lambda w: (F.size(w) > least) | (F.lit(least == 1)))
    rows = rows.select("doc_id", "lines", F.transform(long_enough, _bigrams).alias("units"))
    # What a unit shares with any template bounds what it shares with one. The whole text is the
    # first unit; where it is too short, so are all.
    rows = rows.select(
        "doc_id",
        "lines",
        F.filter(F.get("units", F.lit(0)), lambda b: b.isin(known)).alias("shared"),
        F.transform(
            F.filter("units", lambda b: F.size(b).between(least, most)),
            lambda b: F.struct(
                F.size(b).alias("size"), F.filter(b, lambda x: x.isin(known)).alias("shared")
            ),
        ).alias("units"),
    )
    rows = rows.select(
        "doc_id",
        "lines",
        F.when(F.size("shared") >= least, _near(threshold)).alias("near"),
        F.filter("units", lambda u: F.size(u["shared"]) >= least).alias("units"),
    )
    # Only texts near a template have their lines cut into words.
    near_lines = F.transform("lines", lambda u: F.split(u, " "))
    rows = rows.select(
        "doc_id", "units", "near", F.when(F.size("near") > 0, near_lines).alias("lines")
    )
    rows = rows.select(
        "doc_id", "units", F.when(F.size("near") > 0, _runs(threshold)).alias("runs")
    )

    def best(unit: Column) -> Column:
        found = []
        for rank, (name, pairs, low, high) in enumerate(compared):
            both = _shared(unit["shared"], F.array(*map(F.lit, pairs)))
            dice = F.lit(2.0) * both / (unit["size"] + F.lit(len(pairs)))
            found.append(
                F.when(
                    unit["size"].between(low, high)
                    & (F.size(unit["shared"]) >= least_shared(len(pairs), threshold)),
                    F.struct(dice.alias("dice"), F.lit(-rank).alias("rank"), F.lit(name).alias("name")),
                )
            )
        return F.greatest(*found) if len(found) > 1 else found[0]

    found = F.filter(
        F.transform("units", best), lambda b: b.isNotNull() & (b["dice"] >= threshold)
    )
    beaten = F.filter(
        "runs",
        lambda r: ~F.exists(
            "runs",
            lambda o: (o["start"] <= r["end"])
            & (o["end"] >= r["start"])
            & ((o["dice"] > r["dice"]) | (o["dice"] == r["dice"]) & (o["rank"] > r["rank"])),
        ),
    )
    in_runs = F.transform(beaten, lambda r: F.struct(r["dice"], r["rank"], r["name"]))
    none = F.expr("array()").cast("array<struct<dice:double,rank:int,name:string>>")
    rows = rows.select("doc_id", found.alias("found"), F.coalesce(in_runs, none).alias("in_runs"))
    rows = rows.select("doc_id", "found", F.concat("found", "in_runs").alias("all_found"))
    top = F.array_max("all_found")
    names = F.transform("all_found", lambda b: b["name"])
    return rows.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licenses"),
        F.size("found").cast("long").alias("n_units"),
        top["name"].alias("best_license"),
        top["dice"].alias("best_dice"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same scan as DuckDB SQL, without bounds on what is shared: all templates against all
    units, and all runs of lines from a table of lines."""
    texts = templates()
    rows = ", ".join(
        f"({rank}, '{name}', {most_words(texts[rank][1], threshold)}, "
        f"[{', '.join(repr(p) for p in pairs)}])"
        for rank, (name, pairs, _, _) in enumerate(_compared(threshold))
    )
    bigrams = """list_distinct(CASE WHEN len(w) > 1 THEN
               list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE w END)"""
    return rf"""
    WITH templates(rank, name, words, pairs) AS (VALUES {rows}),
    kept AS (
      SELECT row_number() OVER () AS row, doc_id,
             regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'),
                            '[^a-z0-9\n]+', ' ', 'g') AS kept
      FROM documents),
    units AS (
      SELECT row, unnest(list_distinct(list_transform(
               list_concat([kept], regexp_split_to_array(kept, '\n ?\n[ \n]*'),
                           regexp_split_to_array(kept, '\n')),
               lambda u: trim(regexp_replace(u, '[ \n]+', ' ', 'g'))))) AS unit
      FROM kept),
    words AS (SELECT row, unit, string_split(unit, ' ') AS w FROM units),
    pairs AS (SELECT row, unit, {bigrams} AS b FROM words),
    scored AS (
      SELECT row, unit, name, rank,
             2.0 * len(list_intersect(b, templates.pairs)) / (len(b) + len(templates.pairs)) AS dice
      FROM pairs, templates),
    best AS (
      SELECT * FROM scored WHERE dice >= {threshold}
      QUALIFY row_number() OVER (PARTITION BY row, unit ORDER BY dice DESC, rank) = 1),
    split AS (
      SELECT row, list_filter(list_transform(regexp_split_to_array(kept, '\n'),
               lambda u: trim(u)), lambda u: u <> '') AS l
      FROM kept),
    lines AS (
      SELECT row, pos, string_split(l[pos], ' ') AS w
      FROM (SELECT row, l, unnest(range(1, len(l) + 1)) AS pos FROM split)),
    ends AS (
      SELECT row, pos, rank, name, words, t.pairs
      FROM (SELECT row, pos, {bigrams} AS b FROM lines) l, templates t
      WHERE 2 * len(list_intersect(b, t.pairs)) >= len(b)),
    spans AS (
      SELECT a.row, a.rank, a.pos AS first, z.pos AS last, any_value(a.name) AS name,
             any_value(a.pairs) AS pairs, flatten(list(l.w ORDER BY l.pos)) AS w
      FROM ends a JOIN ends z ON z.row = a.row AND z.rank = a.rank
           AND z.pos > a.pos AND z.pos < a.pos + a.words
      JOIN lines l ON l.row = a.row AND l.pos BETWEEN a.pos AND z.pos
      GROUP BY a.row, a.rank, a.pos, z.pos
      HAVING sum(len(l.w)) <= any_value(a.words)),
    runs AS (
      SELECT row, rank, name, first, last,
             2.0 * len(list_intersect(b, pairs)) / (len(b) + len(pairs)) AS dice
      FROM (SELECT *, {bigrams} AS b FROM spans)),
    good AS (SELECT * FROM runs WHERE dice >= {threshold}),
    unbeaten AS (
      SELECT * FROM good r WHERE NOT EXISTS (
        FROM good o WHERE o.row = r.row AND o.first <= r.last AND o.last >= r.first
          AND (o.dice > r.dice OR o.dice = r.dice AND o.rank < r.rank))),
    every AS (
      SELECT row, name, rank, dice, 1 AS unit FROM best
      UNION ALL SELECT row, name, rank, dice, 0 FROM unbeaten),
    found AS (
      SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
             sum(unit)::BIGINT AS n_units,
             arg_max(name, struct_pack(d := dice, r := -rank)) AS best_license,
             max(dice) AS best_dice
      FROM every GROUP BY row)
    SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_units, 0) AS n_units,
           best_license, best_dice
    FROM kept LEFT JOIN found USING (row)
    """
