import textwrap

import duckdb
import odd
import pyarrow as pa
from tabsonde.llm import licenses
from tabsonde.llm.licenses import TEXTS, bigrams_of, scan_licenses, size_bounds, words_of


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in scan_licenses(df).orderBy("doc_id").collect()]


def brute(text):
    """All templates against all units, without bounds."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    units = {" ".join(words_of(low))}
    paragraph = []
    for line in [*low.split("\n"), ""]:
        units.add(" ".join(words_of(line)))
        if any(c not in " \t" for c in "".join(c if c.isascii() and c.isalnum() else " " for c in line)):
            paragraph.append(line)
        else:
            units.add(" ".join(words_of(" ".join(paragraph))))
            paragraph = []
    best = []
    for unit in units - {""}:
        have = set(bigrams_of(unit.split()))
        scored = []
        for rank, (name, template) in enumerate(licenses.templates()):
            want = set(bigrams_of(words_of(template)))
            dice = 2.0 * len(have & want) / (len(have) + len(want))
            if dice >= 0.8:
                scored.append((dice, -rank, name))
        if scored:
            best.append(max(scored))
    every = best + runs(low)
    names = ",".join(sorted({b[2] for b in every}))
    top = max(every, default=(None, 0, None))
    return names, len(best), top[2], top[0]


def runs(low):
    """Every run of lines with every template; those that no better one shares a line with."""
    lines = [w for w in map(words_of, low.split("\n")) if w]
    good = []
    for rank, (name, template) in enumerate(licenses.templates()):
        want = set(bigrams_of(words_of(template)))
        most = size_bounds(len(words_of(template)), 0.8)[1]
        ends = [k for k, w in enumerate(lines) if 2 * len(want & set(bigrams_of(w))) >= len(bigrams_of(w))]
        for a in ends:
            for z in ends:
                words = sum(lines[a : z + 1], [])
                if z <= a or len(words) > most:
                    continue
                have = set(bigrams_of(words))
                dice = 2.0 * len(have & want) / (len(have) + len(want))
                if dice >= 0.8:
                    good.append((dice, -rank, name, a, z))
    return [
        r[:3] for r in good if not any(o[3] <= r[4] and o[4] >= r[3] and o[:2] > r[:2] for o in good)
    ]


TEXTS_TO_SCAN = [
    "Words before.\nReleased under the MIT License.\nWords after.",
    "Licensed under CC BY-NC 4.0.",
    "licensed under cc by-nc-sa 3.0",
    "This work is licensed under the GNU General Public License, version 3.\nmore",
    "This work is licensed under the GNU General Public License, version 2.\nmore",
    "All rights reserved.",
    "We reserved all rights to a table.",
    "A text about licences, without any.",
    TEXTS["MIT"],
    "Title\n\n" + TEXTS["ISC"] + "\n\nA story follows here.",
    "prefix words " + TEXTS["MIT"].replace("software", "program") + " and a few more words",
    "Code under\n\n" + TEXTS["Apache-2.0"] + "\n\nReleased under the MIT License",
    TEXTS["Zlib"].upper().replace(" ", "  "),
    None, "", "\n\n \n", "one", "x y", odd.LONG + "\nAll rights reserved",
]


def wrapped(text, width=60):
    return "\n".join(textwrap.wrap(text, width))


STORY = "A long story of many lines follows here\nand goes on for a while\n"
MIT = TEXTS["MIT"].replace("\n", " ")
MIT_PARAGRAPHS = "\n\n".join(
    map(wrapped, MIT.replace(": The", ":\nThe").replace("Software. THE", "Software.\nTHE").split("\n"))
)
GPL = "\n\n".join(map(wrapped, TEXTS["GPL-3.0"].replace("\n", " ").replace(". This", ".\nThis").split("\n")))
BSD3 = dict(t for t in licenses.templates() if t[0] == "BSD-3-Clause" and len(t[1]) > 200)["BSD-3-Clause"]
RUNS = [
    (STORY * 9 + MIT_PARAGRAPHS + "\n" + STORY * 9, "MIT"),
    (STORY + GPL + "\n\nint main() { return 0; }\n" + STORY, "GPL-3.0"),
    (STORY + GPL.replace("version 3", "version 2") + "\ncode\n", "GPL-2.0"),
    (STORY + GPL.replace("GNU General", "GNU Affero General") + "\ncode\n", "AGPL-3.0"),
    ("# " + "\n# ".join(wrapped(BSD3.replace("\n", " ")).split("\n")) + "\nimport os\n", "BSD-3-Clause"),
    (STORY + wrapped(TEXTS["BSD-2-Clause"].replace("\n", " "), 70) + "\n" + STORY, "BSD-2-Clause"),
    (STORY + wrapped(TEXTS["MPL-2.0"].replace("\n", " "), 50) + "\n" + STORY, "MPL-2.0"),
    (STORY + wrapped(TEXTS["Unlicense"].replace("\n", " "), 70) + "\n" + STORY, "Unlicense"),
    (MIT_PARAGRAPHS + "\n" + STORY + GPL + "\n" + STORY + MIT_PARAGRAPHS, "GPL-3.0,MIT"),
    (STORY + MIT_PARAGRAPHS[:400] + "\n" + STORY, ""),
    ("Licensed under the Apache\nLicense, Version 2.0\n" + STORY, "Apache-2.0"),
]


def test_runs_of_lines(spark):
    found = scan(spark, [t for t, _ in RUNS])
    assert [r[0] for r in found] == [names for _, names in RUNS]
    assert found == [brute(t) for t, _ in RUNS]


def test_runs_against_sql(spark):
    rows = list(enumerate([*(t for t, _ in RUNS), *TEXTS_TO_SCAN]))
    table = pa.table({"doc_id": [k for k, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})
    with duckdb.connect() as db:
        db.register("documents", table)
        found = sorted(db.execute(licenses.oracle_sql()).fetchall())
    assert [r[1:] for r in found] == scan(spark, [t for _, t in rows])


def test_against_all_pairs(spark):
    assert scan(spark, TEXTS_TO_SCAN) == [brute(t) for t in TEXTS_TO_SCAN]


def test_what_is_found(spark):
    found = [r[0] for r in scan(spark, TEXTS_TO_SCAN)]
    assert found[:9] == [
        "MIT", "CC-BY-NC-4.0", "CC-BY-NC-SA-3.0", "GPL-3.0", "GPL-2.0", "proprietary", "", "", "MIT",
    ]
    assert found[9] == "ISC" and found[11] == "Apache-2.0,MIT" and found[12] == "Zlib"


def test_size_bounds_are_exact():
    for threshold in (0.5, 0.8, 0.95, 1.0):
        for size in range(1, 60):
            low, high = size_bounds(size, threshold)
            for other in range(1, 200):
                reachable = 2 * min(size, other) / (size + other) >= threshold
                assert reachable == (low <= other <= high)


def test_odd_documents(spark):
    rows = scan_licenses(odd.documents(spark)).collect()
    assert len(rows) == len(odd.rows()) and all(r.licenses == "" for r in rows)
    assert scan_licenses(odd.empty(spark)).collect() == []


def test_no_shuffle_and_no_python(spark):
    plan = scan_licenses(odd.documents(spark).coalesce(1))._jdf.queryExecution().toString()
    body = plan.split("== Physical Plan ==")[1]
    assert "Python" not in body and "Arrow" not in body and "Join" not in body
