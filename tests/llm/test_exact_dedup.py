import hashlib
import re

import odd
from tabsonde.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SPACES = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(SPACES.sub("", text or ""), []).append((doc_id, text or ""))
    out = []
    for body, members in groups.items():
        members.sort(key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        sha = hashlib.sha256(body.encode()).hexdigest()
        for place, (doc_id, _) in enumerate(members):
            out.append((str(doc_id), str(members[0][0]), len(members), place == 0, sha))
    return sorted(out)


def got(df):
    return sorted(
        (str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256)
        for r in df.collect()
    )


def test_odd_documents(spark):
    assert got(exact_duplicates(odd.documents(spark))) == brute([r[:2] for r in odd.rows()])


def test_large_group_over_slots(spark):
    rows = [(k, "copy of one text" + " " * (k % 5)) for k in range(3000)]
    rows += [(k, f"other {k % 700}") for k in range(3000, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(exact_duplicates(df)) == brute(rows)


def test_shared_beginnings_stay_apart(spark):
    rows = [(k, "x" * 500 + str(k // 2)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(exact_duplicates(df, slots=3)) == brute(rows)


def test_empty_table(spark):
    found = exact_duplicates(odd.empty(spark))
    assert found.collect() == []
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_kept_rows(spark):
    docs = odd.documents(spark)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    bodies = [SPACES.sub("", r.text or "") for r in kept.collect()]
    expected = {SPACES.sub("", r[1] or "") for r in odd.rows()}
    assert len(bodies) == len(set(bodies)) and set(bodies) == expected


def test_no_python_on_the_executors(spark):
    plan = exact_duplicates(odd.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
