import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidyspark.llm.line_dedup import ORACLE, dedup_lines, line_key, seen_twice, suspects

SCHEMA = "doc_id long, text string, n_lines long, __row string, kept int"
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(seed=3):
    r = random.Random(seed)
    pool = [f"This is line number {i} of the pool, ÄÖ" for i in range(25)] + ["short", "x" * 20, "x" * 19, "é" * 20, "é" * 19, "Ｘ" * 20, "", " "]
    rows = []
    for d in range(150):
        lines = [r.choice(["", " ", "\t\x0b", "\r"]) + (lambda s: s.upper() if r.random() < 0.2 and "Ä" not in s else s)(r.choice(pool)) + r.choice(["", "  ", "\r"]) if r.random() < 0.3 else f"only here {d} {r.random()}" for _ in range(r.randrange(12))]
        rows.append((d, "\n".join(lines)))
    license_line = "Permission is hereby granted, free of charge"
    rows += [(d, license_line + "\n" + f"own words {d}") for d in range(1000, 1400)]
    rows += [(2000, None), (2001, ""), (2002, "\n"), (2003, " \n\n"), (None, license_line), (None, rows[5][1]), rows[5], rows[5], (7, "another text of the same id\n" + license_line), (2004, ("a long text of many words " * 5000 + "\n") * 30)]
    rows += [(2005, "in two documents only, this one"), (2006, "in two documents only, this one"), (2006, "in two documents only, this one")]
    return [(*x, 5, "r", 6) for x in rows]


def brute(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    split = [(d, (t or "").split("\n")) for d, t, *_ in rows]
    holders = defaultdict(set)
    for d, lines in split:
        for line in lines:
            if len(key(line)) >= 20:
                holders[key(line)].add(-1 if d is None else d)
    out = []
    for d, lines in split:
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == (-1 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_the_contract(spark):
    rows = documents()
    got = told(dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(7), bits=1 << 20))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize("bits", [1 << 6, 1 << 10])
def test_a_full_filter_changes_nothing(spark, bits):
    rows = documents(4)[:150]
    assert told(dedup_lines(spark.createDataFrame(rows, SCHEMA), bits=bits)) == brute(rows)


def test_few_single_lines_are_suspects(spark):
    """All lines that two documents share pass the filter, and hardly any other."""
    rows = [(d, f"a line that nobody else has {d}\nanother one that is of {d}, {d}\nthis is shared by two: {d // 2}") for d in range(4000)]
    twice = seen_twice(spark.createDataFrame(rows, "id long, text string").select("text").repartition(5), bits=1 << 18)
    digests = {line: line_key(line.encode()) for _, t in rows for line in t.split("\n")}
    found = set(suspects(list(digests.values()), twice))
    shared = {k for line, k in digests.items() if line.startswith("this is shared by two: ")}
    assert shared <= found and len(found - shared) < 0.02 * 8000
    assert isinstance(twice, np.ndarray) and len(twice) == (1 << 18) // 8


def test_without_texts_and_with_other_limits(spark):
    df = spark.createDataFrame([(1, "aaaa\nb"), (2, "aaaa\nc"), (3, "AAAA ")], "doc_id long, text string")
    assert told(dedup_lines(df, least_points=4, least_docs=2, bits=1 << 12)) == sorted(((1, 2, 1, hashlib.sha256(b"b").hexdigest(), "b"), (2, 2, 1, hashlib.sha256(b"c").hexdigest(), "c"), (3, 1, 0, hashlib.sha256(b"AAAA ").hexdigest(), "AAAA ")), key=repr)
    assert {r[4] for r in told(dedup_lines(df, bits=1 << 12, with_text=False))} == {None}
    with pytest.raises(ValueError):
        dedup_lines(df, least_docs=1)


def test_equals_sql(spark, tmp_path):
    df = spark.createDataFrame(documents(8), SCHEMA)
    df.write.parquet(str(tmp_path / "d"))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert sorted(base.execute(ORACLE).fetchall(), key=repr) == told(dedup_lines(df, bits=1 << 20).drop("kept"))


def test_nothing(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA), bits=1 << 20).count() == 0


def test_code_points():
    assert line_key(("é" * 20).encode()) and not line_key(("é" * 19).encode()) and not line_key(re.sub("x", "😀", "x" * 19).encode())
