import hashlib
import random
import re

import pytest

from tidyspark.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, chunk string, part int"


def expected(rows, width):
    """Brute force over all windows."""
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    least = {}
    for d, w in tokens:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, float("inf")), key(d))
    out = []
    for d, w in tokens:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, width):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "日本", "a b", "x\x1cy"]
    passages = [[r.choice(vocab) for _ in range(r.randint(width - 2, 3 * width))] for _ in range(5)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            w += r.choice(passages)[r.randint(0, 3) :] if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(0, width))]
        rows.append((d, r.choice([" ", "\n", " \t "]).join(w)))
    w = passages[0]
    return rows + [(100, None), (101, ""), (102, " \n"), (3, rows[3][1]), *((7, f"{rows[k][1]} {k}") for k in range(20)), (None, rows[5][1]), (None, rows[5][1]), (103, " ".join(w[:width] * 4)), (104, "long " * 3000), (105, "long " * 3000)]


@pytest.mark.parametrize("width, chunk_bytes", [(50, 1 << 20), (50, 3000), (7, 2000), (6, 1 << 20)])
def test_equals_brute_force(spark, width, chunk_bytes):
    rows = corpus(width + chunk_bytes, width)
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = remove_repeats(df, width=width, chunk_bytes=chunk_bytes).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got), key=str) == expected(rows, width)
    for x in got:
        assert sum(b - a for a, b in x.repeats) == x.n_removed
        assert hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_by_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, f"{passage} own{d}") for d in range(2000)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=40_000)
    assert {(x.n_removed, x.repeats[0][1] if x.repeats else 0) for x in got.filter("doc_id > 0").collect()} == {(60, 60)}
    assert got.filter("doc_id = 0").first().n_removed == 0


def test_largest_id_stays(spark):
    rows = [(2**63 - 1, "a b c"), (None, "a b c"), (-(2**63), "a b c")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted(((x.doc_id, x.n_removed) for x in got), key=str) == sorted([(2**63 - 1, 3), (None, 3), (-(2**63), 0)], key=str)
