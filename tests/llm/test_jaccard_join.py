import os
import random
import subprocess
import sys

import numpy as np
import pytest

from tidyspark.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, cid string, component long, tile int"


def grams(text, width=5):
    w = (text or "").split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    part = list(range(n))
    while True:
        new = [min([part[i], *(part[j] for j in links[i])], key=lambda k: rows[k][0]) for i in range(n)]
        if new == part:
            return [len(x) for x in links], [rows[p][0] for p in part]
        part = new


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 400)}"
    rows = []
    for _ in range(14):
        base = [word() for _ in range(r.choice([3, 6, 40, 150]))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 40))):
                copy[r.randrange(len(copy))] = word()
            rows.append(r.choice([" ", "\n"]).join(copy))
    rows += ["", None, " \n", "one", "one", "one two three four", "one two three four"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("task_bytes", [3 << 20, 900])
def test_equals_brute_force(spark, task_bytes):
    rows = corpus(task_bytes)
    rows.append((3, rows[3][1]))  # a repeated row
    got = J.link(spark.createDataFrame([(d, t, "c", 1, 2) for d, t in rows] + [(None, "one", "c", 1, 2)], SCHEMA), task_bytes=task_bytes).collect()
    links, part = brute(rows)
    assert sorted((x.doc_id, x.n_links, x.component_id, x.kept) for x in got if x.doc_id is not None) == sorted((d, n, p, d == p) for (d, _), n, p in zip(rows, links, part))
    assert [(x.n_links, x.kept) for x in got if x.doc_id is None] == [(0, True)]


def test_kept_documents(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(d, t, "c", 1, 2) for d, t in rows] + [(None, "one", "c", 1, 2), (rows[0][0], rows[0][1], "c", 1, 2)], SCHEMA)
    kept = J.kept_documents(df)
    assert kept.schema == df.schema
    _, part = brute(rows)
    counted = sorted((x.doc_id, x.text) for x in kept.collect() if x.doc_id is not None)
    assert counted == sorted((d, t) for (d, t), p in zip(rows, part) if d == p) or not rows[0][1]
    assert J.kept_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_documents_of_ids_with_several_texts(spark):
    long = [f"a{i}" for i in range(100)]
    a, near, b, c = " ".join(long), " ".join([*long[:99], "x"]), " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    texts = [
        (1, a), (2, near), (1, b),  # id 1 has a linked and a clean text
        (3, c), (4, c), (4, "clean text of id four"),  # the linked text of id 4 goes, the clean one stays
        (5, "d d d e f g h"), (6, "d d d e f g h"), (5, "p q r s t u v"), (7, "p q r s t u v"),  # two groups begin with id 5
        (8, None), (8, "eight"), (None, "null id"), (None, "null id"),
    ]
    kept = J.kept_documents(spark.createDataFrame([(d, t, "c", 1, 2) for d, t in texts], SCHEMA)).collect()
    want = [(1, a), (1, b), (3, c), (4, "clean text of id four"), (5, "d d d e f g h"), (5, "p q r s t u v"), (8, None), (8, "eight"), (None, "null id"), (None, "null id")]
    assert sorted(((x.doc_id, x.text) for x in kept), key=str) == sorted(want, key=str)
    both = J.kept_documents(spark.createDataFrame([(1, a, "c", 1, 2), (1, near, "c", 1, 2), (1, a, "c", 1, 2)], SCHEMA)).collect()
    assert len(both) == 1 and both[0].text in (a, near)


def test_many_near_copies_of_one_text(spark):
    base = [f"b{i}" for i in range(200)]
    rows = [(d, " ".join([*base[:50], f"x{d}", *base[51:]])) for d in range(300)]
    got = J.link(spark.createDataFrame(rows, "doc_id long, text string"), task_bytes=60_000).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(299, 0)}


def test_shared_grams():
    r = random.Random(9)
    lists = [[r.randint(0, 60) for _ in range(r.randint(0, 40))] for _ in range(30)]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    rows = [k for k in range(30) if k % 4]
    sets = J._Grams(np.array(sum(lists, []), np.uint64), bounds, rows)
    for at, k in enumerate(rows):
        got = sets.shared_with(at)
        assert [int(x) for i, x in enumerate(got) if i != at] == [len(set(lists[k]) & set(lists[o])) for o in rows if o != k]


def test_chains_do_not_meet_whole(spark, monkeypatch):
    """A long chain of overlapping texts is one component, but a task gets texts with a common head alone."""
    words = [f"v{i}" for i in range(4000)]
    rows = [(d, " ".join(words[8 * d : 8 * d + 200])) for d in range(400)]
    met = []

    def counted(*args, make=J._compare):
        compare = make(*args)

        def run(table):
            assert table.num_rows <= 120, table.num_rows
            return compare(table)

        return run

    monkeypatch.setattr(J, "_compare", counted)
    got = {x.doc_id: x for x in J.link(spark.createDataFrame(rows, "doc_id long, text string"), task_bytes=30_000).collect()}
    links, part = brute(rows)
    assert [(got[d].n_links, got[d].component_id) for d, _ in rows] == list(zip(links, part)) and max(links) > 0 and not met


def test_a_task_of_many_near_copies_is_bounded_in_memory():
    code = """
import resource, numpy as np, pyarrow as pa
from tidyspark.llm import jaccard_join as J
n = 6000
texts = [" ".join([f"b{i}" for i in range(12)] + [f"x{d}"] + [f"c{i}" for i in range(90)]) for d in range(n)]
from tidyspark.llm.wordarrays import utf8
_, bounds, a, b = J.shingles(*utf8(pa.array(texts)), 5)
cid = J._cids(a, b, np.diff(bounds))
table = pa.table({"cid": pa.array(cid, pa.binary()), "copies": [1] * n, "heads": pa.array([None] * n, pa.list_(pa.binary())), "__text": texts, "unit": pa.array([min(cid)] * n, pa.binary()), "tile": [0] * n, "first": [0] * n, "second": [0] * n})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = J._compare(5, 0.8, 1e-6)(table)
assert out.num_rows == n and set(out["links"].to_pylist()) == {n - 1} and len(set(out["root"].to_pylist())) == 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    grown = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout)
    assert grown < 250, grown


def test_pruning_is_rare():
    """A pair at the threshold itself is lost with less than some times the tolerance."""
    for n, m, e in J.least_matches(0.8, 1e-6, 20):
        draws = np.random.default_rng(1).binomial(n, 0.8, 200_000)
        assert (draws < m).mean() < 1e-4 and 0 < m < e
