import numpy as np
import pytest

from tidyspark.llm import embedding_dedup, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, cell long, score double"
ODD = [(9001, None), (9002, [0.0] * 16), (9003, [1.0, None] + [0.0] * 14), (9004, [float("nan")] * 16), (9005, [float("inf")] + [0.0] * 15), (9006, []), (9007, [1.0, 2.0])]


def data(n, seed, clusters=6, dim=16):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)) * r.uniform(0.5, 2, (n, 1))
    at = n // 2
    for _ in range(clusters):
        size = int(r.integers(2, 30))
        x[at : at + size] = x[0 if at % 2 else at] + r.standard_normal((size, dim)) * 0.12
        at += size
    x[1] = x[2] = x[3]  # equal vectors
    x[5] = 2 * x[3]  # same direction
    return x.astype(np.float32)


def table(spark, x, extra=()):
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + list(extra)
    return spark.createDataFrame([(k, v, 0, 1, 2, 3.0) for k, v in rows], SCHEMA)


def brute_links(x, threshold):
    x = x.astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = u @ u.T >= threshold
    np.fill_diagonal(close, False)
    part = np.arange(len(x))
    while True:
        new = np.array([min([part[k], *part[np.flatnonzero(close[k])]]) for k in range(len(x))])
        if (new == part).all():
            return close.sum(axis=1), part
        part = new


@pytest.mark.parametrize("how", [{}, {"cell_rows": 30, "task_homes": 20, "blocks": 4}, {"blocks": 100}, {"cell_rows": 5}])
def test_link_equals_brute_force(spark, how):
    x = data(400, 3)
    got = {r.vec_id: r for r in embedding_dedup.link(table(spark, x, [*ODD, (1, x[1].tolist())]), **how).collect() if r.vec_id != 1}
    links, part = brute_links(np.vstack([x, x[1]]), 0.95)
    for k in range(400):
        if k != 1:
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (links[k], part[k], part[k] == k), k
    for k, _ in ODD:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[2].class_id == 1 and got[2].n_links >= 4


def test_tasks_of_a_dense_cell_are_bounded(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = (np.ones(16) + r.standard_normal((400, 16)) * 0.15).astype(np.float32)

    def bounded(*args, make=embedding_dedup._compare):
        compare = make(*args)

        def rows(table):
            assert table.num_rows <= 200, table.num_rows
            return compare(table)

        return rows

    monkeypatch.setattr(embedding_dedup, "_compare", bounded)
    got = {row.vec_id: row for row in embedding_dedup.link(table(spark, x), blocks=4, task_homes=50, task_rows=50).collect()}
    links, part = brute_links(x, 0.95)
    assert [(got[k].n_links, got[k].component_id) for k in range(400)] == list(zip(links, part))


def test_block_distances_are_the_same_in_any_batch():
    r = np.random.default_rng(11)
    x = r.standard_normal((700, 64)).astype(np.float32).astype(float)
    grid = embedding_dedup.Grid(64, 0.95, 8, 2)
    whole = grid.turn(x)
    assert (whole == np.round(whole)).all()
    for lo, hi in ((0, 1), (3, 20), (100, 613)):
        assert (grid.turn(x[lo:hi]) == whole[lo:hi]).all()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit[:350] + r.standard_normal((350, 64)) * 0.039
    near /= np.linalg.norm(near, axis=1)[:, None]
    close = np.einsum("ij,ij->i", unit[:350], near) >= 0.95
    gap = (grid.turn(unit[:350]) - grid.turn(near)) ** 2
    within = np.array([gap[:, a:b].sum(axis=1) <= w for a, b, w in zip(grid.edges, grid.edges[1:], grid.whole)])
    assert 50 < close.sum() < 340 and within.any(axis=0)[close].all()  # the pigeonhole


def test_fewer_comparisons_than_pairs(monkeypatch):
    """Random vectors: what the boxes of all eight blocks are compared with is less than n * n, though a block is an eighth of a vector."""
    r = np.random.default_rng(12)
    x = r.standard_normal((20_000, 64))
    grid = embedding_dedup.Grid.of(64, 0.95, 8, 1)
    part, every = grid.turn(x)[:, :8], np.arange(len(x))
    compared = 0
    for own, near in embedding_dedup._meetings(part, every, every, grid.whole[0], 64):
        compared += len(own) * len(near)
        if own[0] % 97 == 0:  # no vector near one of the box is left out
            gap = part[own][:, None] - part
            assert set(np.flatnonzero(((gap * gap).sum(axis=2) <= grid.whole[0]).any(axis=0))) <= set(near.tolist())
    assert 8 * compared < len(x) ** 2


def test_link_of_empty_table(spark):
    assert embedding_dedup.link(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_search(x, ids, query, k):
    score = x.astype(float) @ x[query].astype(float)
    return sorted(((-score[i], ids[i]) for i in range(len(x)) if ids[i] != ids[query]))[:k]


@pytest.mark.parametrize("n, how, least", [(300, {}, 0.95), (3000, {"block_rows": 1000}, 0.95), (3000, {}, 0.95)])
def test_search_recall(spark, n, how, least):
    x = data(n, 5)
    got = {}
    for r in nearest.search(table(spark, x, ODD), **how).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = 0
    for q in range(0, n, 20):
        rows = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21))
        assert all(abs(r.score - float((x[r.vec_id].astype(float) * x[q].astype(float)).sum())) < 1e-9 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hit += len({r.vec_id for r in rows} & {i for _, i in brute_search(x, list(range(n)), q, 20)})
    assert hit >= least * 20 * len(range(0, n, 20))
    assert set(got) <= set(range(0, n, 20))


@pytest.mark.parametrize("kind", ["unit", "one large vector", "skewed"])
def test_search_recall_with_uneven_norms(spark, kind):
    r = np.random.default_rng(8)
    x = r.standard_normal((12_000, 64))  # as many as the smaller check table, and more
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "one large vector":
        x[4321] *= 3
    if kind == "skewed":
        x *= r.lognormal(0, 0.5, (len(x), 1))
    x = x.astype(np.float32)
    got = {}
    for row in nearest.search(table(spark, x), query_every=400).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    hit = sum(len(got[q] & {i for _, i in brute_search(x, list(range(len(x))), q, 20)}) for q in range(0, len(x), 400))
    assert hit >= 0.97 * 20 * 30


def test_search_small(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (2, [0.5, 0.5]), (40, None)]
    got = nearest.search(spark.createDataFrame([(k, v, 0, 1, 2, 3.0) for k, v in rows], SCHEMA)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 20, 1.0), (0, 2, 2, 0.5), (0, 3, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 2, 0.5), (20, 3, 3, 0.5)]
    assert nearest.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_with_repeated_query_rows(spark):
    x = data(300, 6)
    told = lambda extra: sorted(tuple(r) for r in nearest.search(table(spark, x, extra)).collect() if r.query_id == 0)
    once = told([])
    assert [r[1] for r in once] == list(range(1, 21))
    assert told([(0, x[0].tolist())] * 2) == once
    other = [(0, (-x[0]).tolist())]  # another vector of that id: its own ranks
    both = told(other)
    far = [(rank + 1, i) for rank, (_, i) in enumerate(brute_search(np.vstack([x, -x[:1]]), [*range(300), 0], 300, 20))]
    assert sorted((r[1], r[2]) for r in both) == sorted([(r[1], r[2]) for r in once] + far)


def test_few_vectors_are_verified():
    r = np.random.default_rng(9)
    x = r.standard_normal((16384, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    block = nearest.NormRanges(np.arange(len(x)), x, 20, m=128, runs=32, share=0.01, least=100)
    hit = 0
    for q in range(0, len(x), 1024):
        found, score = block.best(q, x[q])
        assert (np.diff(score) <= 0).all() and np.allclose(score, x[found] @ x[q])
        hit += len(set(found.tolist()) & {i for _, i in brute_search(x, list(range(len(x))), q, 20)})
    assert hit >= 0.97 * 20 * 16
    assert block.verified <= 0.02 * len(x) * 16


@pytest.mark.parametrize("dim", [64, 256, 768])
def test_recall_in_many_dimensions(dim):
    r = np.random.default_rng(dim)
    x = r.standard_normal((16384, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    block = nearest.NormRanges(np.arange(len(x)), x, 20, m=None, runs=32, share=0.01, least=100)
    hit = 0
    for q in range(0, len(x), 1024):
        near = x @ x[q]
        near[q] = -1
        hit += len(set(block.best(q, x[q])[0].tolist()) & set(np.argsort(-near)[:20].tolist()))
    assert hit >= 0.95 * 20 * 16
    assert block.verified <= 0.02 * len(x) * 16


HUGE = "vec_id long, embedding array<double>"


def test_vectors_of_any_norm_are_searched(spark):
    rows = [(0, [1e200, 0.0]), (20, [1e-200, 1e-200]), (40, [1.0, 1.0]), (1, [1e200, 1e199]), (2, [-1e300, 1e300]), (3, [2e-200, 0.0]), (4, [3.0, 0.0]), (5, [0.0, 0.0]), (6, [float("inf"), 0.0]), (7, [5e-324, 0.0])]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, HUGE)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    with np.errstate(all="ignore"):
        for q, v in rows[:3]:
            want = sorted(((float((np.array(w) * np.array(v)).sum()), i) for i, w in rows if i not in (q, 5, 6)), key=lambda x: (-x[0], x[1]))
            assert [(s, i) for _, i, s in sorted(got[q])] == want, q


def test_vectors_of_any_norm_are_linked(spark):
    rows = [(1, [1e200, 1e200]), (2, [2.0, 2.1]), (3, [3e-200, 3e-200]), (4, [-1e300, 1e300]), (5, [-1.0, 1.0]), (6, [0.0, 0.0]), (7, [5e-324, 0.0]), (8, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(spark.createDataFrame(rows, HUGE)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (1, 7), 8: (1, 7)}


def test_collisions_of_all_windows():
    r = np.random.default_rng(10)
    x = r.standard_normal((500, 12))
    index = nearest.SortedProjections(x, float(np.linalg.norm(x, axis=1).max()), 30, 16)
    own = index._runs((x[7] * index.largest / np.linalg.norm(x[7])) @ index.directions[:-1])
    for v in range(0, 500, 37):
        collisions = sum(abs(int(index.run[j, v]) - int(own[j])) <= radius for j in range(30) for radius in range(16))
        assert collisions == 30 * 16 - index.misses(x[7])[v]


def test_search_among_many_copies(spark):
    """A third of the rows are one vector, and a query's id may repeat."""
    x = data(600, 7)
    x[200:400] = x[20]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(20, x[20].tolist())] * 30 + [(3, x[3].tolist())] * 2
    got = {}
    for r in nearest.search(spark.createDataFrame([(k, v, 0, 1, 2, 3.0) for k, v in rows], SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    ids, full = [k for k, _ in rows], np.array([v for _, v in rows], np.float32)
    for q in (20, 220, 380):
        assert sorted(got[q]) == [(rank + 1, i) for rank, (_, i) in enumerate(brute_search(full, ids, ids.index(q), 20))], q
