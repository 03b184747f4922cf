import functools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tidyspark.llm.best_fit import RoomTree, best_fit_decreasing, pack_sequences, write_matrices
from tidyspark.llm.cutting_stock import Knapsack, pack, plan, solve
from tidyspark.llm.tokens import WordEncoder
from tidyspark.llm.wordarrays import utf8

PATH = P.path("word_bpe_49k.json")
TEXTS = ["Hello, World. It's A TEST's don't", None, "", " \n\t", "naïve CAFÉ, über-straße. ÀÉ", "été ́x", "日本語 テキスト 123 4,5", "a b\x1cc <|endoftext|> İstanbul ΣΑΣ ªº µ", "x" * 5000, "word " * 6000, "one. two, three.. (four)"]
SCHEMA = "doc_id long, text string, length string, start int"


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def reference_ids(text, end=True):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1] * end


def test_encoder_equals_tokenizer():
    import pyarrow as pa

    encoder = WordEncoder(PATH, most_words=50)
    r = random.Random(1)
    letters = "abcdeéèßÇñ.,'-3 \n"
    texts = TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(300)]
    for lo in range(0, len(texts), 40):
        part = texts[lo : lo + 40]
        ids, bounds = encoder.encode(*utf8(pa.array(part, pa.string())), 1)
        for k, text in enumerate(part):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == reference_ids(text), text
        plain, bounds = encoder.encode(*utf8(pa.array(part, pa.string())))
        assert [plain[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [reference_ids(t, False) for t in part]


SPELLED = ["hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|EndOfText|> <|endoftext| >", "x <|startoftext|>\n\n<|endoftext|>. y", "plain"]


def test_special_tokens_that_a_text_spells_out(spark):
    """The plain call of the tokenizer makes them control ids; the safe one does not."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(k, t, "clash", 0) for k, t in enumerate(SPELLED)], SCHEMA)
    for control_ids, ids in ((True, lambda t: plain.encode(t, add_special_tokens=False).ids + [1]), (False, reference_ids)):
        got = {x.doc_id: (x.doc_tokens, x.ids_crc32) for x in pack(df, PATH, control_ids=control_ids).collect()}
        assert got == {k: (len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for k, t in enumerate(SPELLED)}
    assert plain.encode(SPELLED[0], add_special_tokens=False).ids != reference_ids(SPELLED[0], False)


def test_room_tree_and_best_fit():
    r = random.Random(2)
    tree, have = RoomTree(100), Counter()
    for _ in range(2000):
        room = r.randint(0, 100)
        n = 1 if not have[room] or r.random() < 0.5 else -1
        have[room] += n
        tree.add(room, n)
        size = r.randint(0, 100)
        assert tree.least(size) == min((k for k, v in have.items() if v and k >= size), default=None)
    sizes = [r.randint(1, 100) for _ in range(400)]
    bins = best_fit_decreasing(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    rooms = []  # brute force: the least room that fits, any of equal ones
    for s in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= s]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= s
        else:
            rooms.append(100 - s)
    assert len(bins) == len(rooms)


def test_knapsack_and_plan():
    r = random.Random(3)
    for _ in range(20):
        sizes = np.array(sorted(r.sample(range(1, 41), r.randint(1, 8))))
        value = np.array([r.random() for _ in sizes])
        best = [0.0] * 41
        for c in range(1, 41):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes.tolist(), value) if s <= c)])
        sack = Knapsack(value, sizes, 40)
        for c in range(41):
            amounts = sack.amounts(c)
            assert abs(sack.best[c] - best[c]) < 1e-9 and amounts @ sizes <= c and abs(amounts @ value - best[c]) < 1e-9
    histogram = Counter(r.randint(1, 200) for _ in range(5000))
    patterns = plan(histogram, 200)
    packed = Counter()
    for pattern, copies in patterns:
        assert sum(s * n for s, n in pattern) <= 200
        for s, n in pattern:
            packed[s] += n * copies
    assert packed == histogram
    assert sum(c for _, c in patterns) <= 1.01 * sum(s * n for s, n in histogram.items()) / 200 + 1
    assert plan({}, 10) == [] and plan({10: 3}, 10) == [(((10, 1),), 3)]


def test_columns_enter_and_the_bound_is_proven():
    """No cap on columns: the program ends by pricing or by the bound."""
    # Halves and thirds by hand: 10 of size 6, 10 of 4 and 20 of 5 fill 20 sequences of 10; one pattern a size needs 10 + 5 + 10.
    hand = solve(np.array([4, 5, 6]), np.array([10.0, 20.0, 10.0]), 10, gap=0)
    assert hand.entered > 0 and abs(hand.value - 20) < 1e-6 and abs(hand.bound - 20) < 1e-6
    # Sizes of which no two fit: the bound comes from the prices, as the room alone would allow 6 sequences for 10.
    alone = solve(np.array([6]), np.array([10.0]), 10, gap=0)
    assert alone.value == alone.bound == 10
    r = random.Random(8)
    for width, n in ((64, 3000), (256, 20_000)):
        histogram = Counter(min(width - 1, 1 + int(r.lognormvariate(3, 1.2))) for _ in range(n))
        sizes = np.array(sorted(histogram))
        demand = np.array([float(histogram[s]) for s in sizes])
        found = solve(sizes, demand, width, gap=1e-3)
        assert found.entered > len(sizes) and found.value <= (1 + 1e-3) * found.bound + 1e-6
        assert found.bound <= sum(c for _, c in plan(histogram, width))
        assert all(p @ sizes <= width for p, _ in found.patterns)
        assert (sum(p * u for p, u in found.patterns) >= demand * (1 - 1e-6)).all()


@pytest.mark.parametrize("how", [{"bucket_rows": 3}, {}, {"bins": 100}, {"bins": 2048}])
def test_cutting_stock(spark, how):
    r = random.Random(4)
    rows = list(enumerate(TEXTS)) + [(100 + k, "word " * r.randint(0, 300)) for k in range(200)] + [(500, "same text"), (500, "same text"), (None, "no id")]
    got = pack(spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA), PATH, **how).collect()
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(reference_ids(t))
    for d, lists in ids.items():
        pieces = sorted((x for x in got if x.doc_id == d), key=lambda x: x.start)
        want = sorted((s, min(2048, len(i) - s), zlib.crc32(np.array(i[s : s + 2048], "<u4").tobytes()), len(i)) for i in lists for s in range(0, len(i), 2048))
        assert [(x.start, x.length, x.ids_crc32, x.doc_tokens) for x in pieces] == want
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append(x)
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
    assert len(by) <= sum(x.length for x in got) / 2048 * 1.02 + 2


def test_best_fit_round_trip(spark, tmp_path):
    rows = list(enumerate(TEXTS)) + [(3, "again"), (None, "no id")]
    packed = pack_sequences(spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA), PATH, width=256, group_tokens=3000)
    write_matrices(packed, str(tmp_path / "m"))
    back = defaultdict(list)
    names = set()
    for x in spark.read.parquet(str(tmp_path / "m")).collect():
        matrix = np.frombuffer(x.input_ids, "<u2")
        assert len(matrix) == 256 and not matrix[x.n_tokens :].any() and x.cu_seqlens[-1] == x.n_tokens and x.position_resets == x.cu_seqlens[:-1]
        assert zlib.crc32(matrix[: x.n_tokens].astype("<u4").tobytes()) == x.ids_crc32
        names.add(x.sequence_id)
        for d, s, a, b in zip(x.doc_ids, x.starts, x.cu_seqlens, x.cu_seqlens[1:]):
            back[d].append((s, matrix[a:b].tolist()))
    for d, t in rows:
        if d != 3:
            assert sum((i for _, i in sorted(back[d])), []) == reference_ids(t)
    assert sorted(i for _, i in back[3]) == sorted([reference_ids(" \n\t"), reference_ids("again")])
    assert pack_sequences(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
