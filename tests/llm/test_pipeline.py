import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_jaccard_join import brute  # noqa: E402
from test_packing import reference_ids  # noqa: E402

from tidyspark.llm import language_id, personal_data, scratch  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": ["tha", "ing", "ou", "wer", "st"], "bb": ["eau", "qué", "les", "ion", "pa"], "cc": ["sch", "über", "ung", "ein", "bo"]}


def documents():
    r = random.Random(3)
    make = lambda lang, n: " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = []
    for d in range(240):
        lang = r.choice(list(WORDS))
        rows.append((d, make(lang, r.randint(10, 120)) + (" write to me@x.org" if d % 9 == 0 else ""), lang, f"src{d % 3}"))
    for k in range(12):  # near and exact copies
        words = rows[k][1].split()
        if len(words) > 60:
            words[20] = "changed"
        rows.append((300 + k, " ".join(words), rows[k][2], "src1"))
    rows += [(400, None, "aa", "src0"), (401, "", "bb", "src0"), (402, "zzzxx kkqq jjvv pppz " * 8, None, "src0"), (403, " ".join(["tha", "ing"] * 4000), None, None)]
    return [(d, t, k, s, len(t or "")) for d, t, k, s in rows]


def test_run_equals_stages_by_hand(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "personal_data", "source_mixing", "cutting_stock_packing"]
    after = []
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = scratch.table(stage(spark, at, str(tmp_path)), name)
        after.append(at)
        assert name == "cutting_stock_packing" or at.schema.names == docs.schema.names

    # 1: what the model accepts, with the language it predicts
    model = language_id.fit(docs)
    told = list(language_id._predictions(model, [t for _, t, *_ in rows], 1 << 20))
    want = [(d, t, x[0], s, n) for (d, t, _, s, n), x in zip(rows, told) if not x[3]]
    assert sorted(map(tuple, after[0].collect()), key=str) == sorted(want, key=str)
    assert {400, 401, 402}.isdisjoint(x[0] for x in want) and len(want) >= 245

    # 2: the smallest id of each group
    pairs = sorted((d, t) for d, t, *_ in want)
    _, part = brute(pairs)
    kept = [d for (d, _), p in zip(pairs, part) if d == p]
    assert sorted(x.doc_id for x in after[1].collect()) == kept and len(kept) < len(pairs)

    # 3: the same rows, without personal data
    texts = {x.doc_id: x.text for x in after[2].collect()}
    assert sorted(texts) == kept and not any("me@x.org" in t for t in texts.values())
    assert all(texts[d] == personal_data.redact(t, personal_data.find(t)) for d, t in pairs if d in texts)

    # 4: whole documents and at most one part of each, as many words as there were
    mixed = after[3].collect()
    size = {d: len(t.split()) for d, t in texts.items()}
    taken = Counter()
    for x in mixed:
        assert texts[x.doc_id].startswith(x.text) and x.n_chars == len(x.text)
        taken[x.doc_id] += len(x.text.split())
    assert all(n <= 3 * size[d] for d, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) <= 8

    # 5: each id of each document in one piece
    pieces = Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in after[4].collect())
    wanted = Counter()
    for x in mixed:
        ids = reference_ids(x.text)
        wanted.update((x.doc_id, s, min(2048, len(ids) - s), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert pieces == wanted

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in whole) == pieces


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
