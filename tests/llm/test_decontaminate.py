"""Decontamination by suffix arrays, against a plain scan for every window."""

import random

import numpy as np
import pytest

import brute
from passagework.llm import decontaminate as op


def rows_of(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return op.judge(d, b, **options)


def expected(docs, items, width):
    return brute.judged([d[1] for d in docs], [i for i in items if i[0] is not None], width)


def fixture(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "dé", "x1", "語", "the"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(1, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "--"), (None, text(3))]
    items += [(60, items[0][1]), (61, items[0][1])]
    docs = [(i, text(rng.randint(0, 60)), "old") for i in range(40)]
    docs += [(100, None, "a"), (101, "", "a"), (102, "rare " + items[3][1] + " words", "a"), (102, docs[0][1], "a"), (None, items[5][1], "a")]
    return docs, items


@pytest.mark.parametrize("width", [1, 3, 5, 13])
def test_judge(spark, width):
    docs, items = fixture(width)
    got = sorted(rows_of(spark, docs, items, window=width).collect(), key=str)
    want = {}
    for doc, row in zip(docs, expected(docs, items, width)):
        want.setdefault((doc[0], doc[1]), row)
    assert len(got) == len(docs)
    for row in got:
        n_words, n_hit, ids, bad = want[(row["doc_id"], row["text"])]
        import hashlib

        assert (row["n_words"], row["n_hit"], row["contaminated"]) == (n_words, n_hit, bad)
        assert row["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert row["n_items"] == len([x for x in ids.split(",") if x])


def test_blocks_and_small_shards_change_nothing(spark, monkeypatch):
    docs, items = fixture(7)
    whole = sorted(map(str, rows_of(spark, docs, items, window=4).collect()))
    monkeypatch.setattr(op, "BLOCK_WORDS", 20)
    assert sorted(map(str, rows_of(spark, docs, items, window=4).collect())) == whole


def test_small_shards_and_cuts(monkeypatch):
    docs, items = fixture(3)
    block = op.prepare([(str(i), op.words((t or "").encode())) for i, t in items if t and op.words(t.encode())], 4)
    texts = [(t or "").encode() for _, t, _ in docs] + [" ".join(t or "" for _, t, _ in docs).encode()]
    whole = op.Findings(texts, block, False)
    monkeypatch.setattr(op, "SHARD_WORDS", 16)
    monkeypatch.setattr(op, "CUT_BYTES", 40)
    cut = op.Findings(texts, block, False)
    assert np.array_equal(whole.cover, cut.cover) and whole.pairs == cut.pairs


@pytest.mark.parametrize("short_first", [True, False])
def test_short_item_begins_another_window(spark, short_first):
    long = " ".join(f"w{i}" for i in range(13))
    items = [(1, "w0 w1"), (2, long)] if short_first else [(1, long), (2, "w0 w1")]
    items += [(3, "z0 z1")]  # z0 sorts after w2: the first suffix with the short item goes on as the long one
    docs = [(1, long, "a"), (2, "w0 w1 z0 other words", "a"), (3, "w0 w1", "a"), (4, "w1 w0", "a")]
    b = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    for some in (docs, docs[:2], docs[:1]):
        d = spark.createDataFrame(some, "doc_id long, text string, n_words string").coalesce(1)  # one shard
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in op.judge(d, b).collect()}
        want = {d[0]: (n, hit, len([x for x in ids.split(",") if x]), bad) for d, (n, hit, ids, bad) in zip(some, expected(some, items, 13))}
        assert got == want


def test_suffix_array():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 3, 200).astype(np.int32)
    order = op.suffix_array(text, 1000)
    assert [text[i:].tolist() for i in order] == sorted(text[i:].tolist() for i in range(len(text)))


def test_empty_tables(spark):
    docs, items = fixture()
    assert rows_of(spark, [], items).collect() == []
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in rows_of(spark, docs, []).collect())


def test_remove_and_locate(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "before " + passage + " after", "a"), (2, "clean text of its own", "b"), (3, None, "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, contaminated string")
    b = spark.createDataFrame([(9, "other " + passage)], "item_id long, text string")
    assert [tuple(r) for r in op.decontaminate(d, b).orderBy("doc_id").collect()] == docs[1:]
    found = op.longest_matches(d, b).collect()
    assert [tuple(r) for r in found] == [(1, "9", 1, 1, 20)]
    assert op.longest_matches(d, b.where("false")).collect() == []


def test_columns_that_begin_with_underscores_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8)], "doc_id long, text string, __index_level_0__ long, __cover long")
    items = spark.createDataFrame([("x", "b c")], "item_id string, text string")
    row = op.judge(docs, items).first()
    assert (row["__index_level_0__"], row["__cover"], row["n_hit"]) == (7, 8, 2)
