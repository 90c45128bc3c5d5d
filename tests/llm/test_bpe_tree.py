"""BPE by tree concatenation, against the tokenizers library on whole texts."""

import os

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import bpe_tree

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return bpe_tree.Model(PATH)


def library(bpe, text):
    return bpe.tokenizer.encode(text, add_special_tokens=False).ids


UNSPLIT = st.text(
    st.sampled_from("aabcdeeiinnorsttthing0123'sre!?-_.ÀéßΣσς語言😀éनि  <|>"), min_size=1, max_size=300
)


@settings(max_examples=400, deadline=None)
@given(UNSPLIT, st.integers(2, 40))
def test_tree_equals_whole(text, leaf):
    bpe = bpe_tree.model(PATH)
    assert bpe_tree.tree(bpe, text, leaf).ids.tolist() == library(bpe, text)


@pytest.mark.parametrize("text", ["a" * 50_001, "ab" * 30_000, "thing" * 9_000, "1234567890" * 3_000, "語" * 9_000, "!?" * 9_000, "x'" * 9_000, "<|endoftext|>" * 900])
def test_long_unsplit(bpe, text):
    assert bpe_tree.tree(bpe, text).ids.tolist() == library(bpe, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_encode_and_decode_any_text(text):
    bpe = bpe_tree.model(PATH)
    ids = bpe.encode([text.encode("utf-8", "ignore")])[0]
    expected = library(bpe, text.encode("utf-8", "ignore").decode())
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert bpe.decode(ids) == bpe.tokenizer.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aabeinorst 0'!é語😀न <|>\n\x1c\x85 "), max_size=200), max_size=4), st.integers(8, 60))
def test_texts_by_the_tree(texts, leaf):
    bpe = bpe_tree.model(PATH)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe_tree, "LEAF_CHARS", leaf)
        got = bpe.encode_tree([t.encode() for t in texts])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [library(bpe, t) for t in texts]


def test_the_tree_encodes_documents(bpe, monkeypatch):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    joins = []
    monkeypatch.setattr(bpe_tree, "join", lambda *a, real=bpe_tree.join: joins.append(1) or real(*a))
    got = bpe.encode_tree([t.encode() for t in texts])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [library(bpe, t) for t in texts]
    longer = [len(t.encode()) for t in texts if len(t.encode()) > bpe_tree.LEAF_CHARS]
    assert len(joins) >= sum(n // bpe_tree.LEAF_CHARS for n in longer) > 0


def test_rows(spark, bpe):
    texts = [None, "", " \n\t", "Hello, World's 42", "x<|endoftext|>y", "hello " * 3, "Z" * 5_000, "\x1c a b \x85"]
    rows = [(i, t, "old") for i, t in enumerate(texts)] + [(1, "", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = bpe_tree.decode(bpe_tree.encode(docs, PATH), PATH).collect()
    assert len(got) == len(rows)
    for row in got:
        expected = library(bpe, row["text"] or "")
        assert np.frombuffer(row["ids"], "<u4").tolist() == expected
        assert row["decoded"] == bpe.tokenizer.decode(expected, skip_special_tokens=False)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_tree.decode(bpe_tree.encode(docs, PATH), PATH).collect() == []


def test_pieces_in_several_tasks(spark, bpe):
    texts = ["one two  three " * 40, "thing" * 200, "a" * 333 + " b" + "c" * 500 + " ", "x", " " * 90, "ab'sre12" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = bpe_tree.encode_long(docs, PATH, "text", 64, []).collect()
    assert len(got) == len(texts)
    for row in got:
        assert np.frombuffer(row["ids"], "<u4").tolist() == library(bpe, row["text"])


def test_decode_null(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe_tree.decode(df, PATH).first()["decoded"] is None
