"""The corpus pipeline, stage by stage against plain versions."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from passagework.llm import bpe_tree
from passagework.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = [(10_000, None, "en", "s", 1), (10_001, "123 ***", "en", "s", 1), (10_002, "", None, None, None)]
    before = stored(docs.unionByName(spark.createDataFrame(extra, docs.schema)), "test")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SF), "test")
        old = [tuple(r) for r in before.orderBy("doc_id").select("doc_id", "text").collect()]
        if name != "bpe":
            assert after.columns == columns
            new = [tuple(r) for r in after.orderBy("doc_id").select("doc_id", "text").collect()]
        if name == "language_id":
            assert new == [r for r in old if r[0] < 10_000]
        elif name == "line_dedup":
            kept = [(k, t) for (k, o), t in zip(old, brute.kept_lines(old)) if t or o == ""]
            assert new == [r for r in kept if r[1] != "" or ("" in dict(old).values())]
            assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        elif name == "near_dedup":
            groups = brute.near_groups(old, 5, 80)
            assert new == [r for r, g in zip(old, groups) if r[0] == g]
        elif name == "decontamination":
            bad = [x[3] for x in brute.judged([t for _, t in old], items)]
            assert new == [r for r, b in zip(old, bad) if not b]
        else:
            model = bpe_tree.model(public_tokenizers.path("word_bpe_49k.json"))
            rows = after.orderBy("doc_id").collect()
            assert [r["doc_id"] for r in rows] == [k for k, _ in old]
            for row, (_, text) in zip(rows, old):
                ids = model.tokenizer.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(row["ids"], "<u4").tolist() == ids and row["n_tokens"] == len(ids)
                assert row["decoded"] == model.tokenizer.decode(ids, skip_special_tokens=False)
        assert after.count() > 50 and len(old) > 50
        before = after


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    digest = [hashlib.sha256(r["ids"]).hexdigest() for r in rows.collect()]
    assert len(digest) == len(set(digest)) > 50


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test")
    assert docs.collect() == []


def test_near_duplicates_are_dropped_by_row(spark):
    text = lambda name, n=80: " ".join(f"{name}{i}" for i in range(n))
    docs = [(3, text("a")), (5, text("b")), (5, text("a", 79)), (7, text("c")), (7, text("c")), (9, text("d")), (9, text("d", 79))]
    docs += [(11, text("e")), (11, text("f")), (12, text("f", 79)), (13, None), (None, text("a")), (14, text("c", 79)), (14, text("c", 79))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_near_duplicates(spark, df, SF).collect()]
    nines = [r for r in kept if r[0] == 9]
    assert len(nines) == 1 and nines[0] in docs
    rest = [docs[i] for i in (0, 1, 3, 7, 8, 10, 11)]
    assert sorted([r for r in kept if r[0] != 9], key=str) == sorted(rest, key=str)
