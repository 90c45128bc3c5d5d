"""Choice of embedder, vectors kept by text, digests of whole fields, thresholds as floors."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.config import SearchConfig
from passagework.operators import embed, keyword, vector
from passagework.operators.chunk import chunk_fixed
from passagework.plans.build import build_index, load_or_build
from passagework.plans.embedders import embedder
from passagework.plans.search import search
from passagework.sources import store
from passagework.sources.files import documents_from_table


def documents(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return documents_from_table(docs, source=F.lit("a.md"))


def letters(counter=None):
    """A model of three letters' counts that notes every text it sees."""

    def load():
        def model(texts):
            if counter is not None:
                counter.add(len(texts))
            return np.array([[t.count(c) for c in "abc"] for t in texts], float).reshape(-1, 3)

        return model

    return load


def test_each_text_meets_the_model_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    model = embedder("letters", {"letters": letters(seen)}, 3, str(tmp_path / "vectors"))
    path = str(tmp_path / "index")
    first = ["aab", "b", "aab", "c c"]
    store.write_index(build_index(documents(spark, first), 100, 0, chunk_fixed, model), path)
    assert seen.value == 3
    store.append_index(spark, path, chunk_fixed(documents(spark, [*first, "b", "new", "aab"]), 100, 0), model)
    assert seen.value == 4
    index = store.load_index(spark, path)
    assert sorted((r.content, tuple(r.embedding)) for r in index.collect()) == sorted(
        (t, tuple(float(t.count(c)) for c in "abc")) for t in [*first, "b", "new", "aab"]
    )
    queries = spark.createDataFrame([(1, "aab"), (2, "c c")], "query_id int, query string")
    got = search(queries, index, SearchConfig(limit=1, threshold=0.9), embed=model)
    assert {(r.query_id, r.content) for r in got.collect()} == {(1, "aab"), (2, "c c")}
    assert seen.value == 4


def test_null_and_empty_texts_share_a_vector(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "ab", 9.0)], "id int, content string, embedding double")
    model = embedder("letters", {"letters": letters()}, 3, str(tmp_path / "vectors"))
    for _ in range(2):
        got = model(df)
        assert got.columns == ["id", "content", "embedding"]
        assert {(r.id, r.content): r.embedding for r in got.collect()} == {(1, None): [0, 0, 0], (2, ""): [0, 0, 0], (3, "ab"): [1, 1, 0]}
    assert model(df.where("false")).count() == 0


def test_kinds(spark, tmp_path, caplog):
    docs = documents(spark, ["aab", "abc"])
    hashed = build_index(docs, 100, 0, chunk_fixed)
    with caplog.at_level(logging.WARNING):
        unknown = build_index(docs, 100, 0, chunk_fixed, embedder("other", {"letters": letters()}))
    assert "Unsupported embedding type: other" in caplog.text
    vectors = lambda index: sorted(r.embedding for r in index.collect())
    assert vectors(unknown) == vectors(hashed) == vectors(build_index(docs, 100, 0, chunk_fixed, embedder()))
    (tmp_path / "x.md").write_text("aab", encoding="utf-8")
    built = load_or_build(spark, str(tmp_path), embed=embedder("letters", {"letters": letters()}, 3))
    assert built.first()["embedding"] == [2, 1, 0]
    broken = embedder("letters", {"letters": letters()}, 4)
    with pytest.raises(Exception, match="expected"):
        build_index(docs, 100, 0, chunk_fixed, broken).collect()


def test_whole_fields_are_found_without_reading_texts(spark, tmp_path):
    path = str(tmp_path / "index")
    index = embed.embed_hash(chunk_fixed(documents(spark, ["one", " one ", "two", "one two"]), 100, 0), "content", 16)
    store.write_index(index, path)
    queries = spark.createDataFrame([(1, "one"), (2, " two"), (3, "three"), (4, "")], "query_id int, query string")
    saved = store.load_field_digests(spark, path)
    got = keyword.keyword_bm25(queries, saved, 5, tokenization="field")
    assert sorted((r.query_id, r.chunk_id) for r in got.collect()) == [(1, "0#0"), (1, "1#0"), (2, "2#0")]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, keyword.keyword_bm25(queries, index, 5, tokenization="field").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "field_digest" in plan and "content#" not in plan


def test_a_threshold_keeps_rows_from_being_moved(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 8))
    index = spark.createDataFrame([(f"c{i}", p.tolist()) for i, p in enumerate(points)], "chunk_id string, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points[:20])], "query_id int, query_vec array<double>")
    q, v = vector.vectors_only(queries, index)
    whole = vector.score_with_broadcast(q, v, 50, "cosine", 6)
    some = vector.score_with_broadcast(q, v, 50, "cosine", 6, least=0.8)
    assert whole.count() == 20 * 50 * 4 and some.count() < 400
    best = vector.knn_exact(queries, index, 50)
    keep = ["query_id", "rank", "chunk_id", "score"]
    assert sorted(map(tuple, vector.knn_exact(queries, index, 50, least=0.8).where("score >= 0.8").select(keep).collect())) == sorted(
        map(tuple, best.where("score >= 0.8").select(keep).collect())
    )
