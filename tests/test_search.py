"""Whole searches on small literal collections."""

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.config import SearchConfig
from passagework.operators import embed, filters, respond
from passagework.operators.chunk import chunk_fixed
from passagework.plans.build import build_index, load_or_build
from passagework.plans.search import answer, search, search_one
from passagework.sources.files import documents_from_table, scan_documents
from passagework.sources.store import append_index, load_index, write_index

HITS = [
    # content, source, startLine, endLine, vector: cosines with (1, 0) are .9, .8 and .6
    ("Test content 1", "test1.md", "1", "5", [0.9, 0.4358898943540674]),
    ("Test content 2", "test2.md", None, None, [0.8, 0.6]),
    ("Test content 3", "test3.md", None, None, [0.6, 0.8]),
]


@pytest.fixture(scope="module")
def hits(spark):
    rows = [
        (f"{i}#0", str(i), 0, s, c, None, {k: v for k, v in (("source", s), ("startLine", a), ("endLine", b)) if v}, e)
        for i, (c, s, a, b, e) in enumerate(HITS)
    ]
    return spark.createDataFrame(
        rows,
        "chunk_id string, doc_id string, chunk_no int, source string, content string, modified_at timestamp,"
        " metadata map<string,string>, embedding array<double>",
    )


@pytest.fixture(scope="module")
def test_query(spark):
    return spark.createDataFrame(
        [(1, "test query", [1.0, 0.0])], "query_id bigint, query string, query_vec array<double>"
    )


def rows(df):
    return df.orderBy("query_id", "rank").collect()


def test_threshold_and_positions(hits, test_query):
    found = rows(search(test_query, hits))
    assert [(r.content, r.score) for r in found] == [("Test content 1", 0.9), ("Test content 2", 0.8)]
    assert (found[0].start_line, found[0].end_line, found[0].start_column, found[0].end_column) == (1, 5, None, None)
    assert (found[1].start_line, found[1].end_line, found[1].start_column, found[1].end_column) == (1, 1, 1, 14)
    assert {r.document_type for r in found} == {"markdown"}


def test_threshold_is_inclusive(hits, test_query):
    assert len(rows(search(test_query, hits, SearchConfig(threshold=0.8)))) == 2


def test_additions(hits, test_query):
    config = SearchConfig(
        include_summary=True, include_keywords=True, include_relevance=True, include_metadata=True
    )
    first = rows(search(test_query, hits, config))[0]
    assert first.summary == "Test content 1"
    assert first.keywords == ["test", "content"]
    assert "test query" in first.relevance and first.relevance.endswith("0.90")
    assert first.metadata == {"source": "test1.md", "startLine": "1", "endLine": "5"}
    plain = rows(search(test_query, hits))[0]
    assert (plain.summary, plain.keywords, plain.relevance, plain.metadata) == (None, None, None, None)


def test_context_is_searched_but_not_shown(spark, hits):
    seen = []

    def spy(df, text_col, out):
        seen.extend(r[0] for r in df.select(text_col).collect())
        return df.withColumn(out, F.array(F.lit(1.0), F.lit(0.0)))

    asked = spark.createDataFrame(
        [(1, "test query", "additional context")], "query_id bigint, query string, context string"
    )
    found = rows(search(asked, hits, SearchConfig(include_relevance=True), embed=spy))
    assert seen == ["test query additional context"]
    assert "additional" not in found[0].relevance


def test_limits(spark, hits):
    asked = spark.createDataFrame(
        [(1, "a", 1, [1.0, 0.0]), (2, "b", 0, [1.0, 0.0]), (3, "c", None, [1.0, 0.0])],
        "query_id bigint, query string, limit int, query_vec array<double>",
    )
    found = rows(search(asked, hits, SearchConfig(threshold=0.0)))
    assert [r.query_id for r in found] == [1, 3, 3, 3]
    assert search(asked.filter("query_id = 2"), hits).count() == 0


def test_filters_come_after_the_limit_unless_asked(spark, hits, test_query):
    asked = test_query.withColumn("limit", F.lit(1))
    post = SearchConfig(threshold=0.0, source_pattern="test3*")
    assert search(asked, hits, post).count() == 0
    pre = SearchConfig(threshold=0.0, source_pattern="test3*", filter_mode="pre")
    assert [r.source for r in rows(search(asked, hits, pre))] == ["test3.md"]
    everything = {r.chunk_id for r in search(test_query, hits, SearchConfig(threshold=0.0)).collect()}
    some = {r.chunk_id for r in search(test_query, hits, post).collect()}
    assert some <= everything


def test_boost_keeps_the_order_and_respects_the_threshold(hits, test_query):
    rules = (("test2", 0.99), ("test3", 0.99))
    found = rows(search(test_query, hits, SearchConfig(boost_rules=rules)))
    assert [(r.source, r.score) for r in found] == [("test1.md", 0.9), ("test2.md", 0.99)]
    resorted = rows(search(test_query, hits, SearchConfig(boost_rules=rules, resort=True)))
    assert [r.source for r in resorted] == ["test2.md", "test1.md"]


def test_no_index_and_empty_index(hits, test_query):
    assert search(test_query, None).count() == 0
    assert search(test_query, hits.filter("false")).count() == 0


@pytest.mark.parametrize("alpha", [0.0, 0.25, 1.0])
def test_hybrid_ends_are_the_pure_searches(spark, alpha):
    texts = ["red apple", "green apple tree", "blue sky", "red red wine", "apple apple apple"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    index = build_index(documents_from_table(docs, source=F.lit("a.md")))
    asked = spark.createDataFrame([(1, "red apple", True, alpha)], "query_id int, query string, use_hybrid boolean, alpha double")
    config = SearchConfig(threshold=-1.0, limit=3)
    got = [r.chunk_id for r in rows(search(asked, index, config))]
    if alpha == 1.0:
        plain = search(asked.drop("use_hybrid", "alpha"), index, config)
        assert got == [r.chunk_id for r in rows(plain)]
    if alpha == 0.0:
        from passagework.operators.keyword import keyword_bm25

        assert got == [r.chunk_id for r in rows(keyword_bm25(asked, index, 3))]
    assert len(got) == 3


def test_mixed_batch_gives_each_query_its_own_search(spark):
    texts = ["red apple", "green apple tree", "blue sky", "red red wine", "apple apple apple"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    index = build_index(documents_from_table(docs, source=F.lit("a.md")))
    asked = spark.createDataFrame(
        [(1, "red apple", True, 0.25), (2, "red apple", False, None), (3, "sky", True, None)],
        "query_id int, query string, use_hybrid boolean, alpha double",
    )
    config = SearchConfig(threshold=-1.0, limit=3)
    together = rows(search(asked, index, config))
    alone = [r for i in (1, 2, 3) for r in rows(search(asked.filter(F.col("query_id") == i), index, config))]
    assert together == alone


def test_answer(spark, hits):
    def requests(*args):
        return spark.createDataFrame(list(enumerate(args)), "query_id bigint, arguments string")

    asked = requests(
        '{"query": "Test content 1"}', '{"query": "zzz"}', '{"query": ""}', "[]", "null", '{"query": 3}', "{", None
    )
    index = build_index(
        documents_from_table(
            spark.createDataFrame([(1, "Test content 1")], "doc_id int, text string"), source=F.lit("x.md")
        )
    )
    got = {r.query_id: r for r in answer(asked, index).collect()}
    assert (got[0].source, got[0].score, got[0].error) == ("x.md", 1.0, None)
    assert (got[1].content, got[1].source, got[1].score) == ("検索結果が見つかりませんでした。", "dummy.md", 0.0)
    assert {got[i].content for i in range(2, 8)} == {"検索中にエラーが発生しました。"}
    assert [got[i].error for i in range(2, 8)] == [
        filters.QUERY_REQUIRED,
        filters.QUERY_REQUIRED,
        filters.INVALID_ARGUMENTS,
        filters.QUERY_REQUIRED,
        filters.INVALID_ARGUMENTS,
        filters.INVALID_ARGUMENTS,
    ]


def test_json_response(hits, test_query):
    config = SearchConfig(include_keywords=True, include_metadata=True)
    response = respond.results_json(search(test_query, hits, config)).collect()[0].response
    parsed = json.loads(response)["results"]
    assert [r["content"] for r in parsed] == ["Test content 1", "Test content 2"]
    assert parsed[0]["startLine"] == 1 and "startColumn" not in parsed[0] and "error" not in parsed[0]
    assert parsed[1]["endColumn"] == 14 and parsed[0]["metadata"]["endLine"] == "5"


def test_wrong_argument_types_are_ignored(spark):
    asked = spark.createDataFrame(
        [
            (1, '{"query": "a", "limit": "3", "useHybridSearch": "yes", "hybridAlpha": null}'),
            (2, '{"query": "a", "limit": 3, "useHybridSearch": false, "hybridAlpha": 0.5, "context": "c"}'),
            (3, '{"query": "a", "limit": 0}'),
        ],
        "query_id int, arguments string",
    )
    got = filters.validate_requests(asked).orderBy("query_id").collect()
    assert [(r.limit, r.use_hybrid, r.alpha, r.context) for r in got] == [
        (None, None, None, None),
        (3, False, 0.5, "c"),
        (0, None, None, None),
    ]


# ---- files and the saved index ------------------------------------------------------


@pytest.fixture
def knowledge(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# 集約\n\n集約の設計 is about aggregates\n", encoding="utf-8")
    (tmp_path / "b.mdx").write_text("component text", encoding="utf-8")
    (tmp_path / "sub" / "c.txt").write_text("deep text", encoding="utf-8")
    (tmp_path / "d.md.bak").write_text("backup", encoding="utf-8")
    (tmp_path / "e.json").write_text("{}", encoding="utf-8")
    return tmp_path


def test_scan(spark, knowledge):
    got = {r.source: r for r in scan_documents(spark, str(knowledge)).collect()}
    assert {s.removeprefix(str(knowledge)) for s in got} == {"/a.md", "/b.mdx", "/sub/c.txt"}
    assert got[f"{knowledge}/a.md"].content == "# 集約\n\n集約の設計 is about aggregates\n"
    assert all(r.modified_at is not None and r.metadata["source"] == r.source for r in got.values())


def test_scan_of_a_missing_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Knowledge base path does not exist: "):
        scan_documents(spark, str(tmp_path / "absent"))


def test_load_or_build(spark, knowledge, tmp_path, caplog):
    built = load_or_build(spark, str(knowledge))
    assert built.count() == 3 and (knowledge / ".vector-store").is_dir()
    (knowledge / "late.md").write_text("later", encoding="utf-8")
    assert load_or_build(spark, str(knowledge)).count() == 3  # loaded, not built again
    found = rows(search_one(spark, "deep text", built, SearchConfig(threshold=0.6)))
    assert [(r.source, r.document_type) for r in found] == [(f"{knowledge}/sub/c.txt", "text")]
    empty = tmp_path / "empty"
    empty.mkdir()
    with caplog.at_level(logging.WARNING):
        assert load_or_build(spark, str(empty)) is None
    assert "No documents found" in caplog.text


def test_load_failures(spark, tmp_path, hits):
    assert load_index(spark, str(tmp_path / "absent")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("not parquet")
    assert load_index(spark, str(tmp_path / "broken")) is None
    hits.drop("embedding").write.parquet(str(tmp_path / "other"))
    assert load_index(spark, str(tmp_path / "other")) is None


def test_write_replaces_and_may_read_itself(spark, tmp_path, hits):
    path = str(tmp_path / "index")
    write_index(hits, path)
    write_index(load_index(spark, path).filter("doc_id <> '0'"), path)
    assert load_index(spark, path).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["index"]


def test_failed_write_keeps_the_old_index(spark, tmp_path, hits):
    path = str(tmp_path / "index")
    write_index(hits, path)
    with pytest.raises(Exception):
        write_index(hits.withColumn("content", F.raise_error(F.lit("no"))), path)
    assert load_index(spark, path).count() == 3


def test_append(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id int, text string")
    more = spark.createDataFrame([(2, "two"), (3, "three")], "doc_id int, text string")
    path = str(tmp_path / "index")
    for table, dedupe in ((docs, True), (more, True), (more, False)):
        chunks = chunk_fixed(documents_from_table(table, source=F.lit("a.md")))
        append_index(spark, path, chunks, lambda df: embed.embed_hash(df, "content"), dedupe)
    assert sorted(r.doc_id for r in load_index(spark, path).collect()) == ["1", "2", "2", "3", "3"]


def test_streamed_documents_are_appended_once(spark, knowledge, tmp_path):
    from passagework.streaming.ingest import ingest_documents

    path, checkpoint = str(tmp_path / "index"), str(tmp_path / "progress")
    ingest_documents(spark, str(knowledge), path, checkpoint)
    assert load_index(spark, path).count() == 3
    (knowledge / "late.md").write_text("later", encoding="utf-8")
    ingest_documents(spark, str(knowledge), path, checkpoint)
    assert load_index(spark, path).count() == 4


def test_embedder_by_type(spark):
    df = spark.createDataFrame([("hello world",), (None,)], "content string")

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = embed.embed_by_type(df, "content", "mine", {"mine": load}, 2).collect()
    assert [r.embedding for r in got] == [[11.0, 1.0], [0.0, 1.0]]
    warned = []
    fallback = embed.embed_by_type(df, "content", "unknown", {}, 8, warned.append)
    assert "Unsupported embedding type: unknown" in warned[0]
    assert len(fallback.first().embedding) == 8
    with pytest.raises(Exception, match="embedder returned shape"):
        embed.embed_with(df, "content", load, 3).collect()
