"""Filters, includes and limits of single requests."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.config import SearchConfig
from passagework.operators import embed, filters, hybrid, keyword, vector
from passagework.operators.hybrid import hybrid_search
from passagework.operators.keyword import keyword_bm25
from passagework.plans.build import build_index
from passagework.plans.search import answer, search, searcher
from passagework.sources.files import documents_from_table


@pytest.fixture(scope="module")
def index(spark):
    texts = ["red apple", "green apple tree", "blue sky", "red red wine", "apple apple apple", "red apple"]
    docs = spark.createDataFrame([(i, t, f"dir{i % 2}/x{i}.{'md' if i < 3 else 'txt'}") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    return build_index(documents_from_table(docs, modified_at=F.to_timestamp(F.concat(F.lit("2024-01-0"), (F.col("doc_id") + 1).cast("string"))))).cache()


def asked(spark, *arguments):
    return spark.createDataFrame(list(enumerate(arguments)), "query_id int, arguments string")


@pytest.mark.parametrize("mode", ["post", "pre"])
def test_each_request_has_its_own_filters(spark, index, mode):
    requests = asked(
        spark,
        '{"query": "red apple", "limit": 9, "filter": {"documentTypes": ["markdown"]}}',
        '{"query": "red apple", "limit": 9, "filter": {"sourcePattern": "dir1*"}, "include": {"keywords": true}}',
        '{"query": "red apple", "limit": 9, "filter": {"dateRange": {"from": "2024-01-03", "to": "2024-01-05"}}, "useHybridSearch": true}',
        '{"query": "red apple", "limit": 9, "filter": {"sourcePattern": "dir("}}',
        '{"query": "red apple", "limit": 9}',
        '{"query": "red apple", "limit": 9, "filter": {"documentTypes": [], "sourcePattern": ""}, "include": {"summary": true, "metadata": true}}',
    )
    got = {}
    for r in answer(requests, index, SearchConfig(threshold=-1.0, filter_mode=mode)).collect():
        got.setdefault(r.query_id, []).append(r)
    ids = {q: sorted(r.chunk_id[0] for r in rows if r.chunk_id) for q, rows in got.items()}
    assert ids == {0: list("012"), 1: list("135"), 2: list("234"), 3: [], 4: list("012345"), 5: list("012345")}
    assert got[3][0].error == filters.INVALID_ARGUMENTS
    assert all(r.keywords is not None and r.summary is None for r in got[1])
    assert all(r.summary is not None and r.metadata is not None and r.keywords is None for r in got[5])


def test_odd_limits(spark, index):
    requests = asked(
        spark, '{"query": "red apple", "limit": 1e12}', '{"query": "red apple", "limit": -3}', '{"query": "red apple", "limit": 2}',
        '{"query": "red apple", "limit": 1e12, "useHybridSearch": true}',
    )
    read = {r.query_id: r["limit"] for r in filters.validate_requests(requests).collect()}
    assert read == {0: 2**31 - 1, 1: 0, 2: 2, 3: 2**31 - 1}
    got = answer(requests, index, SearchConfig(threshold=-1.0)).groupBy("query_id").agg(F.count("chunk_id").alias("n")).collect()
    assert {r.query_id: r.n for r in got} == {0: 6, 1: 0, 2: 2, 3: 6}
    direct = spark.createDataFrame([(1, "red", 1e15), (2, "red", None)], "query_id int, query string, limit double")
    assert search(direct, index, SearchConfig(threshold=-1.0)).count() == 11


def test_a_large_limit_does_not_deal_one_query_over_a_grid(spark, index):
    q = index.limit(1).select(F.lit(1).alias("query_id"), F.col("embedding").alias("query_vec"))
    assert vector.knn_exact(q, index, 2_000_000_000).count() == 6


@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_ends_of_the_fusion_are_the_pure_rankings(spark, index, k):
    q = build_index(documents_from_table(spark.createDataFrame([(1, "red apple", "q")], "doc_id int, text string, source string")))
    q = q.select(F.lit(1).alias("query_id"), F.col("content").alias("query"), F.col("embedding").alias("query_vec"))
    ids = lambda hits: [r.chunk_id for r in hits.orderBy("rank").collect()]
    assert ids(hybrid_search(q, index, k, 1.0)) == ids(vector.knn_exact(q, index, k))
    worded = ids(keyword_bm25(q, index, k))
    fused = ids(hybrid_search(q, index, k, 0.0))
    assert len(fused) == k
    # the least hit by words is scaled to 0, like chunks without a hit
    assert fused[: len(worded) - 1] == worded[: len(worded) - 1]


def test_searchers_by_name(spark, index):
    queries = spark.createDataFrame([(1, "red apple")], "query_id int, query string")
    config = SearchConfig(threshold=-1.0, limit=3)
    exact = [r.chunk_id for r in search(queries, index, config, knn="exact").orderBy("rank").collect()]
    centroids = vector.ivf_train(index, 2)
    ivf = searcher("ivf", centroids, nprobe=2)
    assert [r.chunk_id for r in search(queries, vector.ivf_assign(index, centroids), config, knn=ivf).orderBy("rank").collect()] == exact
    assert search(queries, index, config, knn=searcher("lsh", bucket_length=100.0)).count() == 3
    with pytest.raises(ValueError, match="Unsupported searcher"):
        search(queries, index, config, knn="other")
    with pytest.raises(ValueError, match="centroids"):
        searcher("ivf")
    with pytest.raises(ValueError, match="cosine"):
        search(queries, index, SearchConfig(metric="ip"), knn="lsh")


def test_the_model_runs_once_per_query(spark, index):
    seen = spark.sparkContext.accumulator(0)

    def model(df, text_col, out_col):
        from passagework.operators.embed import embed_hash

        count = F.udf(lambda t: seen.add(1) or t, "string").asNondeterministic()
        return embed_hash(df.withColumn(text_col, count(F.col(text_col))), text_col, 256, out_col)

    queries = spark.createDataFrame([(i, "red apple") for i in range(5)], "query_id int, query string")
    search(queries, index, SearchConfig(threshold=-1.0), embed=model).collect()
    assert seen.value <= 10


def test_a_thousand_different_filters_in_one_pass(spark, index):
    """Each query with a date and a pattern of its own, plain and hybrid, against the filtered full ranking."""
    n = 1_000
    queries = spark.range(n).select(
        F.col("id").alias("query_id"), F.lit("red apple").alias("query"), F.lit(4).alias("limit"), (F.col("id") % 2 == 0).alias("use_hybrid"),
        F.expr("TIMESTAMP'2024-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id * 6 AS INT))").alias("date_from"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("dir1*("), F.col("id"), F.lit("|x)"))).alias("source_pattern"),
    )
    config = SearchConfig(threshold=-1.0, filter_mode="pre")
    got = {}
    for r in search(queries.where("NOT use_hybrid"), index, config).select("query_id", "rank", "chunk_id").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
    full = search(queries.where("query_id = 1").drop("date_from", "source_pattern").withColumn("limit", F.lit(9)), index, SearchConfig(threshold=-1.0))
    order = [(r.chunk_id, r.source) for r in full.orderBy("rank").collect()]
    for q in range(1, n, 2):
        day = q * 6 / 1440  # days after the first of January; document i is of day i
        want = [c for c, s in order if int(c[0]) >= day and (q % 3 or "dir1" in s)][:4]
        assert [x for _, x in sorted(got.get(q, {}).items())] == want
    mixed = search(queries, index, config).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.query_id for r in mixed} >= set(got) and len(mixed) > 800


def test_choices_of_filters(spark, index):
    from passagework.operators.choices import TYPES, Choices

    when = F.to_timestamp(F.lit("2024-01-03"))
    asked = spark.createDataFrame([(0, None, None), (1, ["markdown"], ""), (2, [], "dir1*"), (3, ["json"], None), (4, None, None)],
                                  "query_id int, document_types array<string>, source_pattern string")
    held = asked.withColumns({"date_from": F.when(F.col("query_id") == 4, when), "date_to": F.lit(None).cast("timestamp")}).toArrow()
    choices = Choices(held.combine_chunks())
    rows = index.select("chunk_id", *choices.columns()).toArrow().combine_chunks().to_batches()[0]
    passing = {q: sorted(c[0] for c, ok in zip(rows["chunk_id"].to_pylist(), row) if ok) for q, row in enumerate(choices.mask()(rows))}
    assert passing == {0: list("012345"), 1: list("012"), 2: list("135"), 3: [], 4: list("2345")}
    assert len(choices) == 5 and "markdown" in TYPES


def test_hybrid_search_with_saved_postings(spark, index, tmp_path):
    from passagework.sources import store

    path = str(tmp_path / "index")
    store.write_index(index.where("doc_id < '4'"), path, with_postings=True)
    store.append_index(spark, path, index.drop("embedding"), lambda df: df.join(index.select("chunk_id", "embedding"), "chunk_id"))
    queries = spark.createDataFrame([(i, t, True) for i, t in enumerate(["red apple", "blue wine", "absent"])], "query_id int, query string, use_hybrid boolean")
    config = SearchConfig(threshold=-1.0, limit=4)
    keep = ["query_id", "rank", "chunk_id", "score"]
    want = sorted(map(tuple, search(queries, index, config).select(keep).collect()))
    stored = store.load_index(spark, path)
    assert sorted(map(tuple, search(queries, stored, config, postings=store.load_postings(spark, path)).select(keep).collect())) == want
    store.append_index(spark, path, index.drop("embedding").where("doc_id = '1'").withColumn("content", F.lit("red green")), lambda df: df.join(index.select("chunk_id", "embedding"), "chunk_id"))
    stored = store.load_index(spark, path)
    again = sorted(map(tuple, search(queries, stored, config).select(keep).collect()))
    assert again != want
    assert sorted(map(tuple, search(queries, stored, config, postings=store.load_postings(spark, path)).select(keep).collect())) == again


def test_limits_beyond_the_table_take_one_pass(spark, index, monkeypatch):
    """Queries that want everything are neither dealt over a grid nor answered one at a time."""
    n = 30
    q = spark.createDataFrame([(i, "red apple") for i in range(n)], "query_id int, query string")
    q = embed.embed_hash(q, "query", 256, "query_vec").withColumn("alpha", F.lit(0.5))
    no_filter = {"document_types": "array<string>", "source_pattern": "string", "date_from": "timestamp", "date_to": "timestamp"}
    filtered = q.withColumns({c: F.lit(None).cast(kind) for c, kind in no_filter.items()})
    rows = lambda hits: sorted(map(tuple, hits.select("query_id", "rank", "chunk_id", "score").collect()))
    asked = [lambda: vector.knn_exact(q, index, 2**31 - 1), lambda: vector.knn_filtered(filtered, index, 2**31 - 1), lambda: hybrid.exact_fusion(q, index, 2**31 - 1)]
    want = [rows(ask()) for ask in asked]
    assert [len(rows_) for rows_ in want] == [6 * n] * 3
    for module in (vector, hybrid):
        monkeypatch.setattr(module, "HELD_ROWS", 12)
    monkeypatch.setattr(vector, "score_cells", None)
    passes = {"score_filtered": 0, "fuse_turn": 0}
    for module, name in ((vector, "score_filtered"), (hybrid, "fuse_turn")):
        def counted(*args, run=getattr(module, name), name=name):
            passes[name] += 1
            return run(*args)

        monkeypatch.setattr(module, name, counted)
    assert [rows(ask()) for ask in asked] == want
    assert passes == {"score_filtered": 1, "fuse_turn": 1}
    some = [vector.knn_exact(q, index, 2**31 - 1, least=0.9), hybrid.exact_fusion(q, index, 2**31 - 1, least=0.9)]
    assert [rows(hits) for hits in some] == [[r for r in rows_ if r[3] >= 0.9] for rows_ in (want[0], want[2])]
    turns = vector.knn_exact(q, index, 2**31 - 1, broadcast_bytes=8 * 256 * 8)
    assert rows(turns) == want[0]


def test_words_of_queries_are_added_up_alike(monkeypatch):
    words = [["a", "b", "b"], ["c"], ["x"], ["a", "d", "e", "a"]]
    block = pa.record_batch({"dl": pa.array([3, 1, 1, 4]), "words": pa.array(words)})
    query, token, weight = np.array([0, 0, 0, 2, 2]), np.array([1, 0, 1, 4, 2]), np.array([1.5, 0.5, 2.0, 1.0, 3.0])
    got = []
    for dense in (0, 10**9):
        monkeypatch.setattr(keyword, "DENSE_WORDS", dense)
        scorer = keyword.WordScorer(pa.array(list("abcde")), query, token, weight, 3, 2.0, 1.2, 0.75)
        assert scorer.take(block)
        got.append(scorer.scores(0))
    assert np.allclose(*got) and (got[0] > 0).tolist() == [[True, False, False, True], [False] * 4, [False, True, False, True]]


def test_fusion_splits_each_text_once(spark, monkeypatch):
    """Over chunks with copies, without text and without a vector; the same hits as with a scan for each step."""
    texts = ["red apple", "green apple tree", None, "", "red red wine", "apple apple apple", "red apple", "Red, APPLE"]
    index = spark.createDataFrame([(f"{i}#0", t) for i, t in enumerate(texts)], "chunk_id string, content string")
    index = embed.embed_hash(index, "content").withColumn("embedding", F.when(F.col("chunk_id") != "1#0", F.col("embedding")))
    q = spark.createDataFrame([(1, "red apple"), (2, "tree"), (3, ""), (3, "wine apple"), (None, "red")], "query_id int, query string")
    q = embed.embed_hash(q, "query", out="query_vec").withColumn("alpha", F.lit(0.5))
    rows = lambda k: sorted(map(str, hybrid.exact_fusion(q, index, k).select("query_id", "rank", "chunk_id", "score").collect()))
    scans = []
    monkeypatch.setattr(hybrid, "scan_chunks", lambda *args: scans.append(1) or keyword.scan_chunks(*args))
    got = [rows(k) for k in (1, 3, 100)]
    assert not scans
    turn = hybrid.fuse_turn
    monkeypatch.setattr(hybrid, "fuse_turn", lambda *args: turn(*args[:-1], False))
    assert [rows(k) for k in (1, 3, 100)] == got and len(scans) == 3
