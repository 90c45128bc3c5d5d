"""Operators one by one: edge cases and properties."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.functions import text, vectors
from passagework.operators import chunk, embed, enrich, filters, keyword, vector
from passagework.schema import INDEX, ensure_schema
from passagework.sources import store
from passagework.sources.files import documents_from_table


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


# ---- chunks -------------------------------------------------------------------------


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (5, 4), (1000, 200)])
def test_fixed_chunks_are_the_windows(spark, size, overlap):
    texts = ["", "a", "abcdefghij", "日本語のテキスト" * 5, "x\ny" * 20, "😀" * 23, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {}
    for r in chunk.chunk_fixed(documents_from_table(docs, source=F.lit("s")), size, overlap).collect():
        got.setdefault(int(r.doc_id), {})[r.chunk_no] = r.content
    step = size - overlap
    for i, t in enumerate(texts):
        count = max(1, math.ceil((len(t) - overlap) / step)) if t else 0
        assert got.get(i, {}) == {n: t[n * step : n * step + size] for n in range(count)}


def test_bad_sizes():
    for size, overlap in ((10, 10), (10, 11), (0, 0), (5, -1)):
        with pytest.raises(ValueError):
            chunk.check_sizes(size, overlap)


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet="ab \n日", max_size=120),
    st.integers(min_value=2, max_value=20).flatmap(lambda s: st.tuples(st.just(s), st.integers(0, s - 1))),
)
def test_recursive_chunks(body, sizes):
    size, overlap = sizes
    chunks = chunk.split_recursively(body, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    position = 0
    for piece in chunks:  # every chunk is in the text, in order, at most `overlap` back
        at = body.find(piece, max(0, position - overlap))
        assert at >= 0
        position = max(position, at)
    solid = Counter("".join(body.split()))
    assert not solid - Counter("".join("".join(chunks).split()))  # nothing is lost
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(body.split())


def test_recursive_prefers_coarse_boundaries():
    body = "first paragraph\n\nsecond one here\n\nthird"
    assert chunk.split_recursively(body, 20, 0) == ["first paragraph", "second one here", "third"]
    assert chunk.split_recursively("aaaa bbbb cccc", 10, 5) == ["aaaa bbbb", "bbbb cccc"]
    assert chunk.split_recursively("aaaa bbbb cccc", 10, 4) == ["aaaa bbbb", "cccc"]
    assert chunk.split_recursively("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


# ---- text ---------------------------------------------------------------------------


def test_document_types(spark):
    sources = ["X.MD", "a.mdx", "a.tsx", "a.ts", "a.js", "a.json", "a.txt", "md", ".md", None, "a.md.bak"]
    assert column(spark, sources, text.document_type) == [
        "markdown", "markdown", None, "code", "code", "json", "text", None, "markdown", None, None,
    ]


def test_keywords(spark):
    texts = [
        "The quick, QUICK brown fox jumps over lazy dogs again and again",
        "集約の設計セオリとは？",
        "alpha　beta gamma",
        "naïve résumé",
        "don't can't_stop it's",
        "",
    ]
    assert column(spark, texts, text.keywords) == [
        ["quick", "brown", "jumps", "over", "lazy"],
        [],
        ["alpha", "beta", "gamma"],
        ["nave", "rsum"],
        ["dont", "cant_stop"],
        [],
    ]


def test_summary(spark):
    texts = ["a" * 100, "b" * 101, "one\ntwo", "\nsecond", "", None]
    assert column(spark, texts, text.summary) == ["a" * 100, "b" * 100 + "...", "one", "", "", None]


def test_two_decimals(spark):
    numbers = [0.125, 1.005, 0.9, 0.0, 0.995, 12.3449, -0.001, -0.125]
    assert column(spark, numbers, text.two_decimals, "double") == [
        "0.13", "1.00", "0.90", "0.00", "1.00", "12.34", "0.00", "-0.13",
    ]


def test_query_text(spark):
    df = spark.createDataFrame([("q", "c"), ("q", ""), ("q", None)], "query string, context string")
    assert [r.search_text for r in enrich.query_context(df).collect()] == ["q c", "q", "q"]


def test_positions_and_spans(spark):
    rows = [
        ("abc\n", {}),
        ("one\ntwo\nthree", {"endLine": "9", "endColumn": "4"}),
        ("x", {"startLine": "3", "endLine": "bad"}),
        ("x", {"startLine": "bad"}),
        ("", {"endLine": "2"}),
    ]
    df = spark.createDataFrame(rows, "content string, metadata map<string,string>").coalesce(1)
    got = enrich.line_span(enrich.metadata_positions(df)).select(*enrich.POSITIONS).collect()
    assert [tuple(r) for r in got] == [
        (1, 2, 1, 3),
        (1, 3, 1, 3),
        (3, None, None, None),
        (None, None, None, None),
        (None, 2, None, None),
    ]


def test_filters(spark):
    rows = [("a.md", "markdown"), ("x.mdx", "markdown"), ("b.tsx", None), ("git-commit.md", "markdown"), ("A.MD", "markdown")]
    df = spark.createDataFrame(rows, "source string, document_type string")

    def left(kept):
        return [r.source for r in kept.collect()]

    assert left(filters.filter_document_types(df, [])) == [s for s, _ in rows]
    assert "b.tsx" not in left(filters.filter_document_types(df, ["markdown"]))
    assert left(filters.filter_document_types(df, ["Markdown"])) == []
    assert left(filters.filter_source_pattern(df, "")) == [s for s, _ in rows]
    assert left(filters.filter_source_pattern(df, "*.md")) == ["a.md", "x.mdx", "git-commit.md"]
    assert left(filters.filter_source_pattern(df, "git-*.md")) == ["git-commit.md"]
    with pytest.raises(Exception):
        filters.filter_source_pattern(df, "(").collect()
    dated = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-01-06"), (3, None)], "i int, d string").select(
        "i", F.to_timestamp("d").alias("modified_at")
    )
    assert [r.i for r in filters.filter_date_range(dated, "2024-01-06", "2024-01-06").collect()] == [2]
    assert [r.i for r in filters.filter_date_range(dated, date_to="2024-01-05").collect()] == [1]
    assert filters.filter_date_range(dated).count() == 3


def test_schema(spark):
    df = spark.createDataFrame([(1, "text", "7")], "chunk_id int, content string, chunk_no string")
    got = ensure_schema(df)
    assert got.schema == INDEX or [f.dataType for f in got.schema] == [f.dataType for f in INDEX]
    row = got.first()
    assert (row.chunk_id, row.chunk_no, row.embedding) == ("1", 7, None)
    with pytest.raises(ValueError, match="chunk_id"):
        ensure_schema(df.drop("chunk_id"))
    with pytest.raises(Exception):
        ensure_schema(df.withColumn("chunk_no", F.lit("seven"))).collect()


# ---- vectors ------------------------------------------------------------------------


def test_hash_counts_match_a_count_in_python(spark):
    import hashlib

    texts = ["a b a", "", "Éa, éa! x_1 日本 日本", None, "the the the cat"]
    got = column(spark, texts, lambda c: vectors.hash_counts(c, 16))
    dense = column(spark, texts, lambda c: c)
    for t, runs in zip(dense, got):
        if t is None:
            assert runs is None
            continue
        words = re.findall(r"\w+", t.lower())
        want = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in words)
        assert {r.bucket: r.cnt for r in runs} == want
    df = spark.createDataFrame([(t,) for t in texts], "content string").coalesce(1)
    lengths = [np.linalg.norm(r.embedding) for r in embed.embed_hash(df, "content", 16).collect()]
    assert np.allclose(lengths, [1, 0, 1, 0, 1])


@pytest.fixture(scope="module")
def cloud(spark):
    """Vectors of which a third are copies of one, with a zero and a missing vector."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(240, 12))
    points[:80] = points[0]
    points[90] = 0.0
    stored = [(f"c{i:03}", [float(x) for x in p]) for i, p in enumerate(points)] + [("none", None)]
    asked = [(i, [float(x) for x in p]) for i, p in enumerate(points) if i % 2 == 0] + [(999, None)]
    index = spark.createDataFrame(stored, "chunk_id string, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id bigint, query_vec array<double>").repartition(3)
    return points, queries, index


def similarity(a, b, metric):
    if metric == "l2":
        return 1 / (1 + math.dist(a, b))
    dot = float(np.dot(a, b))
    length = np.linalg.norm(a) * np.linalg.norm(b)
    return dot if metric == "ip" else (dot / length if length else 0.0)


def brute_force(points, k, metric):
    out = set()
    for i in range(0, len(points), 2):
        scored = sorted((-round(similarity(points[i], p, metric), 6), f"c{j:03}") for j, p in enumerate(points))
        out |= {(i, r + 1, c) for r, (_, c) in enumerate(scored[:k])}
    return out


def as_set(hits):
    return {(r.query_id, r.rank, r.chunk_id) for r in hits.collect()}


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_knn_matches_brute_force(cloud, metric):
    points, queries, index = cloud
    want = brute_force(points, 6, metric)
    assert as_set(vector.knn_exact(queries, index, 6, metric)) == want
    assert as_set(vector.knn_exact(queries, index, 6, metric, broadcast_bytes=2000, columns=3)) == want


def test_knn_edges(cloud):
    points, queries, index = cloud
    assert vector.knn_exact(queries, index, 0).count() == 0
    assert vector.knn_exact(queries, index.filter("false"), 3).count() == 0
    assert vector.knn_exact(queries.filter("false"), index, 3).count() == 0
    assert vector.knn_exact(queries.filter("query_id = 4"), index, 1000).count() == 240
    with pytest.raises(ValueError):
        vector.knn_exact(queries, index, 3, "manhattan")


def test_ivf_with_all_lists_is_exact_even_if_one_list_holds_a_third(cloud):
    points, queries, index = cloud
    centroids = vector.ivf_train(index, nlist=6)
    assigned = vector.ivf_assign(index, centroids)
    want = brute_force(points, 6, "cosine")
    assert as_set(vector.ann_ivf(queries, assigned, centroids, 6, 6)) == want
    assert as_set(vector.ann_ivf(queries, assigned, centroids, 6, 6, cell_rows=7, cell_queries=5)) == want


def test_ann_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(4)
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    index = table.select(F.col("vec_id").alias("chunk_id"), "embedding")
    exact = {(r.query_id, r.chunk_id): r.score for r in vector.knn_exact(queries, index, 5).collect()}

    def recall(hits):
        found = {(r.query_id, r.chunk_id): r.score for r in hits.collect()}
        assert len(found) == len(exact)  # no pair twice, k per query
        assert all(exact[pair] == score for pair, score in found.items() if pair in exact)
        return len(found.keys() & exact.keys()) / len(exact)

    assert recall(vector.ann_lsh(queries, index, 5)) > 0.9
    centroids = vector.ivf_train(index, nlist=16)
    assert recall(vector.ann_ivf(queries, vector.ivf_assign(index, centroids), centroids, 5, 8)) > 0.85


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.booleans())
def test_best_rows_with_many_ties(seed, k, positive):
    import pyarrow as pa

    from passagework.operators.best import BestRows

    rng = np.random.default_rng(seed)
    scores = rng.integers(-1, 3, size=(6, 200)) / 4 + rng.choice([0, 1e-9], size=(6, 200))
    ids = rng.permutation([f"c{i:03}" for i in range(200)])
    best = BestRows(6, k, 6, positive)
    for start in range(0, 200, 37):
        block = slice(start, start + 37)
        for first in (0, 4):
            best.offer(first, scores[first : first + 4, block], pa.array(ids[block]))
        if seed % 2:
            best.settle()
    got = {(r["query_id"], r["chunk_id"]) for b in best.result(pa.array(range(6))) for r in b.to_pylist()}
    want = set()
    for q in range(6):
        pairs = [(-round(x, 6), c) for x, c in zip(scores[q], ids) if x > 0 or not positive]
        want |= {(q, c) for _, c in sorted(pairs)[:k]}
    assert got == want


def test_knn_holds_few_rows_however_many_copies(spark):
    """All stored vectors are equal: the smallest ids win, and tasks stay small."""
    n = 20_000
    index = spark.range(n).select(
        F.format_string("c%06d", "id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")
    )
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit(2.0), F.lit(1.0)).alias("query_vec"))
    hits = vector.knn_exact(queries, index, 5)
    assert hits.filter(F.col("chunk_id") != F.format_string("c%06d", F.col("rank") - 1)).count() == 0
    assert hits.count() == 1500


# ---- keywords -----------------------------------------------------------------------


def bm25_by_hand(queries, chunks, k):
    words = {c: [w for w in re.split(r"\W+", t.lower()) if w] for c, t in chunks}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = set()
    for q, t in queries:
        scores = []
        for c, ws in words.items():
            tf, s = Counter(ws), 0.0
            for w in {w for w in re.split(r"\W+", t.lower()) if w}:
                if tf[w]:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    s += idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / avgdl))
            if s > 0:
                scores.append((-round(s, 6), c))
        out |= {(q, r + 1, c) for r, (_, c) in enumerate(sorted(scores)[:k])}
    return out


@pytest.fixture(scope="module")
def library(spark):
    """Chunks of which a third are the same text and most share one word; one is empty."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    chunks = []
    for i in range(150):
        body = "the same text" if i % 3 == 0 else "the " + " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))
        chunks.append((f"c{i:03}", "" if i == 149 else body))
    queries = [(i, " ".join(rng.choices(vocabulary + ["the", "same"], k=rng.randint(1, 8)))) for i in range(25)]
    queries += [(100, "absent words"), (101, "")]
    return (
        queries,
        chunks,
        spark.createDataFrame(queries, "query_id bigint, query string").repartition(2),
        spark.createDataFrame(chunks, "chunk_id string, content string").repartition(4),
    )


def test_bm25_matches_brute_force_on_every_plan(spark, library, tmp_path):
    asked, stored, queries, chunks = library
    want = bm25_by_hand(asked, stored, 7)
    assert as_set(keyword.keyword_bm25(queries, chunks, 7)) == want
    assert as_set(keyword.keyword_bm25(queries, chunks, 7, broadcast_rows=40)) == want
    path = str(tmp_path / "postings")
    store.write_postings(chunks, path)
    saved = store.load_postings(spark, path)
    assert as_set(keyword.keyword_bm25(queries, chunks, 7, stored_postings=saved)) == want
    assert as_set(keyword.keyword_bm25(queries, chunks, 7, stored_postings=saved, broadcast_rows=40)) == want


def test_many_query_words_use_a_broadcast_instead_of_a_filter(spark, library, monkeypatch):
    asked, stored, queries, chunks = library
    monkeypatch.setattr(keyword, "PUSHED_TOKENS", 5)
    monkeypatch.setattr(keyword, "BLOCK_CHUNKS", 11)
    saved = keyword.posting_blocks(chunks)
    assert as_set(keyword.keyword_bm25(queries, chunks, 7, stored_postings=saved)) == bm25_by_hand(asked, stored, 7)


def test_posting_blocks_hold_words_counts_and_bounds(spark, library, monkeypatch):
    _, stored, _, chunks = library
    monkeypatch.setattr(keyword, "BLOCK_CHUNKS", 20)
    rows = keyword.posting_blocks(chunks).collect()
    heads = {r.block: r for r in rows if r.token == keyword.HEADER}
    assert sorted(c for r in heads.values() for c in r.chunk_ids) == sorted(c for c, _ in stored)
    seen, texts = set(), dict(stored)
    for r in rows:
        if r.token != keyword.HEADER:
            dl = [heads[r.block].tfs[i] for i in r.rows]
            assert (r.n, r.max_tf, r.min_dl) == (len(r.rows), max(r.tfs), min(dl))
            seen |= {(r.token, heads[r.block].chunk_ids[i], tf) for i, tf in zip(r.rows, r.tfs)}
    assert seen == {(w, c, t.split().count(w)) for c, t in texts.items() for w in t.split()}


def test_large_limit_is_every_hit(library, monkeypatch):
    asked, stored, queries, chunks = library
    monkeypatch.setattr(keyword, "HELD_ROWS", 1000)
    assert as_set(keyword.keyword_bm25(queries, chunks, 2**31 - 1, stored_postings=keyword.posting_blocks(chunks))) == bm25_by_hand(asked, stored, 10_000)


def test_bm25_edges(library):
    _, _, queries, chunks = library
    assert keyword.keyword_bm25(queries, chunks, 0).count() == 0
    assert keyword.keyword_bm25(queries, chunks.filter("false"), 3).count() == 0
    assert keyword.keyword_bm25(queries.filter("false"), chunks, 3).count() == 0
    with pytest.raises(ValueError):
        keyword.keyword_bm25(queries, chunks, 3, tokenization="letters")


def test_whole_field_hits(spark, library):
    _, stored, _, chunks = library
    queries = spark.createDataFrame([(1, " the same text "), (2, "the same"), (3, "")], "query_id int, query string")
    want = sorted(c for c, t in stored if t == "the same text")[:4]
    got = keyword.keyword_bm25(queries, chunks, 4, tokenization="field").orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, c) for c in want]


def test_turns_of_queries_read_the_chunks_once(spark, monkeypatch):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    chunks = spark.createDataFrame([(f"c{i:02}", " ".join(words[i % 7 : i % 7 + 1 + i % 4])) for i in range(60)], "chunk_id string, content string")
    queries = spark.createDataFrame([(i, " ".join(words[i % 10 :] + words[: i % 3])) for i in range(30)], "query_id int, query string")
    want, passes, scan = as_set(keyword.keyword_bm25(queries, chunks, 5)), [], keyword.scan_chunks
    monkeypatch.setattr(keyword, "scan_chunks", lambda *args: passes.append(1) or scan(*args))
    assert as_set(keyword.keyword_bm25(queries, chunks, 5, broadcast_rows=12)) == want
    assert len(passes) == 1
    assert keyword.query_tiles(np.array([0, 0, 0, 1, 3, 3, 4]), 5, 2) == [(0, 1), (1, 3), (3, 4), (4, 5)]
