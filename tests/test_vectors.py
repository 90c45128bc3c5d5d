"""Searches that leave out parts of the index: pruned buckets, probed buckets, neighbour graphs."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.config import SearchConfig
from passagework.operators import embed, graph, vector
from passagework.operators.best import BestRows, half_up
from passagework.operators.chunk import chunk_fixed
from passagework.plans.search import saved_searcher, search, searcher
from passagework.sources import store
from passagework.sources.files import documents_from_table


def clustered(seed, n, dim=16, groups=12, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))


def frames(spark, stored, asked):
    index = spark.createDataFrame([(f"c{i:04}", None if v is None else [float(x) for x in v]) for i, v in enumerate(stored)], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(asked)], "query_id int, query_vec array<double>")
    return index.repartition(3), queries.repartition(2)


def rows(hits):
    return sorted(map(tuple, hits.select("query_id", "rank", "chunk_id", "score").collect()))


@pytest.fixture(scope="module")
def case(spark):
    vectors = list(clustered(1, 900))
    vectors[10:40] = [vectors[5]] * 30  # copies: ties everywhere
    vectors += [np.zeros(16), None, np.zeros(16)]
    asked = [*clustered(1, 30), vectors[5], np.zeros(16), None, -vectors[5]]
    index, queries = frames(spark, vectors, asked)
    centroids = vector.ivf_train(index, 12)
    assigned = vector.ivf_assign(index, centroids).cache()
    return index, queries, centroids, assigned


@pytest.mark.parametrize("k", [1, 7, 50, 2_000])
def test_pruned_search_is_exact(case, k):
    index, queries, centroids, assigned = case
    got = vector.knn_pruned(queries, assigned, centroids, vector.bucket_radii(assigned, centroids), k, first=2)
    assert rows(got) == rows(vector.knn_exact(queries, index, k))


def test_pruned_search_takes_turns(case, monkeypatch):
    index, queries, centroids, assigned = case
    monkeypatch.setattr(vector, "FEW_QUERIES", 10)
    got = vector.knn_pruned(queries, assigned, centroids, vector.bucket_radii(assigned, centroids), 5)
    assert rows(got) == rows(vector.knn_exact(queries, index, 5))


def test_buckets_that_cannot_matter_are_not_read(case, spark, tmp_path, monkeypatch):
    index, queries, centroids, _ = case
    path, read = str(tmp_path / "index"), []
    store.write_index(index, path, True, centroids)
    scored = vector.score_probes
    monkeypatch.setattr(vector, "score_probes", lambda block, probes, *rest: read.append(sum(map(len, probes))) or scored(block, probes, *rest))
    stored, radii = store.load_index(spark, path, ("chunk_id", "embedding")), store.load_radii(spark, path)
    near = queries.where("query_id < 30")
    got = vector.knn_pruned(near, stored, store.load_centroids(spark, path), radii, 5, first=1)
    assert rows(got) == rows(vector.knn_exact(near, index, 5))
    assert sum(read) < 30 * 12 / 2
    one = vector.knn_pruned(queries.where("query_id = 3"), stored, centroids, radii, 5, first=1)
    assert one.count() == 5
    with pytest.raises(store.UnreadableIndex):
        store.write_index(index, path)
        store.load_radii(spark, path)


def test_pruned_search_of_nothing(case, spark):
    index, queries, centroids, assigned = case
    radii = vector.bucket_radii(assigned, centroids)
    assert vector.knn_pruned(queries, assigned, centroids, radii, 0).count() == 0
    assert vector.knn_pruned(queries.where("false"), assigned, centroids, radii, 3).count() == 0
    nothing = assigned.where("false")
    assert vector.knn_pruned(queries, nothing, centroids, vector.bucket_radii(nothing, centroids), 3).count() == 0


def test_probes_by_broadcast_equal_cells(case):
    _, queries, centroids, assigned = case
    got = vector.ann_ivf(queries, assigned, centroids, 6, nprobe=3)
    assert rows(got) == rows(vector.ann_ivf(queries, assigned, centroids, 6, nprobe=3, cell_rows=50))
    assert "Exchange hashpartitioning(cell" not in got._jdf.queryExecution().executedPlan().toString()


def test_lsh_by_broadcast_equals_cells(case):
    index, queries, _, _ = case
    some = queries.where("query_id <> 31")
    got = vector.ann_lsh(some, index, 6, bucket_length=0.6)
    assert rows(got) == rows(vector.ann_lsh(some, index, 6, bucket_length=0.6, cell_rows=100))
    assert got.where("query_id = 3 AND rank = 1").count() == 1
    assert vector.ann_lsh(queries.where("false"), index, 3).count() == vector.ann_lsh(some, index.where("false"), 3).count() == 0
    assert rows(vector.ann_lsh(some, index, 5, bucket_length=100.0, tables=1)) != []


def recall(hits, exact):
    got, want = ({(r.query_id, r.chunk_id) for r in x.collect()} for x in (hits, exact))
    return len(got & want) / len(want)


@pytest.mark.parametrize("shard_rows", [10_000, 150])
def test_graph_finds_neighbours_with_exact_scores(case, shard_rows):
    index, queries, _, _ = case
    some = queries.where("query_id <> 31")  # a query without words has no nearest vector
    hits = graph.ann_graph(some, graph.build_graph(index, shard_rows=shard_rows), 10).cache()
    exact = vector.knn_exact(some, index, 10)
    score = {(r.query_id, r.chunk_id): r.score for r in vector.knn_exact(some, index, 1_000).collect()}
    assert hits.count() == 320
    assert all(score[r.query_id, r.chunk_id] == r.score for r in hits.collect())
    best = {(r.query_id, r.rank): r.score for r in exact.collect()}
    assert sum(r.score >= best[r.query_id, 10] for r in hits.collect()) >= 0.95 * 320  # ties are as good


def test_graph_of_random_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    index, queries = frames(spark, rng.normal(size=(3_000, 32)), rng.normal(size=(60, 32)))
    built = graph.build_graph(index, 3_000).cache()
    exact = vector.knn_exact(queries, index, 10)
    assert recall(graph.ann_graph(queries, built, 10, beam=100), exact) >= 0.9
    monkeypatch.setattr(graph, "FEW_QUERIES", 25)
    assert recall(graph.ann_graph(queries, built, 10, beam=100), exact) >= 0.9


def test_graph_of_few_vectors(spark):
    for n in (1, 2, 5, 70):
        index, queries = frames(spark, clustered(2, n), clustered(3, 4))
        assert rows(graph.ann_graph(queries, graph.build_graph(index), 3)) == rows(vector.knn_exact(queries, index, 3))
    index, queries = frames(spark, [None, *clustered(2, 3)], [None, *clustered(3, 2)])
    assert rows(graph.ann_graph(queries, graph.build_graph(index), 9)) == rows(vector.knn_exact(queries, index, 9))
    assert graph.ann_graph(queries, graph.build_graph(index.where("false")), 3).count() == 0
    assert graph.ann_graph(queries.where("false"), graph.build_graph(index), 3).count() == 0
    assert graph.ann_graph(queries, graph.build_graph(index), 0).count() == 0
    with pytest.raises(ValueError, match="cosine"):
        graph.ann_graph(queries, graph.build_graph(index), 3, "l2")


def test_every_vector_can_be_reached():
    points = vector.prepare(clustered(7, 2_000, groups=3, spread=0.01), "cosine").astype(np.float32)
    links = graph.near_links(points, 8)
    assert links.shape == (2_000, 16) and (links < 2_000).all()
    assert all(len(set(x[x >= 0]) & {i}) == 0 for i, x in enumerate(links))
    assert (np.bincount(links[links >= 0], minlength=2_000) > 0).all()


def documents(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id int, text string")
    return chunk_fixed(documents_from_table(docs, source=F.lit("a.md")), 100, 0)


@pytest.mark.parametrize("name", ["exact", "pruned", "ivf", "graph"])
def test_saved_searchers_serve_search(spark, tmp_path, name):
    """Each way of searching a saved index that has grown and of which documents were replaced."""
    path = str(tmp_path / "index")
    vectors = lambda df: embed.embed_hash(df, "content", 64)
    first = vectors(documents(spark, {i: f"alpha{i} beta{i % 3} gamma" for i in range(40)}))
    buckets = {"bucketed": True, "centroids": vector.ivf_train(first, 4)} if name in ("pruned", "ivf") else {}
    store.write_index(first, path, with_graph=name == "graph", **buckets)
    store.append_index(spark, path, documents(spark, {7: "now about delta", 50: "alpha7 beta1 gamma"}), vectors)
    options = {"nprobe": 4} if name == "ivf" else {}
    queries = spark.createDataFrame([(1, "alpha7 beta1 gamma"), (2, "about delta"), (3, "alpha9")], "query_id int, query string")
    config = SearchConfig(limit=3, threshold=0.1, dim=64)
    index = store.load_index(spark, path)
    got = search(queries, index, config, knn=saved_searcher(spark, path, name, **options))
    want = search(queries, index, config)
    keep = ["query_id", "rank", "chunk_id", "score"]
    assert sorted(map(tuple, got.select(keep).collect())) == sorted(map(tuple, want.select(keep).collect()))
    assert got.where("query_id = 1 AND rank = 1").first()["chunk_id"] == "50#0"


def test_searchers_say_what_they_need(spark, tmp_path):
    for name, missing in (("graph", "graph"), ("ivf", "centroids"), ("pruned", "centroids")):
        with pytest.raises(ValueError, match=missing):
            searcher(name)
    with pytest.raises(ValueError, match="radii"):
        searcher("pruned", centroids=np.zeros((2, 3)))
    with pytest.raises(store.UnreadableIndex):
        store.write_index(embed.embed_hash(documents(spark, {1: "a"}), "content", 16), str(tmp_path / "index"))
        saved_searcher(spark, str(tmp_path / "index"), "graph")


def test_pairs_and_blocks_are_held_alike():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 9, (6, 200)) / 8.0, pa.array([f"x{i:03}" for i in rng.permutation(200)])
    by_block, by_pair, by_number = BestRows(6, 5, 6), BestRows(6, 5, 6), BestRows(6, 5, 6)
    by_block.offer(0, scores, ids)
    for at in range(0, 200, 20):
        q = np.repeat(np.arange(6), 20)
        by_pair.offer_pairs(q, scores[:, at : at + 20].ravel(), pa.concat_arrays([ids[at : at + 20]] * 6))
        order = rng.permutation(6)
        by_number.offer(order, scores[order, at : at + 20], ids[at : at + 20])
    names = pa.array(range(6))
    want = sorted(map(str, pa.Table.from_batches(by_block.result(names)).to_pylist()))
    assert want == sorted(map(str, pa.Table.from_batches(by_pair.result(names)).to_pylist()))
    assert want == sorted(map(str, pa.Table.from_batches(by_number.result(names)).to_pylist()))


def test_small_cells_wished_for_do_not_multiply_copies(case):
    """Every bucket is probed by every query: wished-for cells of one row would copy all of it for each query."""
    _, queries, centroids, assigned = case
    q = queries.withColumn("vec", F.col("query_vec")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(centroids) - 1))))
    v = assigned.select("chunk_id", F.col("embedding").alias("vec"), "bucket")
    cores = queries.sparkSession.sparkContext.defaultParallelism
    left, right = vector.bucket_cells(q.select("query_id", "vec", "bucket"), v, 10_000, cell_rows=1, cell_queries=1)
    vectors = right.count()
    assert vectors <= cores * v.count()
    assert left.count() <= max(cores * q.count(), vectors + q.count())


def test_queries_that_a_task_should_not_hold_are_dealt_over_a_grid(case, monkeypatch):
    index, queries, _, _ = case
    want = vector.knn_exact(queries, index, 5)
    monkeypatch.setattr(vector, "FEW_QUERIES", 10)
    monkeypatch.setattr(vector, "CELL_HITS", 100)
    got = vector.knn_exact(queries, index, 5)
    assert "hashpartitioning(cell" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(want)


def wild(seed, n):
    """Vectors of very different lengths, zero vectors and copies among them."""
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, 24)) * 10.0 ** rng.integers(-3, 3, n)[:, None]
    out[rng.integers(0, n, n // 50)] = 0.0
    out[rng.integers(0, n, n // 10)] = out[0]
    return out


@pytest.mark.parametrize("long", [1.0, 1e30])
@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_single_precision_loses_no_neighbour(metric, long):
    asked, stored = wild(3, 60), wild(4, 7_000)
    asked[7], stored[100], stored[101] = stored[3_000], asked[9] * long, np.nan
    asked, stored = vector.prepare(asked, metric), vector.prepare(stored, metric)
    ids = pa.array(np.random.default_rng(5).permutation(len(stored)))
    best = BestRows(len(asked), 6, 6)
    sieve = vector.Sieve(asked, metric)
    for at in range(0, len(stored), 3_000):
        vector.score_block(best, sieve, stored[at : at + 3_000], ids[at : at + 3_000])
    got = [(r["query_id"], r["chunk_id"]) for b in best.result(pa.array(range(len(asked)))) for r in b.to_pylist()]
    rounded = half_up(np.nan_to_num(vector.similarity(asked, stored, metric), nan=-np.inf), 6)
    for i in range(len(asked)):
        order = np.lexsort((ids.to_numpy(), -rounded[i]))[:6]
        assert sorted(c for q, c in got if q == i) == sorted(ids.to_numpy()[order].tolist())


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_few_pairs_are_scored_exactly(metric, monkeypatch):
    asked, stored = np.random.default_rng(6).normal(size=(2, 20_000, 16))
    asked, scored, similarity, by_pair = asked[:300], [], vector.similarity, vector.pair_similarity
    monkeypatch.setattr(vector, "similarity", lambda q, v, m: scored.append(len(q) * len(v)) or similarity(q, v, m))
    monkeypatch.setattr(vector, "pair_similarity", lambda q, v, m: scored.append(len(q)) or by_pair(q, v, m))
    best = BestRows(len(asked), 5, 6)
    vector.score_block(best, vector.Sieve(asked, metric), stored, pa.array(range(len(stored))))
    assert sum(scored) < len(asked) * len(stored) / 20


def test_pruned_search_of_many_queries_stays_in_tables(case, monkeypatch):
    """Queries are dealt to the buckets they need; no hit comes to the driver."""
    index, queries, centroids, assigned = case
    twice = queries.unionAll(queries.filter("query_id < 5")).unionAll(queries.filter("query_id = 7").withColumn("query_id", F.lit(None).cast("int")))
    monkeypatch.setattr(vector, "FEW_QUERIES", 10)
    monkeypatch.setattr(vector, "score_probes", None)
    probes, needed = [], vector.needed_buckets

    def counted(*args):
        found = needed(*args)
        probes.append(found.count())
        return found

    monkeypatch.setattr(vector, "needed_buckets", counted)
    got = vector.knn_pruned(twice, assigned, centroids, vector.bucket_radii(assigned, centroids), 5, first=2)
    assert {r: n for r, n in Counter(map(tuple, got.collect())).items()} == {r: n for r, n in Counter(map(tuple, vector.knn_exact(twice, index, 5).collect())).items()}
    assert sum(probes) < 39 * 8  # of 12 buckets


def test_pruned_search_of_many_hits_takes_turns(case, monkeypatch):
    index, queries, centroids, assigned = case
    monkeypatch.setattr(vector, "FEW_QUERIES", 10)
    monkeypatch.setattr(vector, "CELL_HITS", 1_000)
    got = vector.knn_pruned(queries, assigned, centroids, vector.bucket_radii(assigned, centroids), 5)
    assert rows(got) == rows(vector.knn_exact(queries, index, 5))


def test_a_grid_has_no_more_columns_than_its_cores_need(spark):
    """Every column copies all queries and returns ``k`` rows for each of them."""
    cores = spark.sparkContext.defaultParallelism
    assert vector.grid_columns(spark, 600_000, 150_000, 4 * cores) == 1
    assert vector.grid_columns(spark, 50_000, 50_000, 2) == cores
