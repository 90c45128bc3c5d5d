"""The saved index: manifests, buckets, postings, edits."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework import schema
from passagework.operators import embed, keyword, vector
from passagework.operators.chunk import chunk_fixed
from passagework.plans.build import load_or_build
from passagework.sources import manifests, store
from passagework.sources.files import documents_from_table


def chunks_of(spark, *rows):
    docs = spark.createDataFrame(list(rows), "doc_id int, text string")
    return chunk_fixed(documents_from_table(docs, source=F.lit("a.md")), 20, 0)


def vectors(df):
    return embed.embed_hash(df, "content", 16)


def texts(index):
    return sorted((r.doc_id, r.content) for r in index.select("doc_id", "content").collect())


def test_bucketed_index_loads_and_grows(spark, tmp_path):
    path, before = str(tmp_path / "index"), list(schema.INDEX.fields)
    first = vectors(chunks_of(spark, (1, "red apple"), (2, "green apple"), (3, "blue sky")))
    centroids = vector.ivf_train(first, 2)
    store.write_index(first, path, True, centroids, with_postings=True)
    for _ in range(2):
        assert "bucket" in store.load_index(spark, path).columns
    assert list(schema.INDEX.fields) == before
    store.append_index(spark, path, chunks_of(spark, (4, "red wine"), (3, "blue sky")), vectors)
    index = store.load_index(spark, path)
    assert texts(index) == [("1", "red apple"), ("2", "green apple"), ("3", "blue sky"), ("4", "red wine")]
    assert np.array_equal(store.load_centroids(spark, path), centroids)
    again = vector.ivf_assign(index.drop("bucket"), centroids)
    assert sorted(map(tuple, index.select("chunk_id", "bucket").collect())) == sorted(map(tuple, again.select("chunk_id", "bucket").collect()))
    queries = vectors(spark.createDataFrame([(0, "red wine")], "query_id int, content string")).select("query_id", F.col("embedding").alias("query_vec"))
    assert vector.ann_ivf(queries, index, centroids, 1, 2).first()["chunk_id"] == "4#0"


def test_edits_replace_and_copies_stay_out(spark, tmp_path):
    path = str(tmp_path / "index")
    long = "one two three four five six seven eight nine ten"
    store.append_index(spark, path, chunks_of(spark, (1, long), (2, "same")), vectors, with_postings=True)
    more = chunks_of(spark, (1, "short now"), (2, "same"), (3, "new"))
    store.append_index(spark, path, more.unionAll(more), vectors)
    index = store.load_index(spark, path)
    assert texts(index) == [("1", "short now"), ("2", "same"), ("3", "new")]
    kept = store.load_postings(spark, path)
    live = kept.where("token <> '' AND size(array_except(rows, coalesce(gone, array()))) > 0")
    assert sorted(r.token for r in live.collect()) == ["new", "now", "same", "short"]
    assert store.collection_counts(spark, path) == keyword.Collection(3, 4 / 3)
    store.append_index(spark, path, chunks_of(spark, (1, long)), vectors)
    back = store.load_index(spark, path).where("doc_id = '1'").orderBy("chunk_no").collect()
    assert "".join(r.content for r in back).replace(" ", "") == long.replace(" ", "")
    store.write_index(store.load_index(spark, path), path)
    assert store.load_index(spark, path).count() == 5


def test_postings_after_an_append_equal_a_rebuilt_index(spark, tmp_path):
    path = str(tmp_path / "index")
    all_chunks = chunks_of(spark, *[(i, f"word{i % 3} common text {i}") for i in range(12)])
    store.write_index(vectors(all_chunks.filter("doc_id < '5'")), path, with_postings=True)
    store.append_index(spark, path, all_chunks, vectors)
    queries = spark.createDataFrame([(0, "word1 common"), (1, "7")], "query_id int, query string")
    saved = keyword.keyword_bm25(
        queries, store.load_index(spark, path), 20, stored_postings=store.load_postings(spark, path), collection=store.collection_counts(spark, path)
    )
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, keyword.keyword_bm25(queries, all_chunks, 20).collect()))


def test_unreadable_index_is_left_alone(spark, tmp_path):
    (tmp_path / "a.md").write_text("text", encoding="utf-8")
    broken = tmp_path / ".vector-store"
    broken.mkdir()
    (broken / "x.parquet").write_text("not parquet")
    assert store.load_index(spark, str(broken)) is None
    with pytest.raises(store.UnreadableIndex):
        load_or_build(spark, str(tmp_path))
    with pytest.raises(store.UnreadableIndex):
        store.append_index(spark, str(broken), chunks_of(spark, (1, "a")), vectors)
    assert (broken / "x.parquet").read_text() == "not parquet"


def test_build_in_buckets(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.md").write_text(f"text number {i}", encoding="utf-8")
    index = load_or_build(spark, str(tmp_path), searcher="ivf", nlist=2)
    assert index.count() == 6 and {r.bucket for r in index.select("bucket").collect()} <= {0, 1}
    assert load_or_build(spark, str(tmp_path)).columns == index.columns
    with pytest.raises(ValueError, match="Unsupported searcher"):
        load_or_build(spark, str(tmp_path), searcher="other")
    with pytest.raises(ValueError, match="nlist"):
        load_or_build(spark, str(tmp_path), searcher="ivf")


def test_old_segments_go_after_two_writes(spark, tmp_path):
    path = tmp_path / "index"
    index = vectors(chunks_of(spark, (1, "a")))
    for _ in range(4):
        store.write_index(index, str(path))
    assert len([p for p in path.iterdir() if p.name.startswith("chunks=")]) == 2
    assert len([p for p in path.iterdir() if p.name.startswith("manifest-")]) == 2


def test_interleaved_appends_keep_both(spark, tmp_path):
    """While one job embeds, another publishes: the first starts again, and nothing is lost or doubled."""
    path = str(tmp_path / "index")
    store.append_index(spark, path, chunks_of(spark, (1, "first")), vectors, with_postings=True)
    others = [chunks_of(spark, (2, "second"), (3, "third, by the other")), chunks_of(spark, (4, "fourth"))]

    def slow(df):
        if others:
            store.append_index(spark, path, others.pop(), vectors)
        return vectors(df)

    store.append_index(spark, path, chunks_of(spark, (3, "third"), (1, "first")), slow)
    assert texts(store.load_index(spark, path)) == [("1", "first"), ("2", "second"), ("3", "third"), ("4", "fourth")]
    assert not [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("_writing")]
    chunk_dirs = {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("chunks=")}
    assert chunk_dirs == {s["chunks"] for s in manifests.read_manifest(spark, path)["segments"]}


def test_only_one_of_two_writers_publishes(spark, tmp_path):
    path = str(tmp_path / "index")
    store.write_index(vectors(chunks_of(spark, (1, "a"))), path)
    manifest, top = manifests.newest(spark, path)
    manifests.publish(spark, path, manifest, top)
    with pytest.raises(manifests.ConcurrentWrite):
        manifests.publish(spark, path, manifest, top)
    assert not manifests.put_if_absent(spark, f"{path}/manifest-{top + 1:08d}.json", "other")
    assert manifests.read_manifest(spark, path)["parent"] == top


def test_unfinished_manifest_is_passed_over(spark, tmp_path):
    path = tmp_path / "index"
    store.append_index(spark, str(path), chunks_of(spark, (1, "a")), vectors)
    (path / "manifest-00000007.json").write_text('{"segments": [{"chu')
    assert texts(store.load_index(spark, str(path))) == [("1", "a")]
    store.append_index(spark, str(path), chunks_of(spark, (2, "b")), vectors)
    assert texts(store.load_index(spark, str(path))) == [("1", "a"), ("2", "b")]
    (path / "chunks=unfinished").mkdir()
    assert manifests.vacuum(spark, str(path)) == []
    assert manifests.vacuum(spark, str(path), 0) == ["chunks=unfinished"]
    assert store.load_index(spark, str(path)).count() == 2


def test_emptied_and_removed_documents_go(spark, tmp_path):
    path = str(tmp_path / "index")
    store.append_index(spark, path, chunks_of(spark, (1, "one"), (2, "two"), (3, "three")), vectors, with_postings=True)
    read = spark.createDataFrame([("1",), ("2",), ("9",), (None,)], "doc_id string")
    store.append_index(spark, path, chunks_of(spark, (2, "two")), vectors, documents=read)
    assert texts(store.load_index(spark, path)) == [("2", "two"), ("3", "three")]
    store.remove_documents(spark, path, spark.createDataFrame([("3",)], "doc_id string"))
    assert texts(store.load_index(spark, path)) == [("2", "two")]
    assert store.collection_counts(spark, path) == keyword.Collection(1, 1.0)


def test_compaction_merges_and_keeps_later_writes(spark, tmp_path, monkeypatch):
    path = tmp_path / "index"
    for i in range(5):
        store.append_index(spark, str(path), chunks_of(spark, (i, f"text {i}"), (100, f"edited {i}")), vectors, with_postings=True)
    before = texts(store.load_index(spark, str(path)))
    write = store.write_segment

    def overtaken(*args):
        monkeypatch.setattr(store, "write_segment", write)
        segment = write(*args)
        store.append_index(spark, str(path), chunks_of(spark, (7, "late"), (2, "text 2 edited late")), vectors)
        return segment

    monkeypatch.setattr(store, "write_segment", overtaken)
    store.compact_index(spark, str(path))
    expected = sorted([x for x in before if x[0] != "2"] + [("2", "text 2 edited late"), ("7", "late")])
    assert texts(store.load_index(spark, str(path))) == expected
    assert len(manifests.read_manifest(spark, str(path))["segments"]) == 2
    store.compact_index(spark, str(path))
    index = store.load_index(spark, str(path))
    assert texts(index) == expected
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    store.append_index(spark, str(path), chunks_of(spark, (8, "more")), vectors)
    held = {p.name for p in path.iterdir() if p.name.startswith(("chunks=", "postings=", "removed="))}
    assert held == manifests.parts_of(manifests.read_manifest(spark, str(path)))


def test_compaction_of_a_rewritten_index_is_refused(spark, tmp_path, monkeypatch):
    path, write = str(tmp_path / "index"), store.write_segment
    for i in range(2):
        store.append_index(spark, path, chunks_of(spark, (i, "text")), vectors)

    def overtaken(*args):
        monkeypatch.setattr(store, "write_segment", write)
        store.write_index(vectors(chunks_of(spark, (9, "all new"))), path)
        return write(*args)

    monkeypatch.setattr(store, "write_segment", overtaken)
    with pytest.raises(manifests.ConcurrentWrite):
        store.compact_index(spark, path)
    assert texts(store.load_index(spark, path)) == [("9", "all new")]


def test_files_of_other_dates_are_not_read(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("text "), "id").alias("content"),
                                   F.lit("a.md").alias("source"), F.expr("TIMESTAMP'2024-01-01' + make_interval(0, 0, 0, id)").alias("modified_at"))
    index = vectors(chunk_fixed(docs.withColumn("metadata", F.lit(None).cast("map<string,string>")), 100, 0))
    undated = index.limit(1).withColumns({"modified_at": F.lit(None).cast("timestamp"), "chunk_id": F.lit("none")})
    store.write_index(index.unionByName(undated), path, by_date=8)
    whole = store.load_index(spark, path)
    some = store.open_index(spark, path, since="2024-02-01", until="2024-02-10")
    assert (whole.count(), some.count()) == (401, 10)
    assert {r.modified_at.month for r in some.collect()} == {2}
    assert 1 <= len(some.inputFiles()) <= 2 < 6 <= len(whole.inputFiles())
    store.append_index(spark, path, chunks_of(spark, (1000, "undated")), vectors)
    assert store.open_index(spark, path, since="2024-02-01", until="2024-02-10").count() == 10
    assert store.open_index(spark, path, since="2030-01-01").count() == 0
    with pytest.raises(ValueError, match="not by both"):
        store.write_index(index, path, bucketed=True, by_date=8)


def test_refresh_follows_the_files(spark, tmp_path):
    import os

    from passagework.plans.build import refresh_index

    seen = spark.sparkContext.accumulator(0)

    def noted(df):
        count = F.udf(lambda t: seen.add(1) or t, "string").asNondeterministic()
        return embed.embed_hash(df.withColumn("content", count("content")), "content")

    for name, text in (("a", "one"), ("b", "two"), ("c", "three"), ("d", "four")):
        (tmp_path / f"{name}.md").write_text(text, encoding="utf-8")
    held = lambda index: sorted((os.path.basename(r.source), r.content) for r in index.collect())
    first = [("a.md", "one"), ("b.md", "two"), ("c.md", "three"), ("d.md", "four")]
    assert held(refresh_index(spark, str(tmp_path), embed=noted)) == first
    before = seen.value
    assert held(refresh_index(spark, str(tmp_path), embed=noted)) == first
    assert seen.value == before
    (tmp_path / "a.md").write_text("one edited", encoding="utf-8")
    os.utime(tmp_path / "a.md", (4e9, 4e9))
    (tmp_path / "b.md").write_text("", encoding="utf-8")
    os.utime(tmp_path / "b.md", (4e9, 4e9))
    (tmp_path / "c.md").unlink()
    (tmp_path / "e.md").write_text("five", encoding="utf-8")
    assert held(refresh_index(spark, str(tmp_path), embed=noted)) == [("a.md", "one edited"), ("d.md", "four"), ("e.md", "five")]
    assert seen.value == before + 2
    assert held(refresh_index(spark, str(tmp_path), embed=noted)) == [("a.md", "one edited"), ("d.md", "four"), ("e.md", "five")]


def test_appends_shuffle_marks_and_no_texts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rows = [(i, f"text number {i} " * 3) for i in range(40)]
    store.append_index(spark, path, chunks_of(spark, *rows[:20]), vectors)
    seen, write = [], store.write_segment
    monkeypatch.setattr(store, "write_segment", lambda index, *rest: seen.append(index) or write(index, *rest))
    store.append_index(spark, path, chunks_of(spark, (0, "another text"), *rows[1:]), vectors)
    assert "Exchange hashpartitioning" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert texts(store.load_index(spark, path)) == texts(chunks_of(spark, (0, "another text"), *rows[1:]))


def test_of_chunks_that_stand_twice_one_is_taken(spark, tmp_path):
    path = str(tmp_path / "index")
    old, new = chunks_of(spark, (1, "first text"), (2, "same")), chunks_of(spark, (1, "other text"), (3, "more"))
    store.append_index(spark, path, old.unionAll(new).unionAll(old), vectors)
    held = texts(store.load_index(spark, path))
    assert [i for i, _ in held] == ["1", "2", "3"]
    assert held[0][1] in ("first text", "other text")
    store.append_index(spark, path, old.unionAll(new), vectors)
    assert texts(store.load_index(spark, path)) == held


def test_parts_of_a_large_table_do_not_grow(spark, tmp_path):
    from passagework.checks import inputs

    spark.range(20_000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    cores, table = spark.sparkContext.defaultParallelism, lambda: spark.read.parquet(str(tmp_path / "t"))
    assert inputs.spread(table()).rdd.getNumPartitions() == cores
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
        splits = table().rdd.getNumPartitions()
        assert splits > cores
        assert inputs.spread(table()).rdd.getNumPartitions() == inputs.SPREAD * splits
        assert inputs.spread(table()).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_of_a_bucket_grow_with_its_rows(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.sha2(F.col("id").cast("string"), 512)).alias("content"))
    chunks = chunk_fixed(documents_from_table(docs.repartition(16), content="content", source=F.lit("a.md")), 1000, 0)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "16k")
    try:
        store.write_index(vectors(chunks), path, True, np.eye(1, 16))
    finally:
        spark.conf.set(size, before)
    index = store.load_index(spark, path)
    assert index.count() == 4000 and index.select("bucket").distinct().count() == 1
    assert len(index.inputFiles()) > 8


def test_training_embeds_a_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<double>")
    def model(texts: pa.Array) -> pa.Array:
        seen.add(len(texts))
        return pa.array([None if t.as_py() == "none" else [float(len(t.as_py())), 1.0] for t in texts], pa.list_(pa.float64()))

    texts = spark.createDataFrame([("a" * i,) for i in range(1, 40)] + [("none",)], "content string")
    centroids = vector.ivf_train(texts.withColumn("embedding", model("content")), 2, iterations=5)
    assert centroids.shape == (2, 2)
    assert seen.value == 40
