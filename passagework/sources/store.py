"""The saved index: chunks with their vectors, and beside them buckets and postings.

An index is a directory of segments and of numbered manifests (see
:mod:`passagework.sources.manifests`).  A write adds a segment and then publishes a manifest
that makes it visible, so readers see the old index or the new one, a failed job leaves
what was there, and no data is renamed.  Of two writers that start from the same
manifest one has to start again, so no write is lost.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.config import BROADCAST_ROWS
from passagework.operators.filters import filter_date_range
from passagework.operators.graph import GRAPH, build_graph
from passagework.operators.keyword import Collection, block_counts, field_digest, posting_blocks
from passagework.operators.vector import bucket_radii, ivf_assign
from passagework.schema import BLOCKS, INDEX, ensure_schema
from passagework.sources.manifests import (
    ConcurrentWrite,
    UnreadableIndex,
    delete_parts,
    manifests,
    newest,
    parts_of,
    publish,
    read_manifest,
)
from passagework.sources.scratch import written

log = logging.getLogger(__name__)

BUCKET = T.StructField("bucket", T.IntegerType())
# What is stored besides the columns of the index: a hash of the text, and a digest of the trimmed text.
STORED = T.StructType(INDEX.fields + [T.StructField("digest", T.LongType()), T.StructField("field_digest", T.BinaryType())])
ATTEMPTS = 5  # of a write that others overtake
NEW = {"segments": [], "removed": [], "bucketed": False, "postings": False, "by_date": 0, "graph": False, "centroids": None, "retired": []}


# ---- writing ------------------------------------------------------------------------


def new_tag() -> str:
    return f"s{uuid.uuid4().hex}"


def with_stored_columns(index: DataFrame) -> DataFrame:
    extra = [BUCKET.name] if BUCKET.name in index.columns else []
    full = ensure_schema(index, T.StructType(INDEX.fields + [BUCKET] * len(extra)), ("chunk_id",))
    return full.withColumns({"digest": F.xxhash64("content"), "field_digest": field_digest(F.col("content"))})


def write_segment(index: DataFrame, path: str, layout: dict) -> dict:
    """Write a segment below ``path`` in the layout of a manifest; nothing refers to it yet."""
    spark = index.sparkSession
    tag = new_tag()
    segment = {"chunks": f"chunks={tag}", "postings": None, "files": None, "buckets": None, "graph": None}
    rows, seen = with_stored_columns(index), Observation()
    if layout["bucketed"]:
        # a bucket's rows go to few files, not to one file of every task; their number grows with
        # the rows, so what a task sorts and writes does not
        rows = rows.hint("rebalance", "bucket")
    elif layout["by_date"]:
        rows = rows.repartitionByRange(layout["by_date"], "modified_at").sortWithinPartitions("modified_at")
    writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write
    (writer.partitionBy("bucket") if layout["bucketed"] else writer).parquet(f"{path}/{segment['chunks']}")
    if layout["by_date"]:
        segment["files"] = f"files={tag}"
        write_date_ranges(spark, f"{path}/{segment['chunks']}", f"{path}/{segment['files']}")
    if layout["bucketed"] and layout["centroids"] is not None:
        segment["buckets"] = f"buckets={tag}"
        stored = spark.read.schema(T.StructType(STORED.fields + [BUCKET])).parquet(f"{path}/{segment['chunks']}")
        bucket_radii(stored, np.array(layout["centroids"])).write.parquet(f"{path}/{segment['buckets']}")
    if layout["postings"]:
        segment["postings"] = f"postings={tag}"
        stored = spark.read.schema(STORED).parquet(f"{path}/{segment['chunks']}")
        write_postings(stored, f"{path}/{segment['postings']}", tag=tag)
    if layout.get("graph"):
        segment["graph"] = f"graph={tag}"
        stored = spark.read.schema(STORED).parquet(f"{path}/{segment['chunks']}")
        build_graph(stored, seen.get["n"]).write.parquet(f"{path}/{segment['graph']}")
    return segment | {"n": seen.get["n"]}


def write_date_ranges(spark: SparkSession, chunks: str, target: str) -> None:
    """``(file, since, until)``: the least and greatest ``modified_at`` of every file of a segment."""
    dated = spark.read.schema(STORED).parquet(chunks).select(F.col("_metadata.file_path").alias("file"), "modified_at")
    ranges = dated.groupBy("file").agg(F.min("modified_at").alias("since"), F.max("modified_at").alias("until"))
    ranges.write.parquet(target)


def write_index(
    index: DataFrame,
    path: str,
    bucketed: bool = False,
    centroids: np.ndarray | None = None,
    with_postings: bool = False,
    by_date: int = 0,
    with_graph: bool = False,
) -> None:
    """Save ``index``, replacing what is at ``path``; it may be read from there.

    ``bucketed`` partitions the segment by ``bucket`` (of ``ivf_assign``), so that a
    search reads only the buckets it probes; with ``centroids`` saved, rows appended
    later are assigned too.  ``with_postings`` keeps postings in step with the chunks.
    ``by_date`` clusters the rows of a segment by ``modified_at`` in as many files, so that
    :func:`open_index` reads only the files of the dates asked for.  ``with_graph`` keeps a
    neighbour graph of each segment's vectors.
    """
    if bucketed and by_date:
        raise ValueError("an index is clustered by bucket or by date, not by both")
    spark = index.sparkSession
    if centroids is not None and BUCKET.name not in index.columns:
        index = ivf_assign(index, centroids)
    layout = NEW | {"bucketed": bucketed, "postings": with_postings, "by_date": by_date, "graph": with_graph}
    layout["centroids"] = None if centroids is None else np.asarray(centroids).tolist()
    segment = write_segment(index, path, layout)
    for _ in range(ATTEMPTS):  # whatever others have written is replaced
        before, top = newest(spark, path) if manifests(spark, path) else (None, -1)
        try:
            return publish(spark, path, layout | {"segments": [segment], "retired": sorted(parts_of(before)) if before else []}, top)
        except ConcurrentWrite:
            continue
    raise ConcurrentWrite(f"The index at {path} was written by other jobs {ATTEMPTS} times meanwhile")


def write_postings(chunks: DataFrame, path: str, fields: tuple[str, ...] = ("content",), tag: str = "") -> None:
    """Save the posting blocks of ``chunks`` in a new directory, sorted by word inside each file.

    A file holds all words of some chunks: nothing is shuffled, and a frequent word is
    spread over all files.  Row-group statistics let a search for few words skip others.
    ``tag`` tells the blocks of this directory from those of others.
    """
    posting_blocks(chunks, fields, tag).sortWithinPartitions("token", "block").write.mode("overwrite").parquet(path)


def append_index(
    spark: SparkSession,
    path: str,
    chunks: DataFrame,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    dedupe: bool = True,
    bucketed: bool = False,
    centroids: np.ndarray | None = None,
    with_postings: bool = False,
    documents: DataFrame | None = None,
) -> None:
    """Add ``chunks`` to the index at ``path``, which is created (with the last options) if absent.

    Documents come whole.  One that is stored with the same chunks is left out before it
    is embedded; one whose chunks have changed replaces what is stored; chunks without a
    document go by their id.  ``documents(doc_id)`` names the documents that were read: one of
    them that brings no chunk (it is empty now) loses what is stored.  A chunk that
    stands twice in ``chunks`` is taken once.  ``dedupe=False`` inserts everything.  Buckets and
    postings are kept in step.  If another job writes meanwhile, the work is done again
    on what it has left.
    """
    fresh_layout = NEW | {"bucketed": bucketed, "postings": with_postings}
    fresh_layout["centroids"] = None if centroids is None else np.asarray(centroids).tolist()
    for _ in range(ATTEMPTS):
        manifest, top = newest(spark, path)
        manifest = fresh_layout if manifest is None else manifest
        added, removed = new_segment(spark, path, manifest, chunks, embed, dedupe, documents)
        try:
            changed = {"segments": manifest["segments"] + [added], "removed": manifest["removed"] + removed, "retired": []}
            return publish(spark, path, manifest | changed, top)
        except ConcurrentWrite as error:
            log.warning("%s; trying again", error)
            delete_parts(spark, path, [*parts_of(NEW | {"segments": [added], "removed": removed})])
    raise ConcurrentWrite(f"The index at {path} was written by other jobs {ATTEMPTS} times meanwhile")


def new_segment(spark, path, manifest, chunks, embed, dedupe, documents) -> tuple[dict, list[dict]]:
    """Write what ``chunks`` adds to the index of ``manifest``: its segment and the removals."""
    removed, fresh = [], chunks
    if dedupe:
        fresh, marks = taken_once(chunks)
        if manifest["segments"]:
            fresh, changed = split_known(fresh, marks, read_all(spark, path, manifest), documents)
            removed = removal(spark, path, changed, len(manifest["segments"]))
    if embed is not None:
        fresh = embed(fresh)
    if manifest["centroids"] is not None:
        fresh = ivf_assign(fresh, np.array(manifest["centroids"]))
    return write_segment(fresh, path, manifest), removed


def removal(spark: SparkSession, path: str, docs: DataFrame, before: int) -> list[dict]:
    """Note that ``docs(doc_id)`` are no longer in the first ``before`` segments; empty if there are none."""
    tag = f"removed={new_tag()}"
    seen = Observation()
    docs.select(F.col("doc_id").cast("string").alias("doc_id")).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{tag}")
    if seen.get["n"]:
        return [{"docs": tag, "before": before}]
    delete_parts(spark, path, [tag])
    return []


def remove_documents(spark: SparkSession, path: str, documents: DataFrame) -> None:
    """Remove all chunks of ``documents(doc_id)`` from the index at ``path``."""
    for _ in range(ATTEMPTS):
        manifest, top = newest(spark, path)
        if manifest is None:
            raise UnreadableIndex(f"No index at {path}")
        gone = removal(spark, path, documents.select("doc_id").distinct(), len(manifest["segments"]))
        if not gone:
            return
        try:
            return publish(spark, path, manifest | {"removed": manifest["removed"] + gone, "retired": []}, top)
        except ConcurrentWrite:
            delete_parts(spark, path, [r["docs"] for r in gone])
    raise ConcurrentWrite(f"The index at {path} was written by other jobs {ATTEMPTS} times meanwhile")


def compact_index(spark: SparkSession, path: str) -> None:
    """Merge all segments of the index at ``path`` into one, without what was removed.

    What other jobs append or remove meanwhile is kept: it follows the merged segment.
    The merged parts are deleted by the next write, or by
    :func:`passagework.sources.manifests.vacuum`.
    """
    manifest, top = newest(spark, path)
    if manifest is None:
        raise UnreadableIndex(f"No index at {path}")
    merged = len(manifest["segments"])
    if merged <= 1 and not manifest["removed"]:
        return
    segment = write_segment(read_all(spark, path, manifest).drop("digest", "field_digest"), path, manifest)
    current = manifest
    for _ in range(ATTEMPTS):
        if current["segments"][:merged] != manifest["segments"] or current["removed"][: len(manifest["removed"])] != manifest["removed"]:
            delete_parts(spark, path, parts_of(NEW | {"segments": [segment]}))
            raise ConcurrentWrite(f"The index at {path} was rewritten meanwhile")
        later = [r | {"before": r["before"] - merged + 1} for r in current["removed"][len(manifest["removed"]) :]]
        changed = {"segments": [segment] + current["segments"][merged:], "removed": later}
        try:
            return publish(spark, path, current | changed | {"retired": sorted(parts_of(manifest) - parts_of(changed))}, top)
        except ConcurrentWrite:
            current, top = newest(spark, path)
    raise ConcurrentWrite(f"The index at {path} was written by other jobs {ATTEMPTS} times meanwhile")


def few_or_all(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` of a written table, for broadcast if they are counted to be few, and their number (or one more than few)."""
    n = rows.limit(BROADCAST_ROWS + 1).count()
    return (F.broadcast(rows) if n <= BROADCAST_ROWS else rows), n


def taken_once(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``chunks`` with each ``chunk_id`` once, and their marks ``(chunk_id, doc_id, digest)`` in the shared folder.

    Only marks are shuffled: texts stay where they are made, but for those whose id stands twice.
    """
    digest = F.xxhash64("content").alias("digest")
    marks = written(chunks.select("chunk_id", "doc_id", digest), "marks")
    own = F.struct("digest", "doc_id")
    counted = marks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("taken")).where("n > 1")
    twice, n = few_or_all(written(counted.select(F.col("chunk_id").alias("twice"), "taken"), "twice"))
    if not n:
        return chunks, marks

    def once(rows: DataFrame) -> DataFrame:
        same = F.col("chunk_id").eqNullSafe(F.col("twice"))
        copies = rows.join(twice, same).where(own.eqNullSafe(F.col("taken"))).select(rows.columns)
        return rows.join(twice, same, "left_anti").unionByName(copies.dropDuplicates(["chunk_id"]))

    return once(chunks.withColumn("digest", digest)).select(chunks.columns), written(once(marks), "marks")


def split_known(chunks: DataFrame, marks: DataFrame, stored: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The chunks to add, and the ids of the documents that they replace or that are empty now.

    ``marks`` are those of :func:`taken_once`: what is new is found from them.  The texts are shuffled
    only if both the documents to add and those to leave out are many.
    """
    known = stored.select("doc_id", "chunk_id", "digest")
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # A few new documents find their like in one scan; what is stored is not shuffled.
        docs = F.broadcast(marks.select("doc_id").distinct())
        loose = F.broadcast(marks.where(F.col("doc_id").isNull()).select("chunk_id"))
        whole = known.join(docs, "doc_id", "left_semi")
        known = whole.unionByName(known.where(F.col("doc_id").isNull()).join(loose, "chunk_id", "left_semi").select(whole.columns))

    def signature(rows: DataFrame, name: str) -> DataFrame:
        mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("chunk_id", "digest")))
        return rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(mark.alias(name))

    # a chunk inserted twice with dedupe=False counts once
    both = signature(marks, "new").join(signature(known.distinct(), "old"), "doc_id", "left")
    old = F.when(F.col("old").isNull(), "new").when(F.col("new") == F.col("old"), "same").otherwise("changed")
    judged = written(both.select("doc_id", old.alias("state")), "judged")
    same, n_same = few_or_all(judged.where("state = 'same'").select("doc_id"))
    other, n_other = few_or_all(judged.where("state <> 'same'").select("doc_id"))
    if not n_same:
        added = chunks.where(F.col("doc_id").isNotNull())
    elif not n_other:
        added = chunks.limit(0)
    elif n_other <= BROADCAST_ROWS < n_same:
        added = chunks.join(other, "doc_id", "left_semi").select(chunks.columns)
    else:
        added = chunks.where(F.col("doc_id").isNotNull()).join(same, "doc_id", "left_anti").select(chunks.columns)
    if marks.where(F.col("doc_id").isNull()).limit(1).count():
        loose = chunks.where(F.col("doc_id").isNull()).join(known.select("chunk_id"), "chunk_id", "left_anti")
        added = added.unionByName(loose.select(chunks.columns))
    changed = judged.where("state = 'changed'").select("doc_id")
    if documents is not None:
        read = documents.select(F.col("doc_id").cast("string").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        empty = read.join(marks.select("doc_id"), "doc_id", "left_anti")
        held = stored.select("doc_id").join(empty, "doc_id", "left_semi").distinct()
        changed = changed.unionAll(held)
    return added, changed


# ---- reading ------------------------------------------------------------------------


def read_parts(spark: SparkSession, path: str, names: list[str], schema: T.StructType) -> DataFrame:
    """Directories ``<kind>=<tag>`` in one scan, with their tags in the column ``<kind>``."""
    kind = names[0].partition("=")[0]
    tagged = T.StructType(schema.fields + [T.StructField(kind, T.StringType())])
    return spark.read.option("basePath", path).schema(tagged).parquet(*[f"{path}/{name}" for name in names])


def parts_named(manifest: dict, kind: str) -> list[str]:
    return [s[kind] for s in manifest["segments"]]


def number_of(manifest: dict, kind: str) -> Column:
    """The number of the segment that a row belongs to."""
    tags = [name.partition("=")[2] for name in parts_named(manifest, kind)]
    return F.element_at(F.create_map(*[x for i, tag in enumerate(tags) for x in (F.lit(tag), F.lit(i))]), F.col(kind))


def removals(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """``(gone_id, before)``: the documents that are no longer in the segments before a number."""
    noted = read_parts(spark, path, [r["docs"] for r in manifest["removed"]], T.StructType.fromDDL("doc_id string"))
    pairs = F.create_map(*[x for r in manifest["removed"] for x in (F.lit(r["docs"].partition("=")[2]), F.lit(r["before"]))])
    dated = noted.select(F.col("doc_id").alias("gone_id"), F.element_at(pairs, F.col("removed")).alias("before"))
    return dated.groupBy("gone_id").agg(F.max("before").alias("before"))


def read_all(spark: SparkSession, path: str, manifest: dict, files: list[str] | None = None) -> DataFrame:
    """All segments (or only these files of them) without what was removed: one scan and at most one join."""
    schema = T.StructType(STORED.fields + [BUCKET]) if manifest["bucketed"] else STORED
    parts = parts_named(manifest, "chunks") if files is None else files
    if not parts:
        return spark.createDataFrame([], schema)
    if files is None:
        rows = read_parts(spark, path, parts, schema)
    else:
        tagged = T.StructType(schema.fields + [T.StructField("chunks", T.StringType())])
        rows = spark.read.option("basePath", path).schema(tagged).parquet(*files)
    if not manifest["removed"]:
        return rows.select(schema.names)
    numbered = rows.withColumn("segment", number_of(manifest, "chunks"))
    gone = removals(spark, path, manifest)
    same = (numbered.doc_id == gone.gone_id) & (numbered.segment < gone.before)
    return numbered.join(gone, same, "left_anti").select(schema.names)


def files_between(spark: SparkSession, path: str, manifest: dict, since: str | None, until: str | None) -> list[str] | None:
    """The files that may have rows of these dates; None if the index is not clustered by date."""
    if not manifest.get("by_date") or not (since or until) or not manifest["segments"]:
        return None
    ranges = read_parts(spark, path, parts_named(manifest, "files"), T.StructType.fromDDL("file string, since timestamp, until timestamp"))
    if since:
        ranges = ranges.where(F.col("until") >= F.to_timestamp(F.lit(since)))
    if until:
        ranges = ranges.where(F.col("since") <= F.to_timestamp(F.lit(until)))
    return [row["file"] for row in ranges.where("since IS NOT NULL").select("file").collect()]


def open_index(
    spark: SparkSession,
    path: str,
    required=("chunk_id", "content", "embedding"),
    since: str | None = None,
    until: str | None = None,
) -> DataFrame | None:
    """The saved index; None if nothing is at ``path``, an error if it cannot be used.

    ``since`` and ``until`` keep the rows with ``modified_at`` between them, both inclusive;
    of an index written ``by_date`` only the files that have such rows are read.
    """
    try:
        manifest = read_manifest(spark, path)
        if manifest is None:
            log.info("No existing index found at %s", path)
            return None
        stored = read_all(spark, path, manifest, files_between(spark, path, manifest, since, until))
        fields = INDEX.fields + [BUCKET] * (BUCKET.name in stored.columns)
        return filter_date_range(ensure_schema(stored, T.StructType(fields), required), since, until)
    except (PySparkException, Py4JError, ValueError, KeyError, IndexError) as error:
        raise UnreadableIndex(f"Failed to load the index at {path}: {error}") from error


def load_index(spark: SparkSession, path: str, required=("chunk_id", "content", "embedding")) -> DataFrame | None:
    """The saved index, or None if there is none or it cannot be used."""
    try:
        return open_index(spark, path, required)
    except UnreadableIndex as error:
        log.error("%s", error)
        return None


def load_centroids(spark: SparkSession, path: str) -> np.ndarray | None:
    """The centroids that were saved with an index."""
    manifest = read_manifest(spark, path)
    return np.array(manifest["centroids"]) if manifest and manifest["centroids"] is not None else None


def load_field_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(chunk_id, field_digest)`` of a saved index, for keyword search by whole texts: no text is read."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise UnreadableIndex(f"No index at {path}")
    return read_all(spark, path, manifest).select("chunk_id", "field_digest")


def load_radii(spark: SparkSession, path: str) -> DataFrame:
    """``(bucket, n, radius, blank)`` of the saved buckets, for :func:`passagework.operators.vector.knn_pruned`.

    Removed rows only make them too large: ``n`` counts all segments, and is at least what is left.
    """
    manifest = read_manifest(spark, path)
    names = parts_named(manifest, "buckets") if manifest else []
    if not names or not all(names):
        raise UnreadableIndex(f"The index at {path} was saved without buckets")
    rows = read_parts(spark, path, names, T.StructType.fromDDL("bucket int, n long, radius double, blank boolean"))
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.bool_or("blank").alias("blank"))


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    """The shards of the saved neighbour graphs, for :func:`passagework.operators.graph.ann_graph`.

    Where documents were replaced, ``gone`` lists the places of their chunks: they are walked
    over, but are no hits.
    """
    manifest = read_manifest(spark, path)
    names = parts_named(manifest, "graph") if manifest else []
    if not names or not all(names):
        raise UnreadableIndex(f"The index at {path} was saved without a graph")
    shards = read_parts(spark, path, names, GRAPH)
    if not manifest["removed"]:
        return shards.select(GRAPH.names)
    heads = shards.select(F.col("graph").alias("of"), F.col("shard").alias("of_shard"), number_of(manifest, "graph").alias("segment"),
                          F.posexplode("doc_ids").alias("place", "doc_id"))
    gone = removals(spark, path, manifest)
    dead = heads.join(gone, (heads.doc_id == gone.gone_id) & (heads.segment < gone.before))
    listed = dead.groupBy("of", "of_shard").agg(F.collect_list("place").alias("gone"))  # at most a shard's chunks each
    same = (shards.graph == listed.of) & (shards.shard == listed.of_shard)
    return shards.join(listed, same, "left").select(*GRAPH.names, "gone")


def load_postings(spark: SparkSession, path: str) -> DataFrame:
    """Posting blocks saved with an index, or by :func:`write_postings`.

    Where documents were replaced, ``gone`` lists the places of their chunks in each block.
    """
    if not manifests(spark, path):
        return spark.read.schema(BLOCKS).parquet(path)
    manifest = read_manifest(spark, path)
    if not manifest["postings"]:
        raise UnreadableIndex(f"The index at {path} was saved without postings")
    blocks = read_parts(spark, path, parts_named(manifest, "postings"), BLOCKS)
    if not manifest["removed"]:
        return blocks.select(BLOCKS.names)
    number = number_of(manifest, "postings").alias("segment")
    heads = blocks.filter(F.col("token") == "").select(F.col("block").alias("of"), number, F.posexplode("doc_ids").alias("place", "doc_id"))
    gone = removals(spark, path, manifest)
    dead = heads.join(gone, (heads.doc_id == gone.gone_id) & (heads.segment < gone.before))
    listed = dead.groupBy("of").agg(F.collect_list("place").alias("gone"))  # at most a block's chunks each
    return blocks.join(listed, blocks.block == listed.of, "left").select(*BLOCKS.names, "gone")


def collection_counts(spark: SparkSession, path: str) -> Collection:
    """Number of chunks of a saved index and their average length in words, from its postings."""
    return block_counts(load_postings(spark, path))
