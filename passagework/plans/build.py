"""Building an index."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.config import (
    BROADCAST_ROWS,
    DEFAULT_CHUNK_OVERLAP,
    DEFAULT_CHUNK_SIZE,
    DEFAULT_DIM,
    DOCUMENT_EXTENSIONS,
    INDEX_DIRECTORY,
    SEARCHERS,
)
from passagework.operators.chunk import chunk_recursive
from passagework.operators.embed import embed_hash
from passagework.operators.vector import ivf_train
from passagework.schema import INDEX, ensure_schema
from passagework.sources.files import scan_documents
from passagework.sources.scratch import written
from passagework.sources.store import append_index, open_index, write_index

log = logging.getLogger(__name__)


def build_index(
    documents: DataFrame,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    split: Callable[..., DataFrame] = chunk_recursive,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    dim: int = DEFAULT_DIM,
) -> DataFrame:
    """Documents -> chunks -> vectors, all narrow: no shuffle between scan and write."""
    chunks = split(documents, size, overlap)
    embedded = embed(chunks) if embed is not None else embed_hash(chunks, "content", dim)
    return ensure_schema(embedded, INDEX)


def load_or_build(
    spark: SparkSession,
    knowledge_base: str,
    index_path: str | None = None,
    extensions=DOCUMENT_EXTENSIONS,
    searcher: str = "exact",
    nlist: int | None = None,
    with_postings: bool = False,
    **build,
) -> DataFrame | None:
    """The saved index of ``knowledge_base``, built and saved first if there is none.

    None if there are no documents.  An index that is there but cannot be read is an
    error and stays as it is.  ``searcher="ivf"`` or ``"pruned"`` saves the vectors in ``nlist``
    buckets, ``"graph"`` a neighbour graph beside them.
    """
    if searcher not in SEARCHERS:
        raise ValueError(f"Unsupported searcher: {searcher}")
    in_buckets = searcher in ("ivf", "pruned")
    if in_buckets and not nlist:
        raise ValueError(f"searcher='{searcher}' needs nlist, the number of buckets")
    index_path = index_path or f"{knowledge_base.rstrip('/')}/{INDEX_DIRECTORY}"
    index = open_index(spark, index_path)
    if index is not None:
        return index
    documents = scan_documents(spark, knowledge_base, extensions)
    if documents.isEmpty():
        log.warning("No documents found in %s", knowledge_base)
        return None
    built = build_index(documents, **build)
    centroids = ivf_train(built, nlist) if in_buckets else None
    write_index(built, index_path, in_buckets, centroids, with_postings, with_graph=searcher == "graph")
    return open_index(spark, index_path)


def refresh_index(
    spark: SparkSession,
    knowledge_base: str,
    index_path: str | None = None,
    extensions=DOCUMENT_EXTENSIONS,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    split: Callable[..., DataFrame] = chunk_recursive,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    dim: int = DEFAULT_DIM,
    **saved,
) -> DataFrame | None:
    """Bring the saved index of ``knowledge_base`` up to date with its files, and return it.

    Files are compared by path and time of change, without reading them; those that are new
    or changed are split and embedded again, those that are gone or empty now lose their chunks.
    Files that are as they were are not read.  Without a saved index it is built
    (:func:`load_or_build`, which takes the options ``saved``).
    """
    index_path = index_path or f"{knowledge_base.rstrip('/')}/{INDEX_DIRECTORY}"
    index = open_index(spark, index_path)
    if index is None:
        return load_or_build(spark, knowledge_base, index_path, extensions, size=size, overlap=overlap, split=split, embed=embed, dim=dim, **saved)
    files = scan_documents(spark, knowledge_base, extensions)
    stored = index.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("modified_at").alias("stored_at"))
    both = files.select("doc_id", "modified_at").join(stored, "doc_id", "full")
    differs = ~F.col("modified_at").eqNullSafe(F.col("stored_at"))
    changed = written(both.where(differs).select("doc_id", F.col("modified_at").isNotNull().alias("is_there")), "changed")
    n = changed.count()
    if n:
        some = files.join(F.broadcast(changed) if n <= BROADCAST_ROWS else changed, "doc_id", "left_semi").select(files.columns)
        chunks = split(some, size, overlap)
        append_index(spark, index_path, chunks, embed or (lambda df: embed_hash(df, "content", dim)), documents=changed.select("doc_id"))
    return open_index(spark, index_path)
