"""Adding new files to a saved index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.config import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE, DEFAULT_DIM, DOCUMENT_EXTENSIONS
from passagework.operators.chunk import chunk_recursive
from passagework.operators.embed import embed_hash
from passagework.sources.files import as_documents
from passagework.sources.store import append_index

# Schema of Spark's binaryFile source.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_documents(
    spark: SparkSession,
    path: str,
    index_path: str,
    checkpoint: str,
    extensions=DOCUMENT_EXTENSIONS,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    dim: int = DEFAULT_DIM,
) -> None:
    """Append the files below ``path`` that were not seen before, then stop.

    Which files were seen is kept in ``checkpoint``.  A batch that is run again after a
    failure adds nothing twice, because :func:`append_index` goes by chunk id.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(path)
    )

    def add(batch: DataFrame, _: int) -> None:
        documents = as_documents(batch)
        chunks = chunk_recursive(documents, size, overlap)
        append_index(spark, index_path, chunks, lambda df: embed_hash(df, "content", dim), documents=documents.select("doc_id"))

    query = (
        files.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
