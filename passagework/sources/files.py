"""Documents from files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.config import DOCUMENT_EXTENSIONS
from passagework.schema import DOCUMENTS


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = file_system(spark, path)
    return fs.exists(hadoop_path)


def as_documents(files: DataFrame) -> DataFrame:
    """Documents from rows of Spark's ``binaryFile`` source."""
    source = F.regexp_replace("path", "^file:(//)?", "")
    return files.select(
        source.alias("doc_id"),
        source.alias("source"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("modificationTime").alias("modified_at"),
        F.create_map(F.lit("source"), source).alias("metadata"),
    )


def scan_documents(spark: SparkSession, path: str, extensions=DOCUMENT_EXTENSIONS) -> DataFrame:
    """One document per file below ``path`` that has one of the extensions.

    Spark skips files and directories whose names begin with ``.`` or ``_``, which
    keeps a saved index out of the scan.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Knowledge base path does not exist: {path}")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(path)
    )
    return as_documents(files)


def documents_from_table(
    table: DataFrame,
    doc_id: str = "doc_id",
    content: str = "text",
    source: str | Column = "source",
    modified_at: str | Column | None = None,
    metadata: Column | None = None,
) -> DataFrame:
    """Documents from a table; ``source``, ``modified_at`` and ``metadata`` may be expressions."""
    source = F.col(source) if isinstance(source, str) else source
    modified_at = F.col(modified_at) if isinstance(modified_at, str) else modified_at
    types = {field.name: field.dataType for field in DOCUMENTS.fields}
    return table.select(
        F.col(doc_id).cast("string").alias("doc_id"),
        source.alias("source"),
        F.col(content).alias("content"),
        (F.lit(None) if modified_at is None else modified_at).cast(types["modified_at"]).alias("modified_at"),
        (F.create_map(F.lit("source"), source) if metadata is None else metadata).alias("metadata"),
    )
