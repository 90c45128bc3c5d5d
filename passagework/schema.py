"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

INDEX = T.StructType(CHUNKS.fields + [T.StructField("embedding", T.ArrayType(T.DoubleType()))])

# Postings of one word in one block of chunks; the row of the empty word names the block's
# chunks and documents, has the lengths of the chunks as ``tfs`` and their sum as ``max_tf``.
BLOCKS = T.StructType(
    [
        T.StructField("block", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("max_tf", T.IntegerType()),
        T.StructField("min_dl", T.IntegerType()),
        T.StructField("rows", T.ArrayType(T.IntegerType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())),
        T.StructField("chunk_ids", T.ArrayType(T.StringType())),
        T.StructField("doc_ids", T.ArrayType(T.StringType())),
    ]
)


def ensure_schema(df: DataFrame, schema: T.StructType = INDEX, required=("chunk_id", "content")) -> DataFrame:
    """Return ``df`` with exactly the columns and types of ``schema``.

    Missing optional columns become NULL and columns of another type are cast.  A
    missing required column is an error, and so is a value that cannot be cast
    (raised when the row is read).
    """
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"Collection lacks the columns: {', '.join(missing)}")
    have = {field.name: field.dataType for field in df.schema.fields}

    def column(field: T.StructField):
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if have[field.name] == field.dataType:
            return F.col(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return df.select([column(field) for field in schema.fields])
