"""Figures about a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source: documents loaded, chunks made, average and greatest chunk length.

    Both counts are combined before the shuffle, so a source that holds a large
    part of the collection costs no more than another.
    """
    loaded = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))
    made = chunks.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.round(F.avg(F.length("content")), 6).alias("avg_length"),
        F.max(F.length("content")).alias("max_length"),
    )
    return loaded.join(made, "source", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
