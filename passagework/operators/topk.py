"""Best rows per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.config import DEFAULT_LIMIT


def topk_per_query(
    hits: DataFrame, k: int = DEFAULT_LIMIT, limit_col: str | None = None, tie: str = "chunk_id"
) -> DataFrame:
    """Keep the ``k`` best rows of each query and number them in ``rank``, ties by id.

    The constant bound lets Spark drop all but ``k`` rows per query *before* the
    shuffle.  ``limit_col`` names a per-row limit (NULL means ``DEFAULT_LIMIT``,
    0 keeps nothing); ``k`` must then be at least the largest of them.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(tie))
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if limit_col is not None:
        best = best.filter(F.col("rank") <= F.coalesce(F.col(limit_col), F.lit(DEFAULT_LIMIT)))
    return best
