"""Turning text into vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.config import DEFAULT_DIM
from passagework.functions.text import tokens
from passagework.sources.files import path_exists

DIGEST = "digest_of_text"


def bucket_cells(words: pa.Array, dim: int) -> np.ndarray:
    """``row * dim + bucket`` of every token of a list column, as :func:`vectors.token_bucket` numbers buckets.

    A word that stands often in a batch is hashed once.
    """
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    bucket = np.array([int.from_bytes(md5(w).digest()[:4], "big") % dim for w in distinct], dtype=np.int64)
    of_token = bucket[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(words)) * dim, sizes) + of_token


def embed_hash(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM, out: str = "embedding") -> DataFrame:
    """Add the hashed term-frequency vector of ``text_col``, scaled to length one.

    Tokens are made in the JVM; NumPy hashes the distinct ones of an Arrow batch and counts
    the whole batch at once.  Narrow: no shuffle.  A text without
    tokens gets the zero vector, whose cosine with anything is 0.
    """

    @F.arrow_udf("array<double>")
    def count_and_scale(words: pa.Array) -> pa.Array:
        n = len(words)
        counts = np.bincount(bucket_cells(words, dim), minlength=n * dim).reshape(n, dim).astype(np.float64)
        lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = counts / np.where(lengths > 0, lengths, 1.0)
        offsets = np.arange(n + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))

    return df.withColumn(out, count_and_scale(tokens(F.col(text_col))))


def embed_hash_sparse(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """One row per (row, bucket) with its token count, columns ``bucket`` and ``cnt``."""
    kept = [c for c in df.columns if c != text_col]

    @F.arrow_udf("array<struct<bucket:int,cnt:int>>")
    def count(words: pa.Array) -> pa.Array:
        cell, times = np.unique(bucket_cells(words, dim), return_counts=True)
        runs = pa.StructArray.from_arrays([pa.array((cell % dim).astype(np.int32)), pa.array(times.astype(np.int32))], ["bucket", "cnt"])
        ends = np.searchsorted(cell, np.arange(len(words) + 1) * dim).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), runs)

    run = F.explode(count(tokens(F.col(text_col)))).alias("run")
    return df.select(*kept, run).select(*kept, "run.bucket", "run.cnt")


def embed_with(
    df: DataFrame,
    text_col: str,
    load_model: Callable[[], Callable[[list[str]], "np.ndarray"]],
    dim: int,
    out: str = "embedding",
) -> DataFrame:
    """Embed ``text_col`` with a model of the caller's.

    ``load_model`` runs once per Python worker task and returns a function from a
    list of texts to an array of shape ``(len(texts), dim)``.  Another shape, or a
    failure of the model, fails the job; vectors are never replaced by zeros.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            vecs = np.asarray(model(texts.fillna("").tolist()), dtype=np.float64)
            if vecs.shape != (len(texts), dim):
                raise ValueError(f"embedder returned shape {vecs.shape}, expected {(len(texts), dim)}")
            yield pd.Series(list(vecs))

    return df.withColumn(out, embed(F.col(text_col)))


def embed_by_type(
    df: DataFrame, text_col: str, kind: str | None, models: dict, dim: int = DEFAULT_DIM, warn=print, out: str = "embedding"
) -> DataFrame:
    """Embed with ``models[kind]``, a ``load_model`` of :func:`embed_with`; an unknown kind warns and uses the hashing embedder."""
    if kind in models:
        return embed_with(df, text_col, models[kind], dim, out)
    if kind not in (None, "hash"):
        warn(f"Unsupported embedding type: {kind}. Using the hashing embedder instead.")
    return embed_hash(df, text_col, dim, out)


def embed_cached(
    df: DataFrame, text_col: str, embed: Callable[[DataFrame, str, str], DataFrame], cache: str, out: str = "embedding"
) -> DataFrame:
    """As ``embed(df, text_col, out)``, but a text that was ever embedded with this ``cache`` never reaches the model again.

    ``cache`` is a directory for the vectors of one model, by the digest of the text.  Of the
    texts of ``df`` the distinct ones that are not in it are embedded and added; then all rows get
    their vectors by a join.  A NULL text counts as the empty one.  Two jobs that add the same
    text at the same time do harmless double work.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumn(DIGEST, F.unhex(F.sha2(text, 256)))
    texts = keyed.select(DIGEST, text.alias("text"))
    if path_exists(spark, cache):
        texts = texts.join(cached_vectors(spark, cache).select(DIGEST), DIGEST, "left_anti")
    fresh = embed(texts.dropDuplicates([DIGEST]), "text", "vector").select(DIGEST, F.col("vector").cast("array<double>").alias("vector"))
    fresh.write.mode("append").parquet(cache)
    held = cached_vectors(spark, cache).dropDuplicates([DIGEST]).withColumnRenamed("vector", out)
    return keyed.drop(out).join(held, DIGEST, "left").select(*[c for c in df.columns if c != out], out)


def cached_vectors(spark: SparkSession, cache: str) -> DataFrame:
    return spark.read.schema(f"{DIGEST} binary, vector array<double>").parquet(cache)
