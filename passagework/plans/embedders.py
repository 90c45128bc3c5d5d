"""Choosing how text becomes vectors, for building an index and for searching it alike."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

from passagework.config import DEFAULT_DIM
from passagework.operators.embed import embed_by_type, embed_cached

log = logging.getLogger(__name__)


def embedder(
    kind: str | None = None,
    models: dict[str, Callable] | None = None,
    dim: int = DEFAULT_DIM,
    cache: str | None = None,
) -> Callable[..., DataFrame]:
    """``embed(df, text_col="content", out="embedding")`` for the ``embed`` of a build, an append and a search.

    ``models`` maps a kind to a function that loads the model in a task and returns a function from
    texts to an array of ``dim`` columns.  Without a kind, or with one that ``models`` does not have
    (which warns), the hashing embedder is used.  With ``cache``, a directory for this model, a
    text is embedded once, however often it is built, appended or asked for.
    """
    models = dict(models or {})

    def embed(df: DataFrame, text_col: str = "content", out: str = "embedding") -> DataFrame:
        return embed_by_type(df, text_col, kind, models, dim, log.warning, out)

    if cache is None:
        return embed
    return lambda df, text_col="content", out="embedding": embed_cached(df, text_col, embed, cache, out)
