"""Splitting documents into overlapping chunks (one row -> many rows)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.config import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE

# The usual separators of a recursive character splitter, coarse to fine.
SEPARATORS = ("\n\n", "\n", " ", "")


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap must not be negative")
    if overlap >= size:
        raise ValueError(f"chunk overlap ({overlap}) must be smaller than chunk size ({size})")


def number_chunks(documents: DataFrame, pieces: Column) -> DataFrame:
    """One row per element of ``pieces``, with ``chunk_no`` and ``chunk_id``; other columns inherited."""
    kept = [c for c in documents.columns if c != "content"]
    exploded = documents.select(*kept, F.posexplode(pieces).alias("chunk_no", "content"))
    return exploded.withColumn("chunk_id", F.concat(F.col("doc_id"), F.lit("#"), F.col("chunk_no").cast("string")))


def fixed_pieces(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last.

    The text is cut into steps in one linear pass and each window is put together
    from the steps it covers.  Taking ``substring(text, i * step)`` per window
    would walk the text from its start every time, which is quadratic in long texts.
    """
    step = size - overlap
    covered = -(-size // step)
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step))).cast("int")

    def windows(parts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.least(count, F.size(parts))),
            lambda i: F.substring(F.array_join(F.slice(parts, i, F.lit(covered)), ""), 1, size),
        )

    return F.when(F.length(text) > 0, F.element_at(F.transform(F.array(steps), windows), 1))


def chunk_fixed(
    documents: DataFrame, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP
) -> DataFrame:
    """Fixed windows of ``size`` characters; empty texts give no chunk."""
    check_sizes(size, overlap)
    return number_chunks(documents, fixed_pieces(F.col("content"), size, overlap))


def boundaries(text: str, codes: np.ndarray, first: int, last: int, separator: str) -> np.ndarray:
    """Where the pieces of ``text[first:last]`` begin, and its end; a separator is at the head of the piece that follows it."""
    if len(separator) == 1:
        found = np.flatnonzero(codes[first:last] == ord(separator)) + first
    else:
        found = np.array([m.start() for m in re.compile(re.escape(separator)).finditer(text, first, last)], np.int64)
    head = [] if len(found) and found[0] == first else [first]
    return np.concatenate((np.array(head, np.int64), found, (last,)))


def pack(text: str, edges: Sequence[int], size: int, overlap: int) -> list[str]:
    """Greedy merge of the pieces between ``edges`` into chunks of at most ``size`` characters.

    A chunk takes as many pieces as fit; the next one begins at the first edge from which no
    more than ``overlap`` characters are repeated and the next piece fits.
    """
    out, first, last = [], 0, len(edges) - 1
    while first < last:
        end = max(bisect_right(edges, edges[first] + size, first) - 1, first + 1)
        out.append(text[edges[first] : edges[end]].strip())
        if end == last:
            break
        shared = bisect_left(edges, edges[end] - overlap, first)
        fitting = bisect_left(edges, edges[end + 1] - size, first)
        first = min(max(shared, fitting), end)
    return [chunk for chunk in out if chunk]


def split_span(text: str, codes: np.ndarray, first: int, last: int, size: int, overlap: int, separators: tuple) -> list[str]:
    at = next((i for i, s in enumerate(separators) if text.find(s, first, last) >= 0), len(separators) - 1)
    finer = separators[at + 1 :]
    if separators[at] == "":  # every character is a piece; none of them is made
        return pack(text, range(first, last + 1), size, overlap)
    places = boundaries(text, codes, first, last, separators[at])
    edges = places.tolist()
    if not finer:
        return pack(text, edges, size, overlap)
    out, start = [], 0
    for i in np.flatnonzero(places[1:] - places[:-1] >= size).tolist():
        out += pack(text, edges[start : i + 1], size, overlap)
        out += split_span(text, codes, edges[i], edges[i + 1], size, overlap, finer)
        start = i + 1
    return out + pack(text, edges[start:], size, overlap)


def split_recursively(text: str, size: int, overlap: int, separators: tuple = SEPARATORS) -> list[str]:
    """Split at the coarsest separator that occurs; split what is still too long more finely.

    Pieces are never made: only their edges are found, and a chunk is one slice of the text.
    """
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return split_span(text, codes, 0, len(text), size, overlap, separators)


def chunk_recursive(
    documents: DataFrame,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    separators: tuple = SEPARATORS,
) -> DataFrame:
    """Chunks that prefer paragraph, line and word boundaries.

    Only ``content`` travels to Python; the other columns are joined to the pieces
    by ``posexplode`` in the JVM.  Narrow: no shuffle.
    """
    check_sizes(size, overlap)

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        chunks = [split_recursively(t, size, overlap, separators) if t else [] for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, chunks)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array([c for own in chunks for c in own], pa.string()))

    return number_chunks(documents, split(F.col("content")))
