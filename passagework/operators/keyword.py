"""Keyword search: BM25 over the words of the stored chunks.

``queries(query_id, query)`` against ``chunks(chunk_id, content, ...)`` gives
``(query_id, chunk_id, score, rank)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from passagework.config import BM25_B, BM25_K1, BROADCAST_ROWS, DEFAULT_LIMIT, HELD_ROWS, SCORE_DECIMALS
from passagework.functions import text
from passagework.operators.best import BestRows
from passagework.operators.topk import topk_per_query
from passagework.operators.vector import QUERY_TILE, hit_schema
from passagework.schema import BLOCKS
from passagework.sources.scratch import written


class Collection(NamedTuple):
    """Number of chunks and their average length in words."""

    n: int
    avgdl: float


class Counts(NamedTuple):
    """Number of chunks, their average length in words, and in how many each word occurs."""

    n: int
    avgdl: float
    df: dict[str, int]


PUSHED_TOKENS = 1000
SCAN_ROWS = 128  # chunks scored at once inside a task
DENSE_WORDS = 32  # queries take a product with all words of a block if those are fewer than so many times their own
BLOCK_CHUNKS = 2048  # chunks of a block of postings
HEADER = ""  # never a word: the row of a block that names its chunks


def field_tokens(fields: tuple[str, ...]) -> Column:
    """The words of all ``fields``; a NULL field has none."""
    none = F.array().cast("array<string>")
    return reduce(F.concat, [F.coalesce(text.tokens(F.col(f)), none) for f in fields])


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, token)``: the distinct words of every query."""
    return queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("token"))


def keyword_bm25(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = DEFAULT_LIMIT,
    k1: float = BM25_K1,
    b: float = BM25_B,
    fields: tuple[str, ...] = ("content",),
    tokenization: str = "word",
    stored_postings: DataFrame | None = None,
    decimals: int = SCORE_DECIMALS,
    broadcast_rows: int = BROADCAST_ROWS,
    collection: Collection | None = None,
) -> DataFrame:
    """The ``k`` best chunks of every query by BM25; a chunk without a query word is no hit.

    ``stored_postings`` are the saved :func:`posting_blocks` of the same chunks and fields:
    then no text is read, and only the postings of the query words.  Inside a task queries take
    turns of ``broadcast_rows`` words of queries at each block of chunks, so the chunks are read once for
    all turns; they are read again only for queries whose words or hits are more than a task should
    hold.  ``tokenization='field'`` takes the whole text as one word (:func:`whole_field_hits`).
    """
    if tokenization == "field":
        return whole_field_hits(queries, chunks, k)
    if tokenization != "word":
        raise ValueError(f"Unsupported tokenization: {tokenization}")
    terms = query_terms(queries)
    n_terms, n_queries = terms.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    if n_queries * k > HELD_ROWS:  # no query has more hits than there are chunks
        k = min(k, max(chunks.count(), 1))
    passes = max(1, -(-n_terms // max(broadcast_rows, BROADCAST_ROWS)), -(-n_queries * k // HELD_ROWS))
    own = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    found = []
    for number in range(passes):
        some = terms.filter(own == number) if passes > 1 else terms
        if stored_postings is None:
            rows, counts = scan_chunks(some, chunks, fields)
            found.append(score_words(some, rows, counts, max(k, 1), k1, b, decimals, broadcast_rows))
        else:
            found.append(score_blocks(some, stored_postings, max(k, 1), k1, b, decimals, collection, broadcast_rows))
    return topk_per_query(reduce(DataFrame.unionAll, found), k)


def scan_chunks(terms: DataFrame, chunks: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, Counts]:
    """The words of every chunk, ``(chunk_id, dl, words)``, and counts of the query words.

    Counting is one pass with a map-side combined group per query word.
    """
    total = ""  # never a word; its group counts the chunks themselves
    words = chunks.select("chunk_id", field_tokens(fields).alias("words"))
    all_chunks = terms.sparkSession.range(1).select(F.lit(total).alias("token"))
    wanted = terms.select("token").distinct().unionAll(all_chunks)
    counted = (
        words.select(
            F.size("words").alias("dl"), F.explode(F.array_append(F.array_distinct("words"), total)).alias("token")
        )
        .join(F.broadcast(wanted), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("avgdl"))
    )
    seen = {row["token"]: row for row in counted.collect()}
    n, avgdl = (seen[total]["df"], seen[total]["avgdl"]) if total in seen else (0, 0.0)
    counts = Counts(n, avgdl, {token: row["df"] for token, row in seen.items()})
    return words.select("chunk_id", F.size("words").alias("dl"), "words"), counts


def coded_chunks(index: DataFrame, vocabulary: pa.Array, fields: tuple[str, ...], columns: list[Column]) -> tuple[DataFrame, Counts]:
    """``columns`` and, of every chunk, ``dl`` and its ``words`` that are in ``vocabulary`` as their numbers; and counts of these words.

    The texts are split into words once; the table is written, so several scans can read it.
    """
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<dl:int,words:array<int>>")
    def known(words: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        code = pc.index_in(words.flatten(), shared.value)
        found = pc.is_valid(code)
        row = np.repeat(np.arange(len(words)), sizes)[found.to_numpy(zero_copy_only=False)]
        ends = np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), code.filter(found))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), lists], ["dl", "words"])

    rows = written(index.select(*columns, known(field_tokens(fields)).alias("coded")), "coded")
    total = -1  # its group counts the chunks themselves
    each = rows.select(F.col("coded.dl").alias("dl"), F.explode(F.array_append(F.array_distinct("coded.words"), F.lit(total))).alias("code"))
    seen = {r["code"]: r for r in each.groupBy("code").agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("avgdl")).collect()}
    n, avgdl = (seen[total]["df"], seen[total]["avgdl"]) if total in seen else (0, 0.0)
    counts = Counts(n, avgdl, {word: seen[i]["df"] for i, word in enumerate(vocabulary.to_pylist()) if i in seen})
    return rows.select(*rows.columns[:-1], "coded.dl", "coded.words"), counts


def posting_blocks(chunks: DataFrame, fields: tuple[str, ...] = ("content",), tag: str = "") -> DataFrame:
    """Postings in blocks of ``BLOCK_CHUNKS`` chunks (:data:`passagework.schema.BLOCKS`).

    A row holds the postings of one word in one block: which of its chunks have the word and
    how often, with the greatest frequency and the least length, which bound what the
    word can add to a score in that block.  The row of the empty word names the chunks.
    Narrow: a task makes blocks of the chunks that it reads, so a frequent word is spread
    over all blocks.
    """
    doc = F.col("doc_id").cast("string") if "doc_id" in chunks.columns else F.lit(None).cast("string")
    words = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), doc.alias("doc_id"), field_tokens(fields).alias("words"))
    wanted = to_arrow_schema(BLOCKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, here = 0, TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, len(batch), BLOCK_CHUNKS):
                part = batch.slice(start, BLOCK_CHUNKS)
                yield from packed(part, f"{tag}/{here}/{number}").to_batches()
                number += 1

    def packed(part: pa.RecordBatch, name: str) -> pa.Table:
        lists = part.column("words")
        dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = lists.flatten().dictionary_encode()
        vocabulary = coded.dictionary
        order = pc.sort_indices(vocabulary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = np.repeat(np.arange(len(part)), dl)
        cell, tf = np.unique(rank[coded.indices.to_numpy()] * len(part) + row, return_counts=True)
        word, row = cell // max(len(part), 1), cell % max(len(part), 1)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, int)
        ends = np.r_[starts, len(word)].astype(np.int32)
        n = len(starts)
        none = pa.nulls(n, pa.list_(pa.string()))
        postings = pa.Table.from_arrays(
            [
                pa.array([name] * n, pa.string()), vocabulary.take(pa.array(order)).cast(pa.string()), pa.array(np.diff(ends), pa.int32()),
                pa.array(np.maximum.reduceat(tf, starts) if n else [], pa.int32()),
                pa.array(np.minimum.reduceat(dl[row], starts) if n else [], pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(row.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32))), none, none,
            ],
            schema=wanted,
        )
        header = pa.Table.from_pylist(
            [{"block": name, "token": HEADER, "n": len(part), "max_tf": int(dl.sum()), "tfs": dl, "chunk_ids": part.column("chunk_id").to_pylist(), "doc_ids": part.column("doc_id").to_pylist()}],
            schema=wanted,
        )
        return pa.concat_tables([header, postings])

    return words.mapInArrow(pack, BLOCKS)


def block_counts(blocks: DataFrame) -> Collection:
    """Number of chunks and their average length, from the blocks' headers."""
    heads = blocks.filter(F.col("token") == HEADER)
    if "gone" in blocks.columns:  # chunks of replaced documents do not count
        held = F.filter(F.col("tfs"), lambda _, i: ~F.array_contains("gone", i))
        heads = heads.withColumn("tfs", F.when(F.col("gone").isNull(), F.col("tfs")).otherwise(held))
    length = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    n, words = heads.agg(F.sum(F.size("tfs")), F.sum(length)).first()
    return Collection(n or 0, (words or 0) / n if n else 0.0)


def block_frequencies(pairs: pa.Table, blocks: DataFrame, collection: Collection | None = None) -> tuple[DataFrame, Counts]:
    """The rows of ``blocks`` that the query words of ``pairs`` need, and in how many chunks each of them occurs."""
    names = pairs["token"].unique().to_pylist()
    if len(names) <= PUSHED_TOKENS:  # few enough to reach the scan of sorted postings
        entries = blocks.filter(F.col("token").isin([*names, HEADER]))
    else:
        wanted = blocks.sparkSession.createDataFrame(pa.table({"token": pa.array([*names, HEADER], pa.string())}))
        entries = blocks.join(F.broadcast(wanted), "token", "left_semi").select(blocks.columns)
    gone = F.coalesce("gone", F.array().cast("array<int>")) if "gone" in blocks.columns else None
    live = F.col("n") if gone is None else F.when(F.col("token") == HEADER, F.col("n")).otherwise(F.size(F.array_except("rows", gone)))
    # of headers: the number of chunks, and of their words
    found = {r["token"]: r for r in entries.groupBy("token").agg(F.sum(live).alias("df"), F.sum("max_tf").alias("words")).collect()}
    head = found.pop(HEADER, None)
    if collection is None and gone is not None:
        collection = block_counts(blocks)
    elif collection is None:
        collection = Collection(head["df"], head["words"] / head["df"]) if head and head["df"] else Collection(0, 0.0)
    return entries, Counts(collection.n, collection.avgdl, {token: r["df"] for token, r in found.items()})


def query_tiles(query: np.ndarray, n_queries: int, rows: int) -> list[tuple[int, int]]:
    """``(first, end)`` of successive queries that are scored at once: at most ``QUERY_TILE``, with at most
    ``rows`` words together (or a single query with more).  ``query`` numbers the query of each word, in order."""
    ends, tiles, first = np.searchsorted(query, np.arange(n_queries + 1)), [], 0
    while first < n_queries:
        fits = int(np.searchsorted(ends, ends[first] + rows, side="right")) - 1
        end = min(max(fits, first + 1), first + QUERY_TILE, n_queries)
        tiles.append((first, end))
        first = end
    return tiles


def score_blocks(
    terms: DataFrame,
    blocks: DataFrame,
    k: int,
    k1: float,
    b: float,
    decimals: int,
    collection: Collection | None = None,
    tile_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The best hits of every task, from saved postings.

    First the document frequencies of the query words are added up from the blocks' counts.
    Then the postings of the query words are brought together by block, and a task adds up
    the scores of one block at a time.  A query is left out in a block whose words cannot
    add up to its k-th best score so far.  Nothing is shuffled by chunk.
    """
    pairs = terms.toArrow().combine_chunks()
    entries, counts = block_frequencies(pairs, blocks, collection)
    gone = "gone" in blocks.columns
    shared = terms.sparkSession.sparkContext.broadcast(word_weights(pairs, counts))
    avgdl = counts.avgdl or 1.0
    schema = hit_schema(terms, blocks.select(F.lit("").alias("chunk_id")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vocabulary, query, token, weight = shared.value
        if not len(vocabulary):
            return
        ends = np.searchsorted(query, np.arange(len(query_ids) + 1))
        tiles = query_tiles(query, len(query_ids), tile_rows)
        best = BestRows(len(query_ids), k, decimals, positive=True)
        for part in runs(batches, "block"):
            offer_block(best, part, vocabulary, tiles, ends, token, weight)
        yield from best.result(query_ids)

    def offer_block(best, part, vocabulary, tiles, ends, token, weight):
        names = part.column("token")
        is_head = pc.equal(names, HEADER).to_numpy(zero_copy_only=False)
        if not is_head.any() or is_head.all():
            return
        head = part.slice(int(is_head.argmax()), 1)
        dl = head.column("tfs").flatten().to_numpy().astype(np.float64)
        norm = k1 * (1 - b + b * dl / avgdl)
        held = part.filter(pa.array(~is_head))
        code = pc.index_in(held.column("token"), vocabulary).to_numpy()
        place = np.full(len(vocabulary), -1)
        place[code] = np.arange(len(code))
        size = pc.list_value_length(held.column("rows")).to_numpy()
        stop = np.cumsum(size)
        row, tf = (held.column(c).flatten().to_numpy() for c in ("rows", "tfs"))
        gain = tf * (k1 + 1) / (tf + norm[row])
        if gone and head.column("gone")[0].is_valid:
            dead = np.zeros(len(dl), bool)
            dead[head.column("gone").flatten().to_numpy()] = True
            gain = np.where(dead[row], 0.0, gain)
        most = held.column("max_tf").to_numpy().astype(np.float64)
        bound = most * (k1 + 1) / (most + k1 * (1 - b + b * held.column("min_dl").to_numpy() / avgdl))
        ids = head.column("chunk_ids").flatten()
        for first, end in tiles:
            tile = range(first, end)
            scores = np.zeros((len(tile), len(dl)))
            for q in tile:
                words = token[ends[q] : ends[q + 1]]
                at = place[words]
                words, at = words[at >= 0], at[at >= 0]
                if not len(at) or (weight[words] * bound[at]).sum() < best.floor[q] - 10.0**-decimals:
                    continue
                spans = [slice(stop[i] - size[i], stop[i]) for i in at]
                added = np.concatenate([gain[s] * weight[w] for s, w in zip(spans, words)])
                scores[q - first] = np.bincount(np.concatenate([row[s] for s in spans]), added, len(dl))
            if scores.any():
                best.offer(first, scores, ids)

    dealt = entries.repartition("block").sortWithinPartitions("block", "token")
    return dealt.mapInArrow(score, schema)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each ``key`` of sorted batches."""
    held, current = [], None
    for batch in batches:
        keys = batch.column(key).dictionary_encode()
        codes, names = keys.indices.to_numpy(), keys.dictionary
        bounds = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)] if len(codes) else []
        for start, stop in zip(bounds[:-1], bounds[1:]):
            name = names[codes[start]].as_py()
            if held and name != current:
                yield pa.concat_batches(held)
                held = []
            current = name
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.concat_batches(held)


def word_weights(terms: DataFrame | pa.Table, counts: Counts) -> tuple:
    """Query ids, words, and which word weighs how much in which query, ordered by query."""
    pairs = terms if isinstance(terms, pa.Table) else terms.toArrow().combine_chunks()
    query_ids, vocabulary = pairs["query_id"].unique(), pairs["token"].unique()
    query = pc.index_in(pairs["query_id"], query_ids).to_numpy()
    token = pc.index_in(pairs["token"], vocabulary).to_numpy()
    by_query = np.argsort(query, kind="stable")  # a tile of queries is then a slice
    df = np.array([counts.df.get(t, 0) for t in vocabulary.to_pylist()], dtype=np.float64)
    weight = np.log(1 + (counts.n - df + 0.5) / (df + 0.5))
    return query_ids, vocabulary, query[by_query], token[by_query], weight


class WordScorer:
    """BM25 scores of a block of chunks for tiles of queries, as a matrix product."""

    def __init__(self, vocabulary, query, token, weight, n_queries, avgdl, k1, b):
        self.vocabulary, self.weight = vocabulary, weight
        pairs = np.unique(query * max(len(vocabulary), 1) + token)  # a word counts once in a query
        self.query, self.token = np.divmod(pairs, max(len(vocabulary), 1))
        self.n_queries, self.avgdl, self.k1, self.b = n_queries, avgdl, k1, b
        self.column_of = np.full(len(vocabulary), -1)
        self.used = np.zeros(0, np.int64)

    def take(self, block: pa.RecordBatch) -> bool:
        """Count the query words of a block ``(dl, words[, tfs])``; whether it has any.  Words may be numbers in the vocabulary."""
        words = block.column("words")
        dl = block.column("dl").to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        code = words.flatten()
        if not pa.types.is_integer(code.type):  # else their numbers in the vocabulary
            code = pc.fill_null(pc.index_in(code, self.vocabulary), -1)
        code = code.to_numpy(zero_copy_only=False)
        known = code >= 0
        row = np.repeat(np.arange(len(block)), sizes)[known]
        self.column_of[self.used] = -1
        self.used, column = np.unique(code[known], return_inverse=True)
        self.column_of[self.used] = np.arange(len(self.used))
        if not len(self.used):
            return False
        times = None  # a word stands as often as it occurs, or once with its number
        if "tfs" in block.schema.names:
            times = block.column("tfs").flatten().to_numpy(zero_copy_only=False)[known]
        cells = np.bincount(column * len(block) + row, times, minlength=len(block) * len(self.used))
        at = np.flatnonzero(cells)
        tf = cells[at]
        gain = np.zeros(len(cells))
        gain[at] = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[at % len(block)] / self.avgdl))
        self.gain = gain.reshape(len(self.used), len(block))  # a row for each word
        return True

    def scores(self, first: int, end: int | None = None) -> np.ndarray:
        """``(queries, chunks)`` of the queries from ``first`` up to ``end``, or of the tile that begins there."""
        end = min(first + QUERY_TILE, self.n_queries) if end is None else end
        tile = slice(*np.searchsorted(self.query, (first, end)))
        q, c = self.query[tile] - first, self.column_of[self.token[tile]]
        found = c >= 0
        q, c, weight = q[found], c[found], self.weight[self.token[tile][found]]
        if len(q) * DENSE_WORDS > (end - first) * len(self.used):
            weights = np.zeros((end - first, len(self.used)))
            weights[q, c] = weight
            return weights @ self.gain
        # most words of the block are in no single query: only the rows of its own words are added up
        out = np.zeros((end - first, self.gain.shape[1]))
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        for start, stop in zip(starts.tolist(), np.append(starts[1:], len(q)).tolist()):
            out[q[start]] = weight[start:stop] @ self.gain[c[start:stop]]
        return out


def score_words(
    terms: DataFrame, rows: DataFrame, counts: Counts, k: int, k1: float, b: float, decimals: int, tile_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The best hits of every task, from the words of each chunk.

    The words of a block of chunks make a chunk-by-word matrix; its product with the
    word-by-query matrix of weights holds all scores, of which a task keeps ``k`` per
    query.  Joining instead would build a row per (query, word, chunk) and shuffle a row
    per (query, chunk).
    """
    shared = terms.sparkSession.sparkContext.broadcast(word_weights(terms, counts))
    avgdl = counts.avgdl

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vocabulary, query, token, weight = shared.value
        if not len(vocabulary):
            return
        best = BestRows(len(query_ids), k, decimals, positive=True)
        scorer = WordScorer(vocabulary, query, token, weight, len(query_ids), avgdl, k1, b)
        tiles = query_tiles(query, len(query_ids), tile_rows)
        for batch in batches:
            for start in range(0, len(batch), SCAN_ROWS):
                block = batch.slice(start, SCAN_ROWS)
                if scorer.take(block):
                    for first, end in tiles:
                        best.offer(first, scorer.scores(first, end), block.column("chunk_id"))
        yield from best.result(query_ids)

    return rows.mapInArrow(score, hit_schema(terms, rows))


def field_digest(text: Column) -> Column:
    """32 bytes that tell a whole trimmed text."""
    return F.unhex(F.sha2(F.trim(text), 256))


def whole_field_hits(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_LIMIT) -> DataFrame:
    """Chunks whose whole (trimmed) content is the query, each with score 1.

    Texts are compared by their digest, which ``chunks`` may have in a column ``field_digest``:
    then no text is read.  Of equal chunks only the ``k`` smallest ids are kept, before the
    join: many copies of a text do not multiply.
    """
    own = F.col("field_digest") if "field_digest" in chunks.columns else field_digest(F.col("content"))
    q = queries.filter(F.trim("query") != "").select("query_id", field_digest(F.col("query")).alias("digest"))
    copies = Window.partitionBy("digest").orderBy("chunk_id")
    asked = q.select("digest").distinct()
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    v = (
        chunks.select("chunk_id", own.alias("digest"))
        .join(asked, "digest", "left_semi")
        .withColumn("copy", F.row_number().over(copies))
        .filter(F.col("copy") <= k)
    )
    return topk_per_query(v.join(q, "digest").select("query_id", "chunk_id", F.lit(1.0).alias("score")), k)
