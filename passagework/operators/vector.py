"""Nearest neighbours of a table of query vectors among a table of stored vectors.

Both sides are DataFrames: ``queries(query_id, query_vec)`` and
``index(chunk_id, embedding)``; the result is ``(query_id, chunk_id, score, rank)``,
larger scores being better.  Scores are rounded before they are ranked, so the
order does not depend on how the rows happened to be blocked, and ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagework.config import BROADCAST_BYTES, BROADCAST_ROWS, DEFAULT_LIMIT, HELD_ROWS, METRICS, SCORE_DECIMALS
from passagework.operators.best import BestRows, rows_from
from passagework.operators.choices import FILTERS, Choices
from passagework.operators.topk import topk_per_query
from passagework.sources.scratch import written

QUERY_TILE = 1024  # queries scored at once inside a task ...
VECTOR_TILE = 2048  # ... against as many stored vectors
CELL_ROWS = 200_000  # stored vectors that one task should score for one cell
CELL_BYTES = 16 * 1024 * 1024  # query vectors that one task may hold for one cell ...
CELL_HITS = 400_000  # ... and best rows of these queries
FILTERED_ROWS = 1_024  # stored vectors that are scored at once where queries have filters
CORE_CELLS = 2  # cells of a grid for each core, at least
PAIRS = 200_000  # single pairs that are scored at once
FEW_QUERIES = 8_192  # queries that are read at once, and answered without measuring them first
DENSE = 16  # where more than a sixteenth of a block may be among the best, all of it is scored exactly
PRODUCTS = 262_144  # products in single precision that are looked at at once
LONGEST = 1e15  # vectors up to this length can be multiplied in single precision


# ---- NumPy helpers that run inside tasks --------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix; rows of unequal length are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not len(column):
        return flat.reshape(0, 0)
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of different lengths: {lengths['min']} and {lengths['max']}")
    return flat.reshape(len(column), -1)


def with_vectors(rows):
    """The rows of an Arrow batch or table that have a vector."""
    valid = pc.is_valid(rows.column("vec"))
    return rows if pc.all(valid).as_py() in (True, None) else rows.filter(valid)


def prepare(vectors: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return vectors
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(length > 0, length, 1.0)


def similarity(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Cosine, inner product, or ``1 / (1 + distance)`` for l2; larger is nearer."""
    dots = queries @ vectors.T
    if metric != "l2":
        return dots
    square = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None, :] - 2.0 * dots
    return 1.0 / (1.0 + np.sqrt(np.maximum(square, 0.0)))


def pair_similarity(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """:func:`similarity` of single pairs, a row of each."""
    if metric != "l2":
        return np.einsum("pd,pd->p", queries, vectors)
    apart = queries - vectors
    return 1.0 / (1.0 + np.sqrt(np.einsum("pd,pd->p", apart, apart)))


class Sieve:
    """Tells which pairs of a query and a stored vector may reach a score, by products in single precision.

    A product is off by at most ``error`` times the lengths of both vectors.  What is left is few and
    scored exactly, so nothing depends on the precision but the time.  For l2 a further column
    holds half the squared length of a vector: the product says then how near it is.
    """

    def __init__(self, queries: np.ndarray, metric: str):
        self.queries, self.metric = queries, metric
        self.length = np.sqrt((queries * queries).sum(axis=1))
        self.error = (queries.shape[1] + 8) * 2.0**-23
        self.single = self.extended(queries, 1.0)
        self.products = np.empty(0, np.float32)

    def extended(self, vectors: np.ndarray, last: float | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):  # told by the length
            if self.metric != "l2":
                return vectors.astype(np.float32)
            out = np.empty((len(vectors), vectors.shape[1] + 1), np.float32)
            out[:, :-1], out[:, -1] = vectors, last
        return out

    def stored(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors as :meth:`offer` takes them."""
        square = (vectors * vectors).sum(axis=1)
        return vectors, self.extended(vectors, -square / 2.0), np.sqrt(square)

    def offer(self, best: BestRows, first: int | np.ndarray, points: tuple[np.ndarray, np.ndarray, np.ndarray], ids: pa.Array) -> None:
        """Offer ``best`` what may be among the best of the queries ``first, first + 1, ...`` (``QUERY_TILE`` at most), or of these numbers."""
        tile = first if isinstance(first, np.ndarray) else slice(first, first + QUERY_TILE)
        number = first if isinstance(first, np.ndarray) else np.arange(first, min(first + QUERY_TILE, len(self.queries)))
        vectors = points[0]
        found = self.pairs(tile, points, best.bars(number))
        if found is None:
            best.offer(first, similarity(self.queries[tile], vectors, self.metric), ids)
            return
        q, row = found
        scores = pair_similarity(self.queries[number[q]], vectors[row], self.metric)
        reach = scores >= best.bars(number)[q]
        best.hold(number, q[reach], row[reach], scores[reach], ids)

    def pairs(self, tile, points: tuple[np.ndarray, np.ndarray, np.ndarray], bar: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """``(query, row)`` of the pairs that may reach ``bar``; None if they are many or cannot be told."""
        _, single, length = points
        own = self.length[tile]
        longest = length.max(initial=0.0)
        if not (longest < LONGEST and own.max(initial=0.0) < LONGEST) or np.count_nonzero(np.isneginf(bar)) * DENSE > len(bar):
            return None
        off = self.error * own * longest
        if self.metric == "l2":
            with np.errstate(divide="ignore"):
                far = np.where(bar > 0, np.maximum(1.0 / np.maximum(bar, 0.0) - 1.0, 0.0), np.inf)
            bar, off = (own * own - far * far) / 2.0, off + self.error * (own * own + longest * longest)
        with np.errstate(over="ignore"):
            need = np.nextafter((bar - off).astype(np.float32), np.float32(-np.inf))
        rows = max(1, PRODUCTS // max(len(single), 8)) // 8 * 8 or 8
        if len(self.products) < rows * len(single):
            self.products, self.high = np.empty(rows * len(single), np.float32), np.zeros(rows * len(single), bool)
        found, most = [], len(own) * len(single) // DENSE
        for start in range(0, len(own), rows):  # products that stay in a core's cache
            queries = self.single[tile][start : start + rows]
            size = len(queries) * len(single)
            products, high = self.products[:size].reshape(len(queries), -1), self.high[: size + -size % 8]
            np.matmul(queries, single.T, out=products)
            np.greater_equal(products, need[start : start + rows, None], out=high[:size].reshape(len(queries), -1))
            high[size:] = False
            # eight at a time, as hardly any is high
            some = np.flatnonzero(high.view(np.uint64) != 0)
            word, bit = np.nonzero(high.reshape(-1, 8)[some])
            found.append(some[word] * 8 + bit + start * len(single))
            most -= len(found[-1])
            if most < 0:
                return None
        return np.divmod(np.concatenate(found), len(single))


def score_block(best: BestRows, sieve: Sieve, vectors: np.ndarray, ids: pa.Array) -> None:
    """Score a block of stored vectors; of the first one few at a time, to know early what is good."""
    if not len(ids):
        return
    fresh, start = not best.rows, 0
    while start < len(ids):
        step = min(max(4 * best.k, 256, start), VECTOR_TILE) if fresh else VECTOR_TILE
        part = slice(start, start + step)
        points = sieve.stored(vectors[part])
        for first in range(0, len(sieve.queries), QUERY_TILE):
            sieve.offer(best, first, points, ids[part])
        if fresh and step < VECTOR_TILE:
            best.settle()
        start += step


# ---- scoring plans ------------------------------------------------------------------


def hit_schema(queries: DataFrame, index: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", index.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def held_queries(queries: DataFrame, rows: int, size: int) -> pa.Table | None:
    """The queries with a vector, read once, if they are at most ``rows`` and their vectors ``size`` bytes."""
    head = queries.limit(rows + 1).toArrow().combine_chunks()
    if len(head) > rows:
        return None
    block = with_vectors(head)
    dim = pc.max(pc.list_value_length(block["vec"])).as_py() or 0
    return block if len(block) * dim * 8 <= size else None


def score_with_broadcast(
    queries: DataFrame, index: DataFrame, k: int, metric: str, decimals: int, block: pa.Table | None = None, least: float = -np.inf
) -> DataFrame:
    """One pass over the index; every task holds the (small) query block.

    The index is neither shuffled nor replicated, and a task emits at most ``k``
    rows per query.
    """
    block = with_vectors(queries.toArrow().combine_chunks()) if block is None else block
    shared = queries.sparkSession.sparkContext.broadcast(
        (block["query_id"].combine_chunks(), matrix(block["vec"].combine_chunks()) if len(block) else None)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vectors = shared.value
        if query_vectors is None:
            return
        query_vectors = prepare(query_vectors, metric)
        best, sieve = BestRows(len(query_ids), k, decimals, least=least), Sieve(query_vectors, metric)
        for batch in map(with_vectors, batches):
            if len(batch):
                score_block(best, sieve, prepare(matrix(batch.column("vec")), metric), batch.column("chunk_id"))
        yield from best.result(query_ids)

    return index.mapInArrow(score, hit_schema(queries, index))


def knn_filtered(
    queries: DataFrame,
    index: DataFrame,
    k: int = DEFAULT_LIMIT,
    metric: str = "cosine",
    decimals: int = SCORE_DECIMALS,
    least: float = -np.inf,
) -> DataFrame:
    """The ``k`` nearest of the rows that pass each query's own filters; scores below ``least`` may be left out.

    ``queries`` carry :data:`passagework.operators.choices.FILTERS`, ``index`` has ``source`` and
    ``modified_at``.  Queries are taken in turns that a task can hold; each turn is one pass over
    the index, however many different filters there are.
    """
    if metric not in METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    q = queries.select("query_id", F.col("query_vec").alias("vec"), *FILTERS)
    schema = hit_schema(q, index)
    every = False
    if k > HELD_ROWS // FEW_QUERIES:  # no query has more hits than there are vectors
        n_vectors = max(index.count(), 1)
        every, k = k >= n_vectors, min(k, n_vectors)
    if k <= 0:
        return topk_per_query(q.sparkSession.createDataFrame([], schema), k)
    # what leaves out no other row is not held, so its number does not matter
    turns = max(1, -(-q.count() // max(1, FEW_QUERIES if every else min(FEW_QUERIES, HELD_ROWS // k))))
    own = F.pmod(F.xxhash64("query_id"), F.lit(turns))
    found = None
    for turn in range(turns):
        hits = score_filtered(q.filter(own == turn) if turns > 1 else q, index, k, metric, decimals, schema, least, every)
        found = hits if found is None else found.unionAll(hits)
    return topk_per_query(found, k)


def score_filtered(queries: DataFrame, index: DataFrame, k: int, metric: str, decimals: int, schema: T.StructType, least: float, every: bool = False) -> DataFrame:
    block = with_vectors(queries.toArrow().combine_chunks())
    choices = Choices(block)
    vectors = prepare(matrix(block["vec"].combine_chunks()), metric) if len(block) else None
    shared = queries.sparkSession.sparkContext.broadcast((block["query_id"].combine_chunks(), vectors, choices))
    rows = index.select("chunk_id", F.col("embedding").alias("vec"), *choices.columns())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, choices = shared.value
        if vectors is None:
            return
        best = BestRows(len(ids), k, decimals, least=least)
        for batch in map(with_vectors, batches):
            for start in range(0, len(batch), FILTERED_ROWS):
                part = batch.slice(start, FILTERED_ROWS)
                points, passing = prepare(matrix(part.column("vec")), metric), choices.passing(part)
                for first in range(0, len(ids), QUERY_TILE):
                    tile = slice(first, first + QUERY_TILE)
                    scores = similarity(vectors[tile], points, metric)
                    scores = np.where(passing[choices.of_query[tile]], scores, -np.inf)
                    if every:
                        yield rows_from(least, first, scores, ids, part.column("chunk_id"), decimals)
                    else:
                        best.offer(first, scores, part.column("chunk_id"))
        yield from best.result(ids)

    return rows.mapInArrow(score, schema)


def score_probes(
    block: pa.Table, probes: list[np.ndarray], queries: DataFrame, index: DataFrame, k: int, metric: str, decimals: int
) -> DataFrame:
    """One pass over the probed buckets; every task holds the (small) query block.

    ``probes[i]`` are the buckets in which query ``i`` of the block is looked for.  The index is
    streamed past the queries of each row's bucket; it is neither shuffled nor copied.
    """
    asked = np.concatenate([np.full(len(p), i) for i, p in enumerate(probes)] or [[]]).astype(np.int64)
    bucket = np.concatenate(probes or [[]]).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    of_bucket = dict(zip(names.tolist(), np.split(asked[order], starts[1:])))
    ids = block["query_id"].combine_chunks()
    vectors = prepare(matrix(block["vec"].combine_chunks()), metric) if len(block) else None
    shared = queries.sparkSession.sparkContext.broadcast((ids, vectors, of_bucket))
    probed = index.filter(F.col("bucket").isin(names.tolist())).select("chunk_id", "vec", "bucket")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vectors, of_bucket = shared.value
        if query_vectors is None:
            return
        best, sieve = BestRows(len(query_ids), k, decimals), Sieve(query_vectors, metric)
        for batch in map(with_vectors, batches):
            buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
            order = np.argsort(buckets, kind="stable")
            bounds = np.r_[0, np.flatnonzero(np.diff(buckets[order])) + 1, len(order)] if len(order) else []
            for start, stop in zip(bounds[:-1], bounds[1:]):
                rows = batch.take(pa.array(order[start:stop]))
                own = of_bucket[int(buckets[order[start]])]
                stored = prepare(matrix(rows.column("vec")), metric)
                for at in range(0, len(stored), VECTOR_TILE):
                    part = slice(at, at + VECTOR_TILE)
                    points = sieve.stored(stored[part])
                    for first in range(0, len(own), QUERY_TILE):
                        sieve.offer(best, own[first : first + QUERY_TILE], points, rows.column("chunk_id")[part])
        yield from best.result(query_ids)

    return probed.mapInArrow(score, hit_schema(queries, index))


def score_cells(queries: DataFrame, index: DataFrame, k: int, metric: str, decimals: int) -> DataFrame:
    """Score every query against the stored vectors that share its ``cell``.

    Both sides are shuffled once by cell and sorted so that the queries of a cell
    come first: a task holds those, streams the vectors past them batch by batch,
    and emits at most ``k`` rows per query.  No cell is ever held whole, and no
    pair is emitted that is not among the best.  ``queries`` may tell in ``least`` below which score
    a query needs none.
    """
    query_type = queries.schema["query_id"].dataType
    chunk_type = index.schema["chunk_id"].dataType
    kinds = {df.schema["vec"].dataType.elementType for df in (queries, index)}
    # tasks compute with doubles; floats on both sides are moved as they are
    vec_type = T.ArrayType(T.FloatType() if kinds == {T.FloatType()} else T.DoubleType())
    left = queries.select(
        "cell",
        F.lit(0).alias("side"),
        "query_id",
        F.lit(None).cast(chunk_type).alias("chunk_id"),
        F.col("vec").cast(vec_type).alias("vec"),
        (F.col("least") if "least" in queries.columns else F.lit(None).cast("double")).alias("least"),
    )
    right = index.select(
        "cell",
        F.lit(1).alias("side"),
        F.lit(None).cast(query_type).alias("query_id"),
        "chunk_id",
        F.col("vec").cast(vec_type).alias("vec"),
        F.lit(None).cast("double").alias("least"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        id_parts, vec_parts, least_parts, query_ids, sieve, best = [], [], [], None, None, None
        for batch in map(with_vectors, batches):
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            sides = batch.column("side").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            bounds = np.r_[0, change, len(cells)] if len(cells) else []
            for start, stop in zip(bounds[:-1], bounds[1:]):
                if cells[start] != current:
                    if best is not None:
                        yield from best.result(query_ids)
                    current, best, id_parts, vec_parts, least_parts = cells[start], None, [], [], []
                run = batch.slice(start, stop - start)
                vectors = prepare(matrix(run.column("vec")), metric)
                if sides[start] == 0:
                    id_parts.append(run.column("query_id"))
                    vec_parts.append(vectors)
                    least_parts.append(pc.fill_null(run.column("least"), -np.inf).to_numpy())
                elif id_parts:
                    if best is None:
                        query_ids, sieve = pa.concat_arrays(id_parts), Sieve(np.concatenate(vec_parts), metric)
                        best, vec_parts = BestRows(len(query_ids), k, decimals, least=np.concatenate(least_parts)), []
                    score_block(best, sieve, vectors, run.column("chunk_id"))
        if best is not None:
            yield from best.result(query_ids)

    both = left.unionAll(right).repartition("cell").sortWithinPartitions("cell", "side")
    return both.mapInArrow(score, hit_schema(queries, index))


def one_of(column: str, parts: Column) -> Column:
    """The one of ``parts`` parts to which a row belongs."""
    return F.pmod(F.xxhash64(column), parts.cast("long")).cast("int")


def all_of(parts: Column) -> Column:
    """A copy of the row for each of ``parts`` parts."""
    return F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))


def grid_cells(queries: DataFrame, index: DataFrame, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """Cells in which every query meets every stored vector exactly once.

    Queries are dealt over ``rows`` and copied along the columns, stored vectors the
    other way round, so a cell holds ``1/rows`` of the one and ``1/columns`` of the other.
    """
    q = queries.withColumn("r", one_of("query_id", F.lit(rows))).withColumn("c", all_of(F.lit(columns)))
    v = index.withColumn("c", one_of("chunk_id", F.lit(columns))).withColumn("r", all_of(F.lit(rows)))
    cell = (F.col("r").cast("long") * columns + F.col("c")).alias("cell")
    return q.select(cell, "query_id", "vec"), v.select(cell, "chunk_id", "vec")


def held_by_cell(dim: int, k: int) -> int:
    """Queries that one task may hold for one cell, with their ``k`` best rows."""
    return max(1, min(CELL_BYTES // (8 * max(dim, 1)), CELL_HITS // max(k, 1)))


def bucket_cells(
    queries: DataFrame, index: DataFrame, held: int, cell_rows: int = CELL_ROWS, cell_queries: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Cells in which every query meets every stored vector of its ``bucket`` exactly once.

    Buckets are counted first.  One with many stored vectors is split into parts
    (its queries go to each of them), one with many queries into blocks (its vectors
    go to each of them).  Buckets without queries are dropped before anything is moved.

    ``cell_rows`` and ``cell_queries`` are the sizes wished for.  Every further part or block
    copies the other side of the bucket once more, so beyond one per core there are only as many
    blocks as keep ``held`` queries in a task, and as many parts as move no more copies of
    queries than of vectors.
    """
    cores = F.lit(queries.sparkSession.sparkContext.defaultParallelism)
    probed = queries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_queries"))
    stored = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_vectors"))
    layout = stored.join(probed, "bucket").select(
        "bucket",
        "n_vectors",
        "n_queries",
        F.least(F.ceil(F.col("n_queries") / (cell_queries or held)), F.greatest(F.ceil(F.col("n_queries") / held), cores)).cast("int").alias("blocks"),
    )
    balanced = F.ceil(F.col("blocks") * F.col("n_vectors") / F.col("n_queries"))
    parts = F.least(F.ceil(F.col("n_vectors") / cell_rows), F.greatest(F.ceil(cores / F.col("blocks")), balanced))
    layout = computed_if_small(layout.select("bucket", parts.cast("int").alias("parts"), "blocks"))
    q = (
        queries.join(layout, "bucket")
        .withColumn("block", one_of("query_id", F.col("blocks")))
        .withColumn("part", all_of(F.col("parts")))
    )
    v = (
        index.join(layout, "bucket")
        .withColumn("part", one_of("chunk_id", F.col("parts")))
        .withColumn("block", all_of(F.col("blocks")))
    )
    cell = F.xxhash64("bucket", "part", "block").alias("cell")
    extra = ["least"] if "least" in queries.columns else []
    return q.select(cell, "query_id", "vec", *extra), v.select(cell, "chunk_id", "vec")


def computed_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` computed once and marked for broadcast if it has at most ``rows`` rows.

    Otherwise it stays a plan, joined by shuffling.
    """
    head = df.limit(rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema)) if len(head) <= rows else df


# ---- operators ----------------------------------------------------------------------


def vectors_only(queries: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides cut down to their ids and vectors.

    Rows without a vector are skipped inside the tasks: a filter here would be pushed
    below the embedder and run it twice.
    """
    q = queries.select("query_id", F.col("query_vec").alias("vec"))
    extra = ["bucket"] if "bucket" in index.columns else []
    return q, index.select("chunk_id", F.col("embedding").alias("vec"), *extra)


def knn_exact(
    queries: DataFrame,
    index: DataFrame,
    k: int = DEFAULT_LIMIT,
    metric: str = "cosine",
    decimals: int = SCORE_DECIMALS,
    broadcast_bytes: int = BROADCAST_BYTES,
    columns: int | None = None,
    least: float = -np.inf,
) -> DataFrame:
    """The ``k`` nearest stored vectors of every query; scores below ``least`` may be left out.

    The query vectors are measured: up to ``broadcast_bytes`` they are sent to every
    task and the index is scanned once; beyond that, or if a task should not hold them and their
    hits, both sides are dealt over a grid.
    """
    if metric not in METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    q, v = vectors_only(queries, index)
    v = v.select("chunk_id", "vec")
    if k <= 0:
        return topk_per_query(q.sparkSession.createDataFrame([], hit_schema(q, v)), k)
    block = held_queries(q, min(FEW_QUERIES, HELD_ROWS // k), broadcast_bytes)
    if block is not None:
        return topk_per_query(score_with_broadcast(q, v, k, metric, decimals, block, least), k)
    n_queries, dim = q.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    query_bytes = n_queries * max(dim or 0, 0) * 8
    if n_queries * k > HELD_ROWS:  # no query has more hits than there are vectors
        n_vectors = max(v.count(), 1)
        if k >= n_vectors and broadcast_bytes > 0 and n_queries * n_vectors > HELD_ROWS:
            return topk_per_query(score_all(q, v, metric, decimals, -(-query_bytes // broadcast_bytes), least), n_vectors)
        k = min(k, n_vectors)
    # Blocks of queries that a task can hold, together with their k best rows; every block copies the vectors.
    rows = max(-(-n_queries // held_by_cell(dim or 0, k)), 2 if query_bytes > broadcast_bytes else 1)
    rows = min(rows, n_queries)
    if rows <= 1:
        hits = score_with_broadcast(q, v, k, metric, decimals, least=least)
    else:
        columns = columns or grid_columns(q.sparkSession, n_queries, v.count(), rows)
        hits = score_cells(*grid_cells(q, v, rows, columns), k, metric, decimals)
    return topk_per_query(hits, k)


def score_all(queries: DataFrame, index: DataFrame, metric: str, decimals: int, turns: int, least: float) -> DataFrame:
    """Every pair that reaches ``least``, for queries that leave out no other row.

    Each turn of queries is one pass over the index, which is neither shuffled nor copied however much the
    queries ask for, and a task holds the pairs of one block only.
    """
    own = F.pmod(F.xxhash64("query_id"), F.lit(turns))
    found = None
    for turn in range(max(turns, 1)):
        hits = score_all_turn(queries.filter(own == turn) if turns > 1 else queries, index, metric, decimals, least)
        found = hits if found is None else found.unionAll(hits)
    return found


def score_all_turn(queries: DataFrame, index: DataFrame, metric: str, decimals: int, least: float) -> DataFrame:
    block = with_vectors(queries.toArrow().combine_chunks())
    shared = queries.sparkSession.sparkContext.broadcast(
        (block["query_id"].combine_chunks(), prepare(matrix(block["vec"].combine_chunks()), metric) if len(block) else None)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        if vectors is None:
            return
        step = max(1, PAIRS // min(len(ids), QUERY_TILE))
        for batch in map(with_vectors, batches):
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                points = prepare(matrix(part.column("vec")), metric)
                for first in range(0, len(ids), QUERY_TILE):
                    scores = similarity(vectors[first : first + QUERY_TILE], points, metric)
                    yield rows_from(least, first, scores, ids, part.column("chunk_id"), decimals)

    return index.mapInArrow(score, hit_schema(queries, index))


def grid_columns(spark: SparkSession, n_queries: int, n_vectors: int, rows: int) -> int:
    """Columns of the grid: one per ``CELL_ROWS`` stored vectors, but no more than move
    as many query copies as vector copies, and at least as many as make ``CORE_CELLS`` cells per core."""
    balanced = rows * n_vectors // max(n_queries, 1)
    return max(min(n_vectors // CELL_ROWS, balanced), -(-CORE_CELLS * spark.sparkContext.defaultParallelism // rows))


def projections(dim: int, count: int, seed: int) -> np.ndarray:
    """Random unit vectors, a column each."""
    drawn = np.random.default_rng(seed).normal(size=(dim, count))
    return drawn / np.sqrt((drawn * drawn).sum(axis=0))


def lsh_keys(vectors: np.ndarray, drawn: np.ndarray, tables: int, bucket_length: float) -> np.ndarray:
    """``(rows, tables)``: the bucket of each unit vector in each table, made of the intervals that its projections fall into."""
    cell = np.floor(prepare(vectors, "cosine") @ drawn / bucket_length).astype(np.int64).reshape(len(vectors), tables, -1)
    key = np.tile(np.arange(1, tables + 1, dtype=np.uint64), (len(vectors), 1))
    for i in range(cell.shape[2]):
        key = (key ^ cell[:, :, i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def lsh_buckets(df: DataFrame, drawn: np.ndarray, id_col: str, tables: int, bucket_length: float) -> DataFrame:
    """One row per table."""
    shared = df.sparkSession.sparkContext.broadcast(drawn)

    @F.arrow_udf("array<long>")
    def keys(vecs: pa.Array) -> pa.Array:
        present = vecs.drop_null()
        if not len(present):
            return pa.nulls(len(vecs), pa.list_(pa.int64()))
        found = lsh_keys(matrix(present), shared.value, tables, bucket_length)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(present) + 1, dtype=np.int32) * tables), pa.array(found.ravel()))
        row = np.cumsum(pc.is_valid(vecs).to_numpy(zero_copy_only=False)) - 1
        return lists.take(pa.array(row, mask=pc.is_null(vecs).to_numpy(zero_copy_only=False)))

    return df.select(id_col, "vec", F.explode(keys("vec")).alias("bucket"))


def score_shared_keys(
    block: pa.Table, drawn: np.ndarray, tables: int, bucket_length: float, queries: DataFrame, index: DataFrame, k: int, decimals: int
) -> DataFrame:
    """One pass over the index; every task holds the (small) query block and which of its queries are in a bucket.

    Each stored vector is hashed where it is read, and scored against the queries that share a
    bucket with it, once for each pair; nothing is shuffled or copied.
    """
    vectors = prepare(matrix(block["vec"].combine_chunks()), "cosine")
    asked = lsh_keys(vectors, drawn, tables, bucket_length).ravel()
    order = np.argsort(asked, kind="stable")
    names, starts = np.unique(asked[order], return_index=True)
    ends = np.r_[starts[1:], len(order)]
    shared = queries.sparkSession.sparkContext.broadcast((block["query_id"].combine_chunks(), vectors, names, starts, ends, order // tables, drawn))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, names, starts, ends, owner, drawn = shared.value
        best = BestRows(len(query_ids), k, decimals)
        for batch in map(with_vectors, batches):
            for at in range(0, len(batch), FILTERED_ROWS):
                part = batch.slice(at, FILTERED_ROWS)
                points = prepare(matrix(part.column("vec")), "cosine")
                key = lsh_keys(points, drawn, tables, bucket_length)
                place = np.minimum(np.searchsorted(names, key), len(names) - 1)
                row, table = np.nonzero(names[place] == key)
                bucket = place[row, table]
                size = ends[bucket] - starts[bucket]
                first = np.repeat(starts[bucket] - (np.cumsum(size) - size), size)
                pair = np.unique(np.repeat(row, size) * len(query_ids) + owner[first + np.arange(int(size.sum()))])
                row, query = pair // len(query_ids), pair % len(query_ids)
                for start in range(0, len(pair), PAIRS):
                    some = slice(start, start + PAIRS)
                    scores = np.einsum("pd,pd->p", vectors[query[some]], points[row[some]])
                    best.offer_pairs(query[some], scores, part.column("chunk_id").take(pa.array(row[some])))
        yield from best.result(query_ids)

    return index.mapInArrow(score, hit_schema(queries, index))


def ann_lsh(
    queries: DataFrame,
    index: DataFrame,
    k: int = DEFAULT_LIMIT,
    metric: str = "cosine",
    tables: int = 8,
    hashes: int = 2,
    bucket_length: float = 0.25,
    seed: int = 42,
    decimals: int = SCORE_DECIMALS,
    **cells,
) -> DataFrame:
    """Approximate neighbours: exact scores among the vectors that share a hash bucket.

    Random projections of the unit vectors are cut into intervals; ``hashes`` of them
    make a bucket, and a pair is scored if it shares a bucket in any of the ``tables``.
    """
    cosine_only(metric)
    q, v = vectors_only(queries, index)
    v = v.select("chunk_id", "vec")
    sample = v.dropna(subset=["vec"]).select(F.size("vec").alias("dim")).first()
    block = held_queries(q, min(FEW_QUERIES, HELD_ROWS // max(k, 1)), BROADCAST_BYTES)
    if sample is None or (block is not None and not len(block)):
        return topk_per_query(q.sparkSession.createDataFrame([], hit_schema(q, v)), k)
    drawn = projections(sample["dim"], tables * hashes, seed)
    if block is not None and not cells:
        return topk_per_query(score_shared_keys(block, drawn, tables, bucket_length, q, v, k, decimals), k)
    hits = score_cells(
        *bucket_cells(
            lsh_buckets(q, drawn, "query_id", tables, bucket_length),
            lsh_buckets(v, drawn, "chunk_id", tables, bucket_length),
            held_by_cell(sample["dim"], k),
            **cells,
        ),
        k,
        metric,
        decimals,
    )
    once = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return topk_per_query(once, k)


def cosine_only(metric: str) -> None:
    """The buckets are made of unit vectors: they say nothing about lengths."""
    if metric != "cosine":
        raise ValueError(f"approximate searches serve the metric cosine, not {metric}")


def ivf_train(
    index: DataFrame, nlist: int = 16, seed: int = 42, iterations: int = 10, fraction: float = 1.0
) -> np.ndarray:
    """Centroids of the stored vectors, scaled to length one.

    ``fraction`` trains on a sample; it only moves the centroids, every vector is
    assigned to one of them by :func:`ivf_assign`.
    """
    # kept on disk: a vector is made once, however often it is read, and takes no heap; a filter
    # above the embedder itself would be pushed below it and run it twice
    vectors = index.select(F.col("embedding").cast("array<double>").alias("embedding")).persist(StorageLevel.DISK_ONLY)
    raw = vectors.dropna(subset=["embedding"]).select(array_to_vector("embedding").alias("raw"))
    points = Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(raw).select("features")
    if fraction < 1.0:
        points = points.sample(fraction, seed=seed)
    points = points.persist(StorageLevel.DISK_ONLY)
    try:
        return np.array(KMeans(k=nlist, seed=seed, maxIter=iterations).fit(points).clusterCenters())
    finally:
        points.unpersist()
        vectors.unpersist()


def nearest_centroids(df: DataFrame, vec_col: str, centroids: np.ndarray, count: int) -> Column:
    """Column with the ``count`` centroids that are nearest to a vector, in no order."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    count = min(count, len(centroids))

    @F.arrow_udf("array<int>")
    def nearest(vecs: pa.Array) -> pa.Array:
        present = vecs.drop_null()
        if not len(present):
            return pa.nulls(len(vecs), pa.list_(pa.int32()))
        points = prepare(matrix(present), "cosine")
        found = [
            np.argpartition(-similarity(points[i : i + QUERY_TILE], shared.value, "l2"), count - 1)[:, :count]
            for i in range(0, len(points), QUERY_TILE)
        ]
        offsets = np.arange(len(present) + 1, dtype=np.int32) * count
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).ravel().astype(np.int32)))
        row = np.cumsum(pc.is_valid(vecs).to_numpy(zero_copy_only=False)) - 1
        return lists.take(pa.array(row, mask=pc.is_null(vecs).to_numpy(zero_copy_only=False)))

    return nearest(F.col(vec_col))


def ivf_assign(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``bucket``, the nearest centroid; write the index partitioned by it."""
    return index.withColumn("bucket", F.get(nearest_centroids(index, "embedding", centroids, 1), F.lit(0)))


def ann_ivf(
    queries: DataFrame,
    index: DataFrame,
    centroids: np.ndarray,
    k: int = DEFAULT_LIMIT,
    nprobe: int = 4,
    metric: str = "cosine",
    decimals: int = SCORE_DECIMALS,
    **cells,
) -> DataFrame:
    """Approximate neighbours among the vectors of each query's ``nprobe`` nearest centroids.

    ``index`` carries the ``bucket`` of :func:`ivf_assign`; if it was written
    partitioned by that column, only the probed partitions are read.
    """
    cosine_only(metric)
    q, v = vectors_only(queries, index)
    block = held_queries(q, min(FEW_QUERIES, HELD_ROWS // max(k, 1)), BROADCAST_BYTES)
    if block is not None and not cells:
        points = prepare(matrix(block["vec"].combine_chunks()), "cosine") if len(block) else np.zeros((0, len(centroids[0])))
        count = min(nprobe, len(centroids))
        probes = np.argpartition(-similarity(points, centroids, "l2"), count - 1, axis=1)[:, :count]
        return topk_per_query(score_probes(block, list(probes), q, v, k, metric, decimals), k)
    q = q.withColumn("bucket", F.explode(nearest_centroids(q, "vec", centroids, nprobe)))
    # At most one value per centroid: known before planning, it prunes the partitions read.
    probed = [row["bucket"] for row in q.select("bucket").distinct().collect()]
    v = v.filter(F.col("bucket").isin(probed))
    hits = score_cells(*bucket_cells(q, v, held_by_cell(len(centroids[0]), k), **cells), k, metric, decimals)
    return topk_per_query(hits, k)


def bucket_radii(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(bucket, n, radius, blank)``: how many unit vectors a bucket has, how far from its centroid they
    are, and whether there is a zero vector among them."""
    shared = index.sparkSession.sparkContext.broadcast(centroids)
    schema = "bucket int, n long, radius double, blank boolean"
    rows = index.select("bucket", F.col("embedding").alias("vec"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius, blank = np.zeros(len(shared.value), np.int64), np.zeros(len(shared.value)), np.zeros(len(shared.value), bool)
        for batch in map(with_vectors, batches):
            if len(batch):
                points = prepare(matrix(batch.column("vec")), "cosine")
                bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
                np.add.at(n, bucket, 1)
                np.maximum.at(radius, bucket, np.sqrt(((points - shared.value[bucket]) ** 2).sum(axis=1)))
                np.logical_or.at(blank, bucket, ~points.any(axis=1))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(n[seen]), pa.array(radius[seen]), pa.array(blank[seen])], ["bucket", "n", "radius", "blank"]
        )

    parts = rows.mapInArrow(measure, schema)
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.bool_or("blank").alias("blank"))


def knn_pruned(
    queries: DataFrame,
    index: DataFrame,
    centroids: np.ndarray,
    radii: DataFrame,
    k: int = DEFAULT_LIMIT,
    decimals: int = SCORE_DECIMALS,
    first: int = 4,
) -> DataFrame:
    """The ``k`` nearest stored vectors by cosine, as :func:`knn_exact` finds them, without reading all buckets.

    ``radii`` are the :func:`bucket_radii` of ``index``.  On unit vectors the distance of a query
    from a centroid and the bucket's radius bound the score of all that is in it.  Buckets
    are read by falling bound, ``first`` for each query, then twice as many, and so on; a query
    is done when no bucket that is left can reach its k-th score.  More queries than the driver should
    read are dealt to the buckets in the same rounds, and hits stay in tables.
    """
    spark = queries.sparkSession
    q, v = vectors_only(queries, index)
    known = radii.toArrow()  # a row for each centroid at most
    bucket, size = known["bucket"].to_numpy(), known["n"].to_numpy()
    radius, blank = known["radius"].to_numpy(), known["blank"].to_numpy(zero_copy_only=False).astype(bool)
    empty = topk_per_query(spark.createDataFrame([], hit_schema(q, v)), max(k, 0))
    if k <= 0 or not len(bucket):
        return empty
    k = min(k, int(size.sum()))
    n_queries = q.count()
    held = held_by_cell(len(centroids[0]), k)
    if n_queries > FEW_QUERIES and held >= QUERY_TILE:
        return topk_per_query(pruned_cells(q, v, centroids[bucket], bucket, radius, blank, k, decimals, first, held), k)
    turns = max(1, -(-n_queries // min(FEW_QUERIES, max(1, HELD_ROWS // k))))
    found = []
    for turn in range(turns):
        block = with_vectors(q.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).toArrow().combine_chunks())
        if len(block):
            points = prepare(matrix(block["vec"].combine_chunks()), "cosine")
            bound = score_bounds(points, centroids[bucket], radius, blank)
            found += pruned_rounds(block, bound, bucket, q, v, k, decimals, first)
    if not found:
        return empty
    hits = spark.createDataFrame(pa.concat_tables(found).cast(to_arrow_schema(hit_schema(q, v))), hit_schema(q, v))
    return topk_per_query(hits, k)


def score_bounds(points: np.ndarray, centroids: np.ndarray, radius: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Greatest cosine of a query with any vector of a bucket, a row for each query."""
    square = (points**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None, :] - 2.0 * points @ centroids.T
    nearest = np.maximum(np.sqrt(np.maximum(square, 0.0)) - radius[None, :], 0.0)
    bound = 1.0 - nearest**2 / 2.0
    bound[:, blank] = np.maximum(bound[:, blank], 0.0)  # a zero vector scores 0 with everything
    bound[~points.any(axis=1)] = 0.0  # and so does a query without words
    return bound + 1e-6  # rounding


def pruned_rounds(block, bound, bucket, queries, index, k, decimals, first) -> list[pa.Table]:
    """The best hits of each query of ``block``, read in rounds."""
    order = np.argsort(-bound, axis=1)
    floor, done, tables = np.full(len(block), -np.inf), 0, []
    number = {key: i for i, key in enumerate(block["query_id"].to_pylist())}
    held: list[list[float]] = [[] for _ in range(len(block))]
    while done < len(bucket):
        count = min(max(first, done), len(bucket) - done)
        next_ = order[:, done : done + count]
        probes = [bucket[row[bound[i, row] >= floor[i]]] for i, row in enumerate(next_)]
        if not any(len(p) for p in probes):
            break
        hits = topk_per_query(score_probes(block, probes, queries, index, k, "cosine", decimals), k).toArrow()
        tables.append(hits.select(["query_id", "chunk_id", "score"]))
        for key, score in zip(hits["query_id"].to_pylist(), hits["score"].to_pylist()):
            held[number[key]].append(score)
        for i, scores in enumerate(held):
            if len(scores) >= k:
                held[i] = sorted(scores, reverse=True)[:k]
                floor[i] = held[i][-1]
        done += count
    return tables


def pruned_cells(
    queries: DataFrame, index: DataFrame, centroids: np.ndarray, bucket: np.ndarray, radius: np.ndarray, blank: np.ndarray, k: int, decimals: int, first: int, held: int
) -> DataFrame:
    """The best hits of any number of queries, found in the rounds of :func:`pruned_rounds`.

    In each round the queries are dealt to the buckets that can still reach their k-th score so far,
    and meet their vectors in cells; the hits of a round are written, no row of them comes to the driver.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((centroids, bucket, radius, blank))
    found, floors, done = None, None, 0
    while done < len(bucket):
        count = min(max(first, done), len(bucket) - done)
        asked = queries.withColumn("least", F.lit(None).cast("double"))
        if floors is not None:
            asked = queries.join(floors, queries["query_id"].eqNullSafe(floors["of_query"]), "left").select("query_id", "vec", "least")
        asked = written(needed_buckets(asked, shared, done, count), "probes")
        names = [row["bucket"] for row in asked.select("bucket").distinct().collect()]  # a row for each centroid at most
        if not names:
            break
        probed = index.filter(F.col("bucket").isin(names))
        hits = written(score_cells(*bucket_cells(asked, probed, held), k, "cosine", decimals), "hits")
        found = hits if found is None else found.unionAll(hits)
        done += count
        if done < len(bucket):
            best = topk_per_query(found, k).filter(F.col("rank") == k)
            floors = written(best.select(F.col("query_id").alias("of_query"), F.col("score").alias("least")), "floors")
    return spark.createDataFrame([], hit_schema(queries, index)) if found is None else found


def needed_buckets(queries: DataFrame, shared, done: int, count: int) -> DataFrame:
    """``(query_id, vec, least, bucket)``: a row for each of the ``count`` buckets after the best ``done`` that can reach ``least``."""
    schema = T.StructType([*queries.schema.fields, T.StructField("bucket", T.IntegerType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, bucket, radius, blank = shared.value
        for batch in map(with_vectors, batches):
            for at in range(0, len(batch), QUERY_TILE):
                part = batch.slice(at, QUERY_TILE)
                bound = score_bounds(prepare(matrix(part.column("vec")), "cosine"), centroids, radius, blank)
                least = pc.fill_null(part.column("least"), -np.inf).to_numpy()
                next_ = np.argsort(-bound, axis=1)[:, done : done + count]
                row, place = np.nonzero(np.take_along_axis(bound, next_, axis=1) >= least[:, None])
                columns = part.take(pa.array(row)).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bucket[next_[row, place]].astype(np.int32))], schema.names)

    return queries.mapInArrow(choose, schema)
