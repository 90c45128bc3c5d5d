"""The best rows per query inside one task, as NumPy and Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    scale = 10.0**decimals
    out = np.abs(x)
    out *= scale
    out += 0.5
    np.floor(out, out=out)
    if (x < 0).any():
        out *= np.sign(x)
    out /= scale
    return out


def rows_from(
    least: float, first: int, scores: np.ndarray, query_ids: pa.Array, ids: pa.Array, decimals: int
) -> pa.RecordBatch:
    """All rows of a score block of the queries ``first, first + 1, ...`` that reach ``least``.

    For queries whose limit no number of rows exceeds: nothing is ranked or held, a block is passed on as it is scored.
    """
    score = half_up(scores, decimals)
    q, row = np.nonzero((score >= least) & (score > -np.inf))  # -inf: left out
    return pa.RecordBatch.from_arrays(
        [query_ids.take(pa.array(first + q)), ids.take(pa.array(row)), pa.array(score[q, row])], ["query_id", "chunk_id", "score"]
    )


class BestRows:
    """The ``k`` best ids seen so far for each query of a block.

    Larger scores are better and, among equal ones, smaller ids.  What is held stays
    near ``k`` rows per query, however many equal scores (copies of a text) come by.
    Scores below ``least``, of all queries or of each of them, need not be held.
    """

    def __init__(self, n_queries: int, k: int, decimals: int, positive: bool = False, least: float | np.ndarray = -np.inf):
        self.k, self.decimals, self.positive = k, decimals, positive
        self.least = np.broadcast_to(np.asarray(least, np.float64), n_queries)
        self.slack = 10.0**-decimals  # what rounding may lift up to the floor
        self.floor = np.full(n_queries, -np.inf)  # k-th best score so far ...
        self.floor_id = np.full(n_queries, None, dtype=object)  # ... and its id
        self.rows: list[pa.Table] = []
        self.pending = 0  # rows offered since the last clean-up

    def offer(self, first: int | np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        """Score block of the queries ``first, first + 1, ...`` (or of these numbers) against ``ids``."""
        number = first if isinstance(first, np.ndarray) else np.arange(first, first + len(scores))
        known = self.floor[number]
        floor, fresh = known.copy(), np.isneginf(known)
        if fresh.any() and scores.shape[1] > self.k:
            floor[fresh] = np.partition(scores[fresh], -self.k, axis=1)[:, -self.k]
        floor = np.maximum(floor, self.least[number]) - self.slack
        keep = (scores >= floor[:, None]) & (scores > -np.inf)  # -inf: left out
        if self.positive:  # a score of zero means "no hit"
            keep &= scores > 0
        q, row = np.nonzero(keep)
        self.hold(number, q, row, scores[q, row], ids)

    def bars(self, number: np.ndarray) -> np.ndarray:
        """What a score of these queries has to reach, before it is rounded."""
        return np.maximum(self.floor[number], self.least[number]) - self.slack

    def hold(self, number: np.ndarray, q: np.ndarray, row: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of the queries ``number[q]`` and the ids ``ids[row]``."""
        score = half_up(scores, self.decimals)
        if len(q) > 4 * len(number):
            at = self.beats_floor(q, row, score, self.floor[number], self.floor_id[number], ids)
            q, row, score = q[at], row[at], score[at]
        self.pending += len(q)
        self.rows.append(pa.table({"q": number[q], "score": score, "id": ids.take(pa.array(row))}))
        if self.pending >= max(self.k * len(self.floor), 10_000):
            self.settle()

    def offer_pairs(self, q: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of single pairs of a query and an id."""
        score = half_up(scores, self.decimals)
        keep = score >= self.floor[q]
        self.pending += int(keep.sum())
        self.rows.append(pa.table({"q": q[keep], "score": score[keep], "id": ids.filter(pa.array(keep))}))
        if self.pending >= max(self.k * len(self.floor), 10_000):
            self.settle()

    def beats_floor(self, q, row, score, floor, floor_id, ids: pa.Array) -> np.ndarray:
        """Which candidates are better than the k-th best so far, ties decided by id."""
        order = pc.sort_indices(ids).to_numpy()
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        ordered = ids.take(pa.array(order)).to_numpy(zero_copy_only=False)
        smaller = np.full(len(floor), len(ids))  # how many ids of the block precede the floor's
        known = ~np.isneginf(floor)
        smaller[known] = np.searchsorted(ordered.astype(object), floor_id[known])
        return (score > floor[q]) | ((score == floor[q]) & (rank[row] < smaller[q])) | ~known[q]

    def settle(self) -> None:
        """Forget what can no longer be among the best."""
        self.pending = 0
        held = pa.concat_tables(self.rows)
        held = held.take(
            pc.sort_indices(held, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        )
        q = held["q"].to_numpy()
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = np.flatnonzero(place == self.k - 1)
        self.floor[q[last]] = held["score"].to_numpy()[last]
        self.floor_id[q[last]] = held["id"].take(pa.array(last)).to_pylist()
        self.rows = [held.filter(pa.array(place < self.k))]

    def result(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        self.settle()
        held = pa.concat_tables(self.rows).combine_chunks()
        yield from pa.table(
            {
                "query_id": query_ids.take(held["q"].combine_chunks()),
                "chunk_id": held["id"],
                "score": held["score"],
            }
        ).to_batches()
