"""Importance resampling of documents towards a target distribution.

A feature is a run of one or more consecutive words; features fall into a fixed number of
hashed buckets.  How much more often a bucket occurs in the target texts than in the
documents is its gain, an array as long as there are buckets; a document's weight is the
mean gain of its features.  With Gumbel noise drawn from its id added, the documents with
the highest scores are a sample without replacement in proportion to ``exp(weight / 1000)``.

The draw sorts nothing but the winners.  A distributed quickselect finds the key of the last
one: a few random rows inside the open interval are pivots, one aggregation counts exactly
what lies before, on and behind each of them, and the interval shrinks to the gap that holds
the wanted place, until a pivot is that row.  Keys are ``(score, id, row)``, so no two are
alike, and ties do not matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import add_columns, stored, without

ORDER = 2  # words of a feature, at most
BUCKETS = 10_000
MIN_WORDS = 20  # of a document that can be drawn
PERCENT = 25  # of those documents
SEED = 7
PIVOTS = 32  # keys that are tried at once
PIECE_BYTES = 4 << 20  # of a text whose features are computed at once
LONG_WORD = 256  # bytes of a word beyond which it is hashed by itself
RESULTS = ("n_features", "weight", "score", "rank")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
IS_WORD[128:] = True
NO_WORD = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


CRC = crc_table()


# ---- features -----------------------------------------------------------------------


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of the words of texts that lie one behind the other in lower case."""
    inside = IS_WORD[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1 - start, np.searchsorted(offsets, start, "right") - 1


def append_words(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of a word each, all words in step."""
    order = np.argsort(-length, kind="stable")
    at, left, register = start[order], length[order], state[order]
    n_long = int(np.searchsorted(-left, -LONG_WORD))
    for i in range(n_long):
        word = data[at[i] : at[i] + left[i]].tobytes()
        register[i] = zlib.crc32(word, int(register[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for step in range(int(left[n_long]) if n_long < len(left) else 0):
        active = slice(n_long, int(np.searchsorted(-left, -step)))
        now = register[active]
        register[active] = CRC[(now ^ data[at[active] + step]) & 0xFF] ^ (now >> 8)
    out = np.empty_like(register)
    out[order] = register
    return out


def features(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int, context: int = 0) -> Iterator[tuple]:
    """``(buckets, text numbers)`` of the runs of 1, 2, ... words; runs inside the first ``context`` words are left out."""
    start, length, text = word_spans(data, offsets)
    word = np.arange(len(start))
    register = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for n in range(order):
        if n:  # a space and the next word, where the text goes on
            more = word + n < len(start)
            word, register = word[more], register[more]
            more = text[word] == text[word + n]
            word, register = word[more], register[more]
            register = CRC[(register ^ 0x20) & 0xFF] ^ (register >> 8)
        register = append_words(register, data, start[word + n], length[word + n])
        new = word + n >= context
        yield ((register[new] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), text[word[new]]


def pieces(text: bytes, order: int) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of a long text, cut between words; each begins with the last words of the one before, and their number."""
    at, context = 0, []
    while at < len(text):
        cut = NO_WORD.search(text, at + PIECE_BYTES)
        end = cut.start() if cut else len(text)
        data = LOWER[np.frombuffer(b" ".join([*context, text[at:end]]), np.uint8)]
        yield data, len(context)
        start, length, _ = word_spans(data, np.array([0, len(data)]))
        last = slice(max(0, len(start) - order + 1), len(start))
        context = [data[s : s + n].tobytes() for s, n in zip(start[last], length[last])]
        at = end


def text_features(column: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(buckets, row numbers)`` of the features of a column of texts, in parts of bounded size."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        size = int(offsets[stop] - offsets[row])
        if size > PIECE_BYTES:  # one long text
            for data, context in pieces(column[row].as_py(), order):
                for bucket, _ in features(data, np.array([0, len(data)]), order, buckets, context):
                    yield bucket, np.full(len(bucket), row)
        elif size:
            data = LOWER[np.frombuffer(column.buffers()[2], np.uint8, size, int(offsets[row]))]
            for bucket, text in features(data, offsets[row : stop + 1] - offsets[row], order, buckets):
                yield bucket, text + row
        row = stop


def bucket_counts(docs: DataFrame, text_col: str, order: int, buckets: int) -> np.ndarray:
    """How often the features of all texts fall into each bucket: one partial array a task, added up."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _ in text_features(batch.column(0), order, buckets):
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = docs.select(docs[f"`{text_col}`"]).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # a row for each bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(share in the target / share in the source))``, one added to each bucket."""
    n = len(source)
    top, low = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * top / ((s + 1.0) * low))) for s, t in zip(source.tolist(), target.tolist())])


# ---- weights and scores -------------------------------------------------------------


def weigh(docs: DataFrame, gains: np.ndarray, text_col: str, order: int) -> DataFrame:
    """``docs`` without its text and with ``n_features, n_words, weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains.astype(np.float64))
    new = [T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight")]
    column = docs.columns.index(text_col)

    def work(slices):
        gain = shared.value
        for batch in slices:
            count, words, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, (bucket, row) in enumerate(text_features(batch.column(column), order, len(gain))):
                count += np.bincount(row, minlength=batch.num_rows)
                if i % order == 0:  # runs of one word come first
                    words += np.bincount(row, minlength=batch.num_rows)
                total += np.bincount(row, gain[bucket], batch.num_rows).astype(np.int64)
            yield [pa.array(count), pa.array(words), pa.array(np.floor_divide(total, np.maximum(count, 1)))]

    return add_columns(docs, new, work, leave_out=(text_col,), slice_bytes=2 * PIECE_BYTES)


def gumbel(id_col: Column, seed: int) -> Column:
    """Noise of an id in thousandths: the first 32 bits of the SHA-256 of ``<seed>:<id>`` as a uniform number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform)))


# ---- the draw -----------------------------------------------------------------------


def before(key: tuple) -> Column:
    """Whether a row ``(score, doc_id, place)`` comes before ``key``: higher scores first, ties by id."""
    score, doc_id, place = map(F.lit, key)
    tie = (F.col("doc_id") < doc_id) | ((F.col("doc_id") == doc_id) & (F.col("place") < place))
    return (F.col("score") > score) | ((F.col("score") == score) & tie)


def equal(key: tuple) -> Column:
    return (F.col("score") == key[0]) & (F.col("doc_id") == key[1]) & (F.col("place") == key[2])


def kth_key(rows: DataFrame, k: int) -> tuple:
    """The key of the ``k``-th of ``rows(score, doc_id, place)``, which are at least ``k``, by distributed quickselect."""
    inside, passed, turn = rows, 0, 0
    low = high = None
    while True:
        by_chance = F.xxhash64("place", F.lit(turn))
        tried = inside.orderBy(by_chance).limit(PIVOTS).select("score", "doc_id", "place").collect()
        pivots = sorted((tuple(r) for r in tried), key=lambda key: (-key[0], key[1], key[2]))
        sums = [F.sum(test(key).cast("long")) for key in pivots for test in (before, equal)]
        counts = inside.agg(*sums).first()
        done = passed
        for key, n_before, n_equal in zip(pivots, counts[0::2], counts[1::2]):
            if done + n_before < k <= done + n_before + n_equal:
                return key
            if done + n_before + n_equal < k:
                low, passed = key, done + n_before + n_equal
            else:
                high = key
                break
        inside = rows
        if low is not None:
            inside = inside.where(~before(low) & ~equal(low) & (F.col("score") <= low[0]))
        if high is not None:
            inside = inside.where(before(high) & (F.col("score") >= high[0]))
        turn += 1


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` from 1: sorted by ranges, numbered inside each, shifted by the sizes of those before."""
    keys = [F.desc("score"), F.asc("doc_id"), F.asc("place")]
    ordered = winners.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("at", 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    shift = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("part", shift.alias("shift")))
    rank = F.col("shift") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(shifts, part == F.col("part")).select(*winners.columns, rank.alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    order: int = ORDER,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``n_features, weight, score, rank``; ``rank`` numbers the documents drawn, others have NULL.

    Words are stretches of ASCII letters (A-Z lower-cased), digits and characters beyond
    ASCII.  Of the documents with at least ``min_words`` words, ``percent`` of a hundred (rounded
    down) are drawn: those with the highest scores, ties to the smaller id.  A NULL or empty
    text has no features and weight 0.  A row with a NULL id has a NULL score and is not
    drawn or counted.  Rows that repeat an id count each by itself; if they tie, any of them goes
    first.  Columns of ``docs`` with the names of the new ones are replaced, all others kept
    (the text only with ``keep_text``).  ``target`` needs a column ``text_col``; an empty one
    gives gains all the same.
    """
    source = bucket_counts(docs, text_col, order, buckets)
    gains = bucket_gains(source, bucket_counts(target, text_col, order, buckets))
    kept = without(docs, [*RESULTS, *([] if keep_text else [text_col])])
    row = F.struct(*[kept[f"`{c}`"] for c in kept.columns]).alias("row")
    slim = docs.select(row, docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    weighed = weigh(slim, gains, "text", order)
    score = (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")
    scored = stored(weighed.withColumns({"score": score, "place": F.monotonically_increasing_id()}), "scored")
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    keys = scored.where(able).select("score", "doc_id", "place")
    k = percent * keys.count() // 100
    out = [F.col(f"row.`{c}`").alias(c) for c in kept.columns]
    out += [F.col(c) for c in ("n_features", "weight", "score")]
    none = F.lit(None).cast("long").alias("rank")
    if k <= 0:
        return scored.select(*out, none)
    last = kth_key(keys, k)
    drawn = able & (before(last) | equal(last))
    return ranked(scored.where(drawn)).select(*out, "rank").unionAll(
        scored.where(~F.coalesce(drawn, F.lit(False))).select(*out, none)
    )
