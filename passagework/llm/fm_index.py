"""Substring dedup: repeated windows of words, found with FM-indexes.

What may repeat is brought together by content.  Of the short word sequences inside
a window, the one with the smallest hash is its anchor; equal windows have equal
anchors at the same place.  Successive windows with the same anchor form a segment,
and segments are shuffled by their anchor.  Equal segments are recognised by a
digest: all but the first are repeats as a whole, and an anchor with one distinct
segment needs no further look.  The other segments become shards: their words are
indexed with an FM-index (Burrows-Wheeler transform in a wavelet matrix of packed
bits), the windows are streamed through backward search, and the interval of each
gives its earliest occurrence.

An anchor with more than ``PART_SEGMENTS`` distinct segments is split into parts,
every two of which meet in a shard, so a shard has a bounded number of segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import add_columns, stored, without, word_lists
from passagework.llm.decontaminate import suffix_array
from passagework.llm.odd_sketch import WordHashes, mix

WINDOW = 20
ANCHOR = 6  # words of an anchor
PART_SEGMENTS = 8192
SHARD_WORDS = 400_000  # words of the anchors that share an index
WORDS_HELD = 400_000
PIECE = 1 << 19  # windows of a long document handled at once
TOGETHER = 1 << 16  # words of shorter documents handled at once
SLICE_BYTES = 4 << 20
RESULTS = ["n_words", "n_removed"]
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # bases of the segment digests


class Wavelet:
    """Rank queries over a sequence of numbers, a bit plane per level, 64 bits to a word."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.planes, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bits = (values >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, np.uint8)), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.planes.append((packed, before))
            self.zeros.append(len(bits) - int(before[-1]))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

        self.begin = self.descend(np.arange(1 << levels), np.zeros(1 << levels, np.int64))

    def descend(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position comes to lie if it goes down with the bits of a value."""
        for nth, (packed, before) in enumerate(self.planes):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & below)
            at = np.where(value >> (self.levels - 1 - nth) & 1, self.zeros[nth] + ones, at - ones)
        return at

    def rank(self, value: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each value occurs among the first ``upto``."""
        return self.descend(value, upto) - self.begin[value]


class Index:
    """FM-index of a sequence of numbers from 1 to ``top``; 0 separates what must not match across."""

    def __init__(self, text: np.ndarray, top: int, depth: int):
        text = np.append(text, 0)
        self.order = suffix_array(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.last = Wavelet(text[self.order - 1], max(1, int(top).bit_length()))

    def intervals(self, text: np.ndarray, starts: np.ndarray, size: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows ``text[start : start + size]``, by backward search from their last word.

        A window that occurs fewer than ``least`` times is given up as soon as that is known; its interval is empty.
        """
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        live, top, end = np.arange(len(starts)), low, high + len(self.order)
        for back in range(size - 1, -1, -1):
            word = text[starts[live] + back]
            top = self.first[word] + self.last.rank(word, top)
            end = self.first[word] + self.last.rank(word, end)
            often = end - top >= least
            live, top, end = live[often], top[often], end[often]
        low[live], high[live] = top, end
        return low, high


def earliest(index: Index, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest text position in each interval; equal windows have equal intervals, others disjoint ones."""
    start, inverse = np.unique(low, return_inverse=True)
    end = np.zeros(len(start), np.int64)
    end[inverse] = high
    edges = np.stack([start, np.minimum(end, len(index.order) - 1)], axis=1).ravel()
    least = np.minimum.reduceat(index.order, edges)[::2]
    least = np.where(end == len(index.order), np.minimum(least, index.order[-1]), least)
    return least[inverse]


def word_hashes(text: bytes | None, known: WordHashes) -> np.ndarray:
    parts = []
    for ws in word_lists(text):
        if len(known) > WORDS_HELD:
            known.clear()
        parts.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def inverse_of(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


@lru_cache(maxsize=8)
def powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def segments(hashes: list[np.ndarray], size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """``(document, anchor, digest, start, windows)`` of the segments of some documents' word hashes.

    Documents are handled together up to ``TOGETHER`` words, longer ones by pieces of ``PIECE`` windows.
    """
    parts, held, words = [], [], 0
    for nth, h in enumerate(hashes):
        if held and words + len(h) > TOGETHER:
            parts.append(segments_of([hashes[d] for d in held], np.array(held), 0, size, anchor))
            held, words = [], 0
        if len(h) > TOGETHER:
            for at in range(0, len(h) - size + 1, PIECE):
                parts.append(segments_of([h[at : at + PIECE + size - 1]], np.array([nth]), at, size, anchor))
        elif len(h) >= size:
            held.append(nth)
            words += len(h)
    if held:
        parts.append(segments_of([hashes[d] for d in held], np.array(held), 0, size, anchor))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def segments_of(hashes: list[np.ndarray], names: np.ndarray, offset: int, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """As ``segments``, of documents with a window at least, one after another; no window lies in two."""
    h, lengths = np.concatenate(hashes), np.array([len(x) for x in hashes])
    first = np.cumsum(lengths) - lengths
    n = len(h) - anchor + 1
    key = np.full(n, 1, np.uint64)
    for i in range(anchor):
        key = mix(key * np.uint64(ODD[0]) ^ h[i : n + i])
    place_bits = np.uint64((1 << 20) - 1)
    best = (key & ~place_bits) | np.arange(n, dtype=np.uint64)
    width, span = size - anchor + 1, 1
    while span < width:  # minima over windows of doubling width
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    place = (best & place_bits).astype(np.int64)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    new[first] = True
    beyond = first + lengths - size + 1  # windows from here on run into the next document
    new[beyond[:-1]] = True
    start = np.flatnonzero(new)
    windows = np.diff(np.append(start, len(place)))
    owner = np.searchsorted(first, start, side="right") - 1
    inside = start < beyond[owner]
    start, windows, owner = start[inside], windows[inside], owner[inside]
    end = start + windows + size - 1
    digest = np.zeros(len(start), np.uint64)
    bits = max(16, len(h).bit_length())
    for base, word in zip(ODD, (h, mix(h))):
        total = np.concatenate([[np.uint64(0)], np.cumsum(word * powers(base, bits)[: len(h)], dtype=np.uint64)])
        digest = mix(digest ^ (total[end] - total[start]) * powers(inverse_of(base), bits)[start])
    digest ^= windows.astype(np.uint64)
    anchors = mix(key[place[start]]).view(np.int64)
    return names[owner], anchors, digest.view(np.int64), start - first[owner] + offset, windows


SEGMENT = T.StructType(
    [
        T.StructField("anchor", T.LongType()),
        T.StructField("digest", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("body", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("windows", T.IntegerType()),
        T.StructField("later", T.BooleanType()),
    ]
)


def find_segments(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    """Segments of ``docs(id, body, text)``.

    A task compares the segments of the documents it has at hand: a copy of one with
    a smaller start is marked ``later`` and dealt by its own place, so that many
    copies of a passage do not all travel to one task.
    """

    def work(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                hashes = [word_hashes(t, known) for t in rows.column(2).cast(pa.binary()).to_pylist()]
                owner, key, digest, start, windows = segments(hashes, size, anchor)
                del hashes
                if not len(owner):
                    continue
                ids, body = rows.column(0), rows.column(1).to_numpy(zero_copy_only=False)
                plain, known_id = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
                rank = np.lexsort((np.arange(rows.num_rows), body, plain, known_id))  # NULL is the smallest id
                place = np.empty_like(rank)
                place[rank] = np.arange(len(rank))
                same = (plain[rank], body[rank], known_id[rank])
                fresh = np.ones(len(rank), bool)  # rows that repeat an id and a text share their place
                fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in same])
                place = (np.cumsum(fresh) - 1)[place]
                order = np.lexsort((start, place[owner], digest, key))
                new = np.ones(len(order), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (digest[order][1:] != digest[order][:-1])
                lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                later = np.empty(len(order), bool)
                later[order] = (place[owner[order]] != place[owner[lead]]) | (start[order] != start[lead])
                spread = mix(digest.view(np.uint64) ^ mix(start.astype(np.uint64) + (owner.astype(np.uint64) << np.uint64(32))) ^ body[owner].astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(later, spread.view(np.int64), key)),
                        pa.array(digest),
                        ids.take(pa.array(owner)),
                        pa.array(body[owner]),
                        pa.array(start),
                        pa.array(windows.astype(np.int32)),
                        pa.array(later),
                    ],
                    SEGMENT.names,
                )

    return docs.mapInArrow(work, SEGMENT)


def marked(found: DataFrame) -> DataFrame:
    """Segments that are ``later`` copies, and first ones that share their anchor with others."""
    at = F.struct("id", "body", "start")
    same = Window.partitionBy("anchor", "digest")
    rows = found.repartition("anchor").withColumn("first", F.min(F.when(~F.col("later"), at)).over(same))
    rows = rows.withColumn("later", F.col("later") | (at > F.col("first"))).drop("first")
    # each distinct segment counts once, though rows that repeat an id and a text have it twice
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy("later", "id", "body", "start")))
    distinct = F.sum(F.when((F.col("nth") == 1) & ~F.col("later"), 1).otherwise(0)).over(Window.partitionBy("anchor"))
    rows = rows.withColumn("distinct", distinct)
    return rows.where(F.col("later") | ((F.col("nth") == 1) & (F.col("distinct") > 1))).drop("nth", "digest")


INTERVAL = T.StructType(SEGMENT.fields[2:5] + [T.StructField("stop", T.LongType())])


def shard_repeats(marks: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``(id, body, start, stop)``: words of the segments of shared anchors that are in a repeated window."""
    shared = marks.where(~F.col("later"))
    wanted = shared.groupBy(F.col("id").alias("of_id"), F.col("body").alias("of_body")).agg(
        F.collect_list(F.struct("anchor", "distinct", "start", "windows")).alias("segments")
    )
    held = docs.join(wanted, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("body") == F.col("of_body")))
    parts = F.ceil(F.col("distinct") / PART_SEGMENTS).cast("int")
    fields = [*SEGMENT.fields[:1], T.StructField("distinct", T.LongType()), *SEGMENT.fields[2:6], T.StructField("words", T.BinaryType())]

    def cut(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(batch.num_rows):
                name, body, text, wanted = (batch.column(i)[at].as_py() for i in range(4))
                h = word_hashes(text.encode(), known)
                rows = [(w["anchor"], w["distinct"], name, body, w["start"], w["windows"], h[w["start"] : w["start"] + w["windows"] + size - 1].tobytes()) for w in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                    [f.name for f in fields],
                )

    rows = held.select("id", "body", "text", "segments").mapInArrow(cut, T.StructType(fields))
    own = F.pmod(F.xxhash64("id", "body", "start"), parts).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    keys = ["anchor", "i", "j"]
    tasks = dealt.select(*keys, "id", "body", "start", "windows", "words").repartition(*keys)
    tasks = tasks.sortWithinPartitions(*keys, "id", "body", "start")

    def search(batches):
        for shard in shards(batches):
            yield from repeats(shard, size)

    return tasks.mapInArrow(search, INTERVAL)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Whole ``(anchor, i, j)`` groups of sorted rows, several small ones together."""
    held: dict[str, list] | None = None
    words, last = 0, None
    for batch in batches:
        columns = batch.to_pydict()
        keys = list(zip(columns["anchor"], columns["i"], columns["j"]))
        sizes = [len(w) // 8 for w in columns["words"]]
        begin = 0
        for at, key in enumerate(keys):
            if key != last and words >= SHARD_WORDS:
                for name in held:
                    held[name] += columns[name][begin:at]
                yield held
                held, words, begin = None, 0, at
            if held is None:
                held = {name: [] for name in columns}
            words += sizes[at]
            last = key
        if held is not None:
            for name in held:
                held[name] += columns[name][begin:]
    if held is not None and held["words"]:
        yield held


def repeats(shard: dict[str, list], size: int) -> Iterator[pa.RecordBatch]:
    """Intervals of words in windows that start earlier in the shard as well."""
    place = {k: i for i, k in enumerate(sorted({(d is not None, d or 0, b, s) for d, b, s in zip(shard["id"], shard["body"], shard["start"])}))}
    spot = np.array([place[(d is not None, d or 0, b, s)] for d, b, s in zip(shard["id"], shard["body"], shard["start"])])
    order = np.argsort(spot, kind="stable")
    order = order[np.concatenate([[True], spot[order][1:] != spot[order][:-1]])]  # a segment of two groups once
    words = [np.frombuffer(shard["words"][i], np.uint64) for i in order]
    lengths = np.array([len(w) for w in words])
    unique, number = np.unique(np.concatenate(words), return_inverse=True)
    first = np.cumsum(lengths + 1) - lengths - 1  # a 0 after every segment
    text = np.zeros(int(lengths.sum() + len(lengths)), np.int64)
    text[np.arange(len(number)) + np.repeat(np.arange(len(words)), lengths)] = number + 1
    index = Index(text, len(unique), size)
    windows = lengths - size + 1
    owner = np.repeat(np.arange(len(words)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    low, high = index.intervals(text, first[owner] + within, size, least=2)
    often = np.flatnonzero(high > low)
    if not len(often):
        return
    seen = earliest(index, low[often], high[often])
    # the earliest place in the index need not be the earliest in the collection: segments of
    # one document may overlap, so places are compared as (document, word)
    holder, own = np.searchsorted(first, seen, side="right") - 1, owner[often]
    ids = [(shard["id"][i], shard["body"][i]) for i in order]
    numbers: dict[tuple, int] = {}
    doc = np.array([numbers.setdefault(i, len(numbers)) for i in ids])
    starts = np.array([shard["start"][i] for i in order])
    other, mine = starts[holder] + seen - first[holder], starts[own] + within[often]
    repeated = (doc[holder] != doc[own]) | (other < mine)
    hit, mine = often[repeated], mine[repeated]
    if not len(hit):
        return
    run = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (owner[hit][1:] != owner[hit][:-1])]))
    stop = np.append(run[1:], len(hit)) - 1
    rows = owner[hit[run]]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([ids[r][0] for r in rows], pa.int64()),
            pa.array([ids[r][1] for r in rows], pa.int64()),
            pa.array(mine[run]),
            pa.array(mine[stop] + size),
        ],
        INTERVAL.names,
    )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the words of repeated windows cut out; the others are joined by one space.

    Words are stretches without ASCII white space, unchanged.  A window of ``window``
    words repeats if its words also start in a document with a smaller id (NULL is the
    smallest), or, with the same id, in a text with a smaller hash, or earlier in the same
    text; windows are judged on the input.  Rows that repeat id and text are one
    document and keep the same words.  Adds ``n_words`` and ``n_removed`` (columns of
    these names are replaced).  A NULL text has no words and becomes the empty text.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor must fit into a window")
    rest = without(docs, RESULTS)
    keyed = rest.select(
        F.struct(*[rest[f"`{c}`"] for c in rest.columns]).alias("row"),
        rest[f"`{id_col}`"].cast("long").alias("id"),
        F.xxhash64(rest[f"`{text_col}`"]).alias("body"),
    )
    slim = docs.select(
        docs[f"`{id_col}`"].cast("long").alias("id"), F.xxhash64(docs[f"`{text_col}`"]).alias("body"), docs[f"`{text_col}`"].alias("text")
    ).where(F.col("text").isNotNull())
    marks = stored(marked(find_segments(slim, window, anchor)), "segments")
    whole = marks.where("later").select("id", "body", "start", (F.col("start") + F.col("windows") + (window - 1)).alias("stop"))
    cuts = whole.unionByName(shard_repeats(marks, slim, window)).groupBy(
        F.col("id").alias("cut_id"), F.col("body").alias("cut_body")
    ).agg(F.collect_set(F.struct("start", "stop")).alias("cuts"))
    joined = keyed.join(cuts, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("body") == F.col("cut_body")), "left")
    new = [T.StructField("kept", T.StringType())] + [T.StructField(n, T.LongType()) for n in RESULTS]

    def work(slices):
        for batch in slices:
            texts = batch.column(1).cast(pa.binary())
            rows = [kept_words(texts[i].as_py(), batch.column(2)[i].as_py()) for i in range(batch.num_rows)]
            yield [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))]

    others = [c for c in rest.columns if c != text_col]
    filler = "_" * (1 + max(map(len, rest.columns)))  # no column's name; a struct needs a field
    out = add_columns(
        joined.select(F.struct(F.lit(0).alias(filler), *[F.col("row")[c].alias(c) for c in others]).alias("row"), F.col("row")[text_col].alias("text"), "cuts"),
        new, work, leave_out=("text", "cuts"), slice_bytes=SLICE_BYTES,
    )
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in rest.columns], *RESULTS)


def kept_words(text: bytes | None, cuts: list[dict] | None) -> tuple[str, int, int]:
    """The words that no cut covers, how many words there are, and how many are covered."""
    edges = sorted((c["start"], c["stop"]) for c in cuts or ())
    out, n, removed, at = [], 0, 0, 0
    for ws in word_lists(text):
        first, last, keep = n, n + len(ws), n
        n = last
        while at < len(edges) and edges[at][0] < last:
            start, stop = edges[at]
            if start > keep:
                out += ws[keep - first : start - first]
            removed += max(0, min(stop, last) - max(start, keep))
            keep = max(keep, min(stop, last))
            if stop > last:
                break  # the cut goes on in the next list
            at += 1
        out += ws[keep - first :]
    return b" ".join(out).decode(), n, removed
