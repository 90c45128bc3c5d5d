"""Benchmark decontamination with suffix arrays over the training text.

Every task cuts its documents into shards of bounded size and sorts the suffixes of
each shard.  The suffixes of all benchmark items are then binary-searched in the
shard, all at once and word by word: the interval of suffixes that begin with a
window gives all its occurrences, and narrowing it until nothing is left gives the
longest verbatim match.  Nothing is shuffled; a document is judged where it is read.

The benchmark is the stated query set.  It is read partition by partition and sent
to the tasks in blocks of at most ``BLOCK_WORDS`` words; with several blocks, the
documents pass one block after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import add_columns, without

WINDOW = 13
MIN_SHARE = 20  # hit words times this must reach the number of words
BLOCK_WORDS = 4_000_000
SHARD_WORDS = 1 << 20
CUT_BYTES = 4 << 20  # a long text is split into words by pieces of this size

# A-Z become a-z; digits, a-z and all bytes of non-ASCII characters are word characters.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_start", T.LongType()),
        T.StructField("doc_start", T.LongType()),
        T.StructField("n_words", T.LongType()),
    ]
)


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Items(NamedTuple):
    """A block of benchmark items as word numbers; number 0 is no word of an item."""

    vocabulary: dict[bytes, int]
    words: np.ndarray  # of all items, each followed by a 0
    start: np.ndarray  # per searched suffix: where it begins in ``words``
    place: np.ndarray  # ... and in its item
    room: np.ndarray  # ... words up to the end of its item
    size: np.ndarray  # ... words of its window
    item: np.ndarray  # ... number of its item
    ids: list[str]


def prepare(items: list[tuple[str, list[bytes]]], window: int) -> Items:
    vocabulary: dict[bytes, int] = {}
    parts, start, place, room, size, item = [], [], [], [], [], []
    at = 0
    for number, (_, ws) in enumerate(items):
        width = min(window, len(ws))
        first = np.arange(len(ws) - width + 1)
        parts.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws] + [0], np.int32))
        start.append(first + at)
        place.append(first)
        room.append(len(ws) - first)
        size.append(np.full(len(first), width))
        item.append(np.full(len(first), number))
        at += len(ws) + 1
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (start, place, room, size, item)]
    text = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return Items(vocabulary, text, *columns, [i for i, _ in items])


def item_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[Items]:
    block, held = [], 0
    rows = benchmark.select(benchmark[f"`{id_col}`"].cast("string"), benchmark[f"`{text_col}`"])
    for item_id, text in rows.toLocalIterator():
        ws = words((text or "").encode())
        if not ws or item_id is None:
            continue
        if block and held + len(ws) > BLOCK_WORDS:
            yield prepare(block, window)
            block, held = [], 0
        block.append((item_id, ws))
        held += len(ws)
    if block:
        yield prepare(block, window)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``depth`` words, by prefix doubling."""
    rank = text.astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth:
        key = rank * (int(rank.max(initial=0)) + 1)
        key[:-width] += rank[width:]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))
        rank = np.empty_like(fresh)
        rank[order] = np.cumsum(fresh)
        width *= 2
        if len(fresh) == 0 or rank[order[-1]] == len(text) - 1:
            break
    return order


def bisect(text, order, low, high, depth, word, after: bool) -> np.ndarray:
    """First index in [low, high) whose suffix has at ``depth`` a word >= ``word`` (> if ``after``)."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        at = order[middle] + depth
        there = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], 0)
        right = there <= word[open_] if after else there < word[open_]
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


def search(text: np.ndarray, order: np.ndarray, items: Items):
    """Per benchmark suffix: interval of its window, length of its longest match, interval of that."""
    n = len(items.start)
    low, high = np.zeros(n, np.int64), np.full(n, len(text), np.int64)
    window_low, window_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest = np.zeros(n, np.int64)
    active, depth = np.arange(n), 0
    while len(active):
        word = items.words[items.start[active] + depth]
        left = bisect(text, order, low[active], high[active], depth, word, after=False)
        right = bisect(text, order, left, high[active], depth, word, after=True)
        found = left < right
        active = active[found]
        low[active], high[active] = left[found], right[found]
        depth += 1
        longest[active] = depth
        whole = active[items.size[active] == depth]
        window_low[whole], window_high[whole] = low[whole], high[whole]
        active = active[items.room[active] > depth]
    return window_low, window_high, longest, low, high


def spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indexes of the intervals one after another, and the interval each belongs to."""
    count = high - low
    owner = np.repeat(np.arange(len(low)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return low[owner] + within, owner


def runs_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def count_words(text: bytes) -> int:
    """Number of words: starts of runs of word bytes."""
    flags = np.frombuffer(text.translate(FOLD), np.uint8) != 0x20
    return int(np.count_nonzero(flags[1:] & ~flags[:-1]) + flags[:1].sum())


def numbers(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers, in pieces, so that the list of words stays short."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + CUT_BYTES)
        while end < len(text) and FOLD[text[end]] != 0x20:  # not inside a word
            end += 1
        ws = words(text[at:end])
        parts.append(np.fromiter(map(vocabulary.get, ws, repeat(0)), np.int32, len(ws)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def shards(text: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(words, positions)`` of shards: the runs of benchmark words that can hold a window.

    A run shorter than the shortest window holds no occurrence.  A run longer than a
    shard is cut into pieces that overlap by the longest item.
    """
    known = np.concatenate(([False], text > 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    pieces, held = [], 0
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if end - start < shortest:
            continue
        for at in range(start, max(start + 1, end - longest + 1), SHARD_WORDS):
            stop = min(end, at + SHARD_WORDS + longest - 1)
            if held and held + stop - at > SHARD_WORDS:
                yield joined(text, pieces)
                pieces, held = [], 0
            pieces.append((at, stop))
            held += stop - at
    if pieces:
        yield joined(text, pieces)


def joined(text: np.ndarray, pieces: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([np.append(np.arange(a, b), -1) for a, b in pieces])
    return np.where(at >= 0, text[at], 0), at


class Findings:
    """What one block of items has in a slice of documents."""

    def __init__(self, texts: list[bytes | None], items: Items, locate: bool):
        docs = [numbers(t or b"", items.vocabulary) for t in texts]
        self.n_words = np.array([len(d) for d in docs], np.int64)
        self.first = np.cumsum(self.n_words + 1) - self.n_words - 1  # a 0 after every document
        text = np.concatenate([np.append(d, 0) for d in docs]) if docs else np.zeros(0, np.int32)
        self.cover = np.zeros(len(text) + 1, np.int64)
        self.pairs: set[tuple[int, int]] = set()  # document, item
        self.matches: list[np.ndarray] = []
        if len(items.size):
            for words_, at in shards(text, int(items.size.min()), int(items.room.max())):
                self.take(words_, at, text, items, locate)
        self.cover = np.cumsum(self.cover)[:-1] > 0

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def take(self, shard, at, text, items: Items, locate: bool) -> None:
        order = suffix_array(shard, int(items.room.max()))
        low, high, longest, longest_low, longest_high = search(shard, order, items)
        # equal windows of different items have equal intervals: occurrences are listed once;
        # a shorter window can begin where a longer one does, so the size counts too
        found = np.flatnonzero(high > low)
        window, group = np.unique(low[found] * (int(items.size.max()) + 1) + items.size[found], return_inverse=True)
        pick = np.zeros(len(window), np.int64)
        pick[group] = found
        index, owner = spans(low[pick], high[pick])
        where, size = at[order[index]], items.size[pick][owner]
        np.add.at(self.cover, where, 1)
        np.add.at(self.cover, where + size, -1)
        hits = np.unique(self.document(where) * (len(window) + 1) + owner)
        by_group = np.argsort(group, kind="stable")
        begin = np.searchsorted(group[by_group], np.arange(len(window) + 1))
        doc, number = hits // (len(window) + 1), hits % (len(window) + 1)
        index, owner = spans(begin[number], begin[number + 1])
        self.pairs.update(zip(doc[owner].tolist(), items.item[found[by_group[index]]].tolist()))
        if locate and len(found):
            index, owner = spans(longest_low[found], longest_high[found])
            suffix, where = found[owner], at[order[index]]
            before_doc = np.where(where > 0, text[where - 1], 0)
            before_item = np.where(items.place[suffix] > 0, items.words[items.start[suffix] - 1], 0)
            maximal = (before_doc != before_item) | (before_item == 0)
            self.matches.append(np.stack([where, suffix, longest[suffix]])[:, maximal])


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def judge(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_share: int = MIN_SHARE,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with what they share with the benchmark.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items``
    (items with an occurring window), ``items_sha256`` (of their ids, sorted as strings
    and joined by commas) and ``contaminated`` (there are hits, and they make up at
    least one word in ``min_share``); columns of these names are replaced.  An item
    shorter than a window is one window.  A NULL or empty text has no words; items
    without words or without an id match nothing; items that share an id count as
    one.  With an empty benchmark nothing is hit.  ``keep_text=False`` leaves the text out
    of the result.
    """
    state = [
        T.StructField("__cover_of_item_blocks", T.BinaryType()),
        T.StructField("__items_of_item_blocks", T.ArrayType(T.StringType())),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
    ]
    old = ["__cover_before_item_block", "__items_before_item_block"]
    seen = without(docs, RESULTS).select(
        "*", F.lit(None).cast("binary").alias("__cover_of_item_blocks"), F.array().cast("array<string>").alias("__items_of_item_blocks")
    )
    blocks = item_blocks(benchmark, window, item_id_col, item_text_col)
    items, later = next(blocks, prepare([], window)), True
    while later:
        later = next(blocks, None)
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def mark(slices, sent=sent):
            for batch in slices:
                column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                found = Findings(texts_of(column[text_col]), sent.value, False)
                names = [set(x) for x in column["__items_before_item_block"].to_pylist()]
                for doc, item in found.pairs:
                    names[doc].add(sent.value.ids[item])
                cover, n_hit = [], []
                before = column["__cover_before_item_block"].to_pylist()
                for first, n, known in zip(found.first.tolist(), found.n_words.tolist(), before):
                    bits = found.cover[first : first + n]
                    if known is not None:
                        bits = bits | np.unpackbits(np.frombuffer(known, np.uint8), count=n).astype(bool)
                    n_hit.append(int(bits.sum()))
                    cover.append(np.packbits(bits).tobytes() if n_hit[-1] else None)
                yield [
                    pa.array(cover, pa.binary()),
                    pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                    pa.array(found.n_words),
                    pa.array(n_hit, pa.int64()),
                ]

        before = seen.withColumnsRenamed({"__cover_of_item_blocks": old[0], "__items_of_item_blocks": old[1]})
        unread = () if keep_text or later else (text_col,)
        seen = add_columns(before, state, mark, leave_out=(*old, *unread))
        items = later
    return seen.select(
        *[seen[f"`{c}`"] for c in seen.columns if c not in ("__cover_of_item_blocks", "__items_of_item_blocks")],
        F.size("__items_of_item_blocks").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items_of_item_blocks", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated (see ``judge``), with their own columns."""
    text = docs[f"`{options.pop('text_col', 'text')}`"]
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), text.alias("text"))
    return judge(whole, benchmark, keep_text=False, **options).where(~F.col("contaminated")).select("row.*")


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id, item_id, item_start, doc_start, n_words)``: the longest verbatim matches and where they are.

    One row per place where a benchmark suffix has its longest match in a shard, of
    at least a window, unless the match goes on to the left.  Positions count words.
    """
    found = None
    for items in item_blocks(benchmark, window, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def locate(slices, sent=sent):
            for batch in slices:
                found = Findings(texts_of(batch.column(1)), sent.value, True)
                rows: list[list] = [[] for _ in range(batch.num_rows)]
                for part in found.matches:
                    for where, suffix, n in part.T.tolist():
                        doc = int(found.document(np.array([where]))[0])
                        rows[doc].append(
                            (sent.value.ids[sent.value.item[suffix]], int(sent.value.place[suffix]), where - int(found.first[doc]), n)
                        )
                names = [f.name for f in MATCH]
                yield [
                    pa.array(
                        [[dict(zip(names, m)) for m in sorted(set(r))] for r in rows],
                        pa.list_(pa.struct([("item_id", pa.string()), *[(n, pa.int64()) for n in names[1:]]])),
                    )
                ]

        slim = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
        part = add_columns(slim, [T.StructField("match", T.ArrayType(MATCH))], locate)
        part = part.select("id", F.inline("match"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = docs.select(docs[f"`{id_col}`"].alias("id")).where(F.lit(False))
        found = empty.select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in MATCH])
    return found.select(F.col("id").alias(id_col), *[f.name for f in MATCH])
