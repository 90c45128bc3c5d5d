"""Jaccard self-join of documents on word n-grams, as a blocked sparse matrix product.

The incidence matrix has a row for each distinct set of n-grams (documents with the same
set are one row) and a column for each n-gram.  Its product with its own transpose holds
the overlaps of all pairs; what sizes alone rule out is never multiplied:

* Rows first meet on a few columns.  The n-grams have one global order, frequent ones
  last; of two sets that are similar enough, the first ``size - least overlap + 1`` n-grams
  of either have one in common.  Only these columns are dealt out, and of the smaller set
  about half of them are enough.
* The rows that share a column are brought together with the column's first row, which
  makes blocks of rows; a column is cut where the sizes of its rows leave a gap.  The larger the table, the more rows
  meet by chance: first only a parity sketch of their sets is dealt, whose bits differ in no more places than
  the sets, and a row that differs too much from all others of a block leaves it.  Inside a block the product over the first columns
  is accumulated, and a pair whose overlap there is below what the sizes demand is
  discarded.  This is exact: no pair that is similar enough is lost.
* What is left forms clusters, and inside a cluster the product over all columns decides.
  It is accumulated by blocks of columns too, and a pair is given up as soon as its
  overlap so far and the columns still to come cannot reach the limit.

Blocks are of bounded size.  A block emits a spanning forest of its pairs, never the pairs
themselves; in a block that has to be split, every part holds its first row, and only
rows that are not connected with it meet the other parts.  The order of the n-grams comes
from a bounded sample of documents; it decides how much work there is, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import add_columns, discard, shuffles_deleted, stored
from passagework.llm.odd_sketch import LINKS, WordHashes, components, groups, name_of, shingle_set, stars

WORDS = 5  # words of an n-gram
PERCENT = 80  # least similarity
SAMPLE_DOCS = 4_000  # documents that tell which n-grams are frequent ...
SAMPLE_SEEN = 4  # ... if so many different ones of them hold it
FREQUENT = 200_000  # n-grams that are told apart as frequent, at most
BLOCK = 1024  # rows that are multiplied at once ...
BLOCK_ENTRIES = 2_000_000  # ... and n-grams of their sets
COLUMNS = 4096  # columns of a dense block
SPARSE_PAIRS = 64  # a column of fewer pairs is multiplied entry by entry
EXPANDED = 4_000_000  # pairs of entries held at once
SLICE_BYTES = 8 << 20
SKETCHED = 4096  # rows of a block whose sketches are compared, at most
SKETCH_PAIRS = 200_000  # pairs of sketches held at once
SENT_ROWS = 500_000  # rows of a table that is sent to every task, at most

PAIR = T.StructType([T.StructField("pivot", T.BinaryType()), T.StructField("node", T.BinaryType())])
ENTRY = T.StructType([T.StructField("column", T.LongType()), T.StructField("key", T.LongType()), T.StructField("node", T.BinaryType())])


# ---- the product inside a block -----------------------------------------------------


def least_overlap(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Overlap that sets of these sizes need; more than either has, where sizes alone rule a pair out."""
    both = left[:, None] + right[None, :]
    need = -(-percent * both // (100 + percent))
    smaller, larger = np.minimum(left[:, None], right[None, :]), np.maximum(left[:, None], right[None, :])
    return np.where(100 * smaller >= percent * larger, need, larger + 1)


def similar(left: list[np.ndarray], right: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Which pairs of a left and a right row have ``need`` columns in common.

    Columns that stand on one side only count for nothing and are left out.  The others
    are multiplied block by block: those with few pairs entry by entry, the others as
    dense matrices; rows without a pair that can still reach its need drop out.
    """
    n, m = len(left), len(right)
    row = np.repeat(np.arange(n + m), [len(x) for x in left + right])
    _, column = np.unique(np.concatenate(left + right), return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    on_left = row < n
    times = [np.bincount(column[side], minlength=width) for side in (on_left, ~on_left)]
    pairs = times[0] * times[1]
    total = np.zeros((n, m), np.float32)
    few = (pairs > 0) & (pairs <= SPARSE_PAIRS)
    add_sparse(total, row, column, few, n, times[1])
    dense = np.flatnonzero(pairs > SPARSE_PAIRS)
    place = np.full(width, -1)
    place[dense[np.argsort(-pairs[dense], kind="stable")]] = np.arange(len(dense))
    at = place[column]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    rest = np.bincount(row, minlength=n + m)
    for start in range(0, len(dense), COLUMNS):
        open_ = total + np.minimum(rest[:n, None], rest[None, n:]) >= need
        own, other = open_.any(axis=1), open_.any(axis=0)
        if not own.any():
            break
        first, last = np.searchsorted(at, [start, start + COLUMNS])
        has = np.zeros((n + m, min(COLUMNS, len(dense) - start)), np.float32)
        has[row[first:last], at[first:last] - start] = 1
        total[np.ix_(own, other)] += has[:n][own] @ has[n:][other].T
        rest -= np.bincount(row[first:last], minlength=n + m)
    return total >= need


def add_sparse(total: np.ndarray, row: np.ndarray, column: np.ndarray, wanted: np.ndarray, n: int, times: np.ndarray) -> None:
    """Add the products of the ``wanted`` columns, each pair of entries by itself."""
    inside = wanted[column]
    row, column = row[inside], column[inside]
    order = np.lexsort((row, column))
    row, column = row[order], column[order]
    is_left = row < n
    right, right_column = row[~is_left] - n, column[~is_left]
    start = np.searchsorted(right_column, column[is_left])
    count = times[column[is_left]]
    left = row[is_left]
    ends = np.cumsum(count)
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
        some = count[at:stop]
        step = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
        cell = np.repeat(left[at:stop], some) * total.shape[1] + right[np.repeat(start[at:stop], some) + step]
        total += np.bincount(cell, minlength=total.size).reshape(total.shape)
        at = stop


def prefix_need(left: list[tuple], right: list[tuple], percent: int) -> np.ndarray:
    """Overlap that the first columns of rows ``(size, n_cold, columns)`` must have.

    The row whose first columns end earlier, in the order of all columns, has all common
    ones among them: it may miss no more of them than its size allows.  Where the shortened
    hashes do not tell which one that is, the lower need holds.
    """
    rows = left + right
    size, length = np.array([r[0] for r in rows]), np.array([len(r[2]) for r in rows])
    end = np.array([int(r[2][-1]) for r in rows], np.int64)
    end[[r[1] < len(r[2]) for r in rows]] += 1 << 32  # frequent columns come last
    n = len(left)
    all_need = least_overlap(size[:n], size[n:], percent)
    slack = size - length
    first, second = end[:n, None], end[None, n:]
    own = np.where(first < second, slack[:n, None], np.where(first > second, slack[None, n:], np.maximum(slack[:n, None], slack[None, n:])))
    return np.where(all_need > np.maximum(size[:n, None], size[None, n:]), all_need, np.maximum(1, all_need - own))


# ---- rows and their first columns ---------------------------------------------------


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def index_length(size: np.ndarray, percent: int) -> np.ndarray:
    """First columns of a set that it needs to meet all sets of its size and larger ones."""
    return size - -(-2 * percent * size // (100 + percent)) + 1


def frequent_ngrams(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of n-grams that several different sets of a sample hold.

    The sample has about ``SAMPLE_DOCS`` documents whatever there is, and at most
    ``FREQUENT`` hashes come back.  They only say which columns are put last.
    """
    n = docs.count()
    sample = docs.sample(min(1.0, SAMPLE_DOCS / n), seed=7) if n > SAMPLE_DOCS else docs
    held = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("held", T.BinaryType())])

    def sets(batches):
        known = WordHashes()
        for batch in batches:
            own = [shingle_set(t, size, known) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name_of(s) for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], held.names
            )

    def entries(batches):
        for batch in batches:
            for one in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(one, np.int64))], ["column"])

    different = sample.select("text").mapInArrow(sets, held).where("node IS NOT NULL").dropDuplicates(["node"])
    counted = different.mapInArrow(entries, "column long").groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    most = counted.where(F.col("n") >= SAMPLE_SEEN).orderBy(F.desc("n"), "column").limit(FREQUENT).toArrow()
    return np.sort(most["column"].to_numpy().astype(np.int64).view(np.uint64))


def incidence(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``docs`` without its text and with ``n_shingles, node, n_cold, first, sketch``.

    ``node`` names the set, ``first`` holds its first columns: rare n-grams by hash, then
    frequent ones; ``n_cold`` of them are rare.  ``sketch`` is the :func:`parity_sketch`.  All but ``n_shingles`` are
    NULL for an empty set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    new = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("n_cold", T.LongType()),
        T.StructField("first", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()),
    ]

    def work(slices):
        known, hot = WordHashes(), shared.value
        for batch in slices:
            counts, names, colds, firsts, sketches = [], [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist():
                own = shingle_set(text, size, known)
                counts.append(len(own))
                names.append(name_of(own))
                if not len(own):
                    colds.append(None)
                    firsts.append(None)
                    sketches.append(None)
                    continue
                length = prefix_length(len(own), percent)
                at = np.searchsorted(hot, own)
                is_hot = hot[np.minimum(at, len(hot) - 1)] == own if len(hot) else np.zeros(len(own), bool)
                first = np.concatenate([own[~is_hot][:length], own[is_hot][: max(0, length - int((~is_hot).sum()))]])
                colds.append(min(length, int((~is_hot).sum())))
                firsts.append(first.tobytes())
                sketches.append(parity_sketch(own).tobytes())
            yield [pa.array(c, f) for c, f in zip((counts, names, colds, firsts, sketches), (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()))]

    return add_columns(docs, new, work, leave_out=("text",), slice_bytes=SLICE_BYTES)


def blocks_of(classes: DataFrame, percent: int) -> DataFrame:
    """``(pivot, node)``: each row with the first row of every run of its columns.

    Of two similar sets the smaller one has a common column among the first
    :func:`index_length` ones.  The entries of a rare column are sorted by size, these before the
    others, and read one by one, holding nothing but the current pivot; an entry that no
    such entry of a similar size precedes starts a new run, or is left out if it is not one
    itself.  The frequent columns, of which a single one may be in most rows, are not brought
    together: their first rows are found by a pre-aggregated minimum and sent to the rows.
    """

    def explode(hot: bool):
        def run(batches):
            for batch in batches:
                size = batch.column(1).to_numpy()
                enough = index_length(size, percent)
                columns, owner, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, (cold, first) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    part = np.frombuffer(first, np.int64)[cold:] if hot else np.frombuffer(first, np.int64)[:cold]
                    columns.append(part)
                    owner.append(np.full(len(part), i))
                    place.append(np.arange(len(part)) + (cold if hot else 0))
                at = np.concatenate(owner)
                key = 2 * size[at] + (np.concatenate(place) >= enough[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(columns)), pa.array(key), batch.column(0).take(pa.array(at))], ENTRY.names)

        return run

    def pivots(batches):
        last, before, pivot = 0, -1, None  # column and size of the last entry that runs go by
        for batch in batches:
            if not batch.num_rows:
                continue
            column, key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            size, leads, at = key // 2, key % 2 == 0, np.arange(len(key))
            led = np.r_[-1, np.maximum.accumulate(np.where(leads, at, -1))[:-1]]
            near_column, near_size = np.where(led >= 0, column[led], last), np.where(led >= 0, size[led], before)
            joins = (near_size >= 0) & (near_column == column) & (100 * near_size >= percent * size)
            head = np.maximum.accumulate(np.where(leads & ~joins, at, -1))
            heads = pa.array([pivot], pa.binary()).take(pa.array(np.zeros(len(at), int))) if head[0] < 0 else node
            own = pc.if_else(pa.array(head >= 0), node.take(pa.array(np.maximum(head, 0))), heads)
            found = pa.table([own, node], names=PAIR.names).filter(pa.array(joins))
            if leads.any():
                end = int(np.flatnonzero(leads)[-1])
                last, before = column[end], size[end]
            pivot = own[-1].as_py()
            found = found.filter(pc.not_equal(found["pivot"], found["node"]))
            yield from found.group_by(PAIR.names).aggregate([]).to_batches()

    slim = classes.select("node", "n_shingles", "n_cold", "first")
    rare = slim.mapInArrow(explode(False), ENTRY).repartition("column").sortWithinPartitions("column", "key", "node")
    hot = slim.where(F.col("n_cold") < F.octet_length("first") / 8).mapInArrow(explode(True), ENTRY)
    smallest = hot.where("key % 2 = 0").groupBy("column").agg(F.min("node").alias("pivot"))  # at most FREQUENT rows
    by_hot = hot.join(F.broadcast(smallest), "column").where(F.col("pivot") != F.col("node")).select("pivot", "node")
    return rare.mapInArrow(pivots, PAIR).unionAll(by_hot).distinct()


# ---- rows that meet by chance -------------------------------------------------------


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """Bits, as 64-bit words, that tell of how many n-grams with the same lower bits a set has an odd number.

    Where two sets differ in ``d`` n-grams their sketches differ in ``d`` bits at most.  There is a power of two of them, half as
    many as n-grams at least (64 at least); the halves of a sketch, one over the other, are the sketch of half the bits.
    """
    bits = 1 << max(6, (len(own) - 1).bit_length() - 1)
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def with_partner(block: np.ndarray, size: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Whether a row of sorted ``block`` numbers has another one in its block that may be similar, as sizes and sketches tell."""
    n = np.array([len(s) // 8 for s in sketches])
    words = np.frombuffer(b"".join(sketches), np.uint64)
    start = np.cumsum(n) - n
    # sets that are similar by half have sketches of the same length or of the next one: each is held folded once, too
    half = n // 2
    low = np.repeat(start - (np.cumsum(half) - half), half) + np.arange(int(half.sum()))
    folded = words[low] ^ words[low + np.repeat(half, half)]
    held = np.concatenate([words, folded])
    folded_at = len(words) + np.cumsum(half) - half
    end = np.searchsorted(block, block, "right")
    others = end - np.arange(len(block)) - 1
    before = np.cumsum(others) - others
    out = np.zeros(len(block), bool)
    at = 0
    while at < len(block):
        stop = max(at + 1, int(np.searchsorted(before, before[at] + SKETCH_PAIRS, "right")) - 1)
        some = others[at:stop]
        left = np.repeat(np.arange(at, stop), some)
        right = left + 1 + np.arange(len(left)) - np.repeat(before[at:stop] - before[at], some)
        small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
        near = 100 * small >= percent * large
        left, right, both = left[near], right[near], (small + large)[near]
        allowed = both - 2 * -(-percent * both // (100 + percent))
        shorter = np.minimum(n[left], n[right])
        open_ = np.maximum(n[left], n[right]) > 2 * shorter  # a low limit: not told
        out[left[open_]] = out[right[open_]] = True
        shorter[open_] = 0
        for width in np.unique(shorter[~open_]).tolist():
            own = np.flatnonzero(shorter == width)
            step = max(1, SKETCH_PAIRS // width)
            for first in range(0, len(own), step):
                pair = own[first : first + step]
                sides = [np.where(n[side] == width, start[side], folded_at[side])[:, None] + np.arange(width) for side in (left[pair], right[pair])]
                apart = np.bitwise_count(held[sides[0]] ^ held[sides[1]]).sum(axis=1, dtype=np.int64)
                pair = pair[apart <= allowed[pair]]
                out[left[pair]] = out[right[pair]] = True
        at = stop
    return out


def not_by_chance(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``(pivot, node)`` without the rows that sketches tell to be similar to none of their block.

    Blocks of more than ``SKETCHED`` rows are left as they are.
    """
    large = stored(pairs.groupBy("pivot").count().where(F.col("count") >= SKETCHED).select("pivot"), "large")
    large = F.broadcast(large) if large.count() <= SENT_ROWS else large
    small = pairs.join(large, "pivot", "left_anti")
    whole = small.unionAll(small.select("pivot", F.col("pivot").alias("node")).distinct())
    dealt = whole.join(classes.select("node", "n_shingles", "sketch"), "node").select("pivot", "node", "n_shingles", "sketch")

    def tested(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        block = rows["pivot"].combine_chunks().dictionary_encode().indices.to_numpy()
        partner = with_partner(block, rows["n_shingles"].to_numpy(), rows["sketch"].to_pylist(), percent)
        kept = pc.and_(pa.array(partner), pc.not_equal(rows["pivot"], rows["node"]).combine_chunks())
        yield from rows.select(PAIR.names).filter(kept).to_batches()

    def work(batches):
        rows = None  # the last block so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch])
            rows = batch if rows is None else pa.concat_tables([rows, batch])
            open_ = pc.index(rows["pivot"], rows["pivot"][-1]).as_py()
            if open_:
                yield from tested(rows.slice(0, open_))
                rows = rows.slice(open_)
        if rows is not None:
            yield from tested(rows)

    kept = dealt.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(work, PAIR)
    return kept.unionAll(pairs.join(large, "pivot", "left_semi"))


# ---- blocks of rows -----------------------------------------------------------------


def forest(tasks: DataFrame, read, wanted) -> DataFrame:
    """``(a, b)``: a spanning forest of the similar pairs of each ``(block, i, j)`` of ``tasks``.

    Rows with side 0 are multiplied with those of side 1, or with each other where
    there is no side 1.  ``read`` makes rows of the columns, ``wanted(left, right)`` says
    which pairs are similar.
    """
    dealt = tasks.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")

    def work(batches):
        for _, group in groups(batches, ["block", "i", "j"]):
            rows = read(group)
            names = [[n for (side, n) in rows if side == k] for k in (0, 1)]
            left, right = [[rows[k, n] for n in names[k]] for k in (0, 1)]
            if not right:
                if len(left) > 1:
                    yield from stars(names[0], wanted(left, left))
                continue
            if not left:
                continue
            whole = np.zeros((len(left) + len(right),) * 2, bool)
            whole[: len(left), len(left) :] = wanted(left, right)
            yield from stars(names[0] + names[1], whole | whole.T)

    return dealt.mapInArrow(work, LINKS).distinct()


def linked_blocks(members: DataFrame, sizes: DataFrame, held: list[str], read, wanted, name: str) -> DataFrame:
    """Links that connect what is similar inside each block of ``members(block, node, <held>)``.

    ``block`` is the first of its rows, ``sizes(block, entries)`` has the same rows.  A block that is too large is split into
    parts with that row in each; then rows that are not connected with it meet all parts.
    """
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("entries") / BLOCK_ENTRIES)).cast("int")
    large = stored(sizes.groupBy("block").agg(parts.alias("parts")).where("parts > 1"), "large")
    sized = members.join(F.broadcast(large) if large.count() <= SENT_ROWS else large, "block", "left")
    sized = sized.withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    dealt = stored(sized.withColumn("part", part).select("block", "node", "parts", "part", *held), name)
    first = (F.col("node") == F.col("block")) & (F.col("parts") > 1)
    own = dealt.select(
        "block",
        F.explode(F.when(first, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))).alias("i"),
        F.lit(0).alias("j"), F.lit(0).alias("side"), "node", *held,
    )
    links = stored(forest(own, read, wanted), "links")
    many = dealt.where(F.col("parts") > 1)
    if many.limit(1).count() == 0:
        discard(dealt)
        return links
    labels = components(links)
    root = labels.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
    many = many.join(labels, "node", "left").join(root, F.col("block") == F.col("root"), "left")
    many = many.withColumn("apart", F.coalesce("label", "node") != F.coalesce("root_label", "block"))
    apart = many.where("apart").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rows"))
    many = many.join(apart, "block")
    row = F.pmod(F.xxhash64("node", F.lit(2)), F.col("rows")).cast("int")
    left = many.where("apart").select(
        "block", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), "node", *held
    )
    right = many.select(
        "block", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), "node", *held
    )
    found = stored(links.unionByName(forest(left.unionByName(right), read, wanted)), "links")
    discard(dealt)
    return found


def join_rows(
    docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: every row with the smallest id that links lead to.

    Words are stretches without ASCII white space, A-Z lower-cased; a text of fewer words
    than an n-gram is one n-gram.  Two documents link if 100 times the intersection of
    their sets is at least ``percent`` times the union.  A NULL or empty text has no n-grams
    and links with nothing; neither does a row with a NULL id, whose ``component_id`` is
    NULL.  Rows that repeat an id and a text are alike; rows of one id with different texts
    go each by its own text.  Other columns are ignored, whatever their names.  N-grams are
    told apart by 64-bit hashes, sets by 128 bits; apart from that the result is exact.
    """
    slim = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    slim = slim.withColumn("text_key", F.xxhash64("text"))
    with shuffles_deleted(docs.sparkSession):
        known = stored(incidence(slim, size, percent, frequent_ngrams(slim, size)), "incidence")
        named = known.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        held = ("n_shingles", "n_cold", "first", "sketch")
        classes = named.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), *[F.first(c).alias(c) for c in held])
        entries = (F.octet_length("first") / 8).cast("long").alias("entries")
        classes = stored(classes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), *held, entries), "classes")
        repeated = named.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count() > 0
        rows = stored(known.select("doc_id", "n_shingles", "node"), "rows")
        discard(known)
        near = components(near_links(classes, percent))
        member = near.select("node", F.col("label").alias("block")).join(classes.select("node", "rep_id", "rep_key", "n_shingles"), "node")
        member = stored(member.select("block", "node", "rep_id", "rep_key", F.col("n_shingles").alias("entries")), "near")
        with_text = texts_of(member, slim)
        if repeated:
            with_text = with_text.dropDuplicates(["block", "node"])

        def read(group):
            known, rows = WordHashes(), {}
            for side, node, text in zip(group["side"], group["node"], group["text"]):
                own = shingle_set(text.encode(), size, known)
                if name_of(own) == node:
                    rows[side, node] = own
            return rows

        def wanted(left, right):
            sizes = [np.array([len(x) for x in side]) for side in (left, right)]
            return similar(left, right, least_overlap(*sizes, percent))

        labels = components(linked_blocks(with_text, member, ["text"], read, wanted, "members"))
    whole = classes.join(labels, "node", "left").select("node", "rep_id", F.coalesce("label", "node").alias("label"))
    smallest = whole.groupBy("label").agg(F.min("rep_id").alias("component_id"))
    found = whole.join(smallest, "label").select("node", "component_id")
    return rows.join(found, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def texts_of(member: DataFrame, docs: DataFrame) -> DataFrame:
    """``(block, node, text)`` of the rows that stand for a set; they go to the texts, in turns if they are many.

    No text but theirs is moved, however many there are.
    """
    turns = -(-member.count() // SENT_ROWS)
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = None
    for turn in range(max(turns, 1)):
        own = F.broadcast(member.where(F.pmod(F.xxhash64("node"), F.lit(turns)) == turn) if turns > 1 else member)
        same = (texts.doc_id == own.rep_id) & (texts.text_key == own.rep_key)
        some = texts.join(own, same).select("block", "node", "text")
        some = stored(some, "texts") if turns > 1 else some
        found = some if found is None else found.unionAll(some)
    return found


def near_links(classes: DataFrame, percent: int) -> DataFrame:
    """Links that connect every two rows whose first columns have the overlap that their sizes demand."""
    met = stored(blocks_of(classes, percent), "met")
    pairs = stored(not_by_chance(met, classes, percent), "pairs")
    discard(met)
    whole = pairs.unionAll(pairs.select("pivot", F.col("pivot").alias("node")).distinct())
    members = whole.join(shortened(classes), "node").withColumnRenamed("pivot", "block")
    sizes = whole.join(classes.select("node", "entries"), "node").withColumnRenamed("pivot", "block")

    def read(group):
        columns = zip(group["side"], group["node"], group["n_shingles"], group["n_cold"], group["short"])
        return {(side, node): (size, cold, np.frombuffer(short, np.uint32)) for side, node, size, cold, short in columns}

    def wanted(left, right):
        return similar([r[2] for r in left], [r[2] for r in right], prefix_need(left, right, percent))

    return linked_blocks(members, sizes, ["n_shingles", "n_cold", "short"], read, wanted, "blocks")


def shortened(classes: DataFrame) -> DataFrame:
    """``(node, n_shingles, n_cold, short)``: the upper halves of the hashes; products of them can only be too large."""

    def run(batches):
        for batch in batches:
            short = [(np.frombuffer(first, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for first in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(short, pa.binary())], ["node", "n_shingles", "n_cold", "short"])

    return classes.select("node", "n_shingles", "n_cold", "first").mapInArrow(run, "node binary, n_shingles long, n_cold long, short binary")
