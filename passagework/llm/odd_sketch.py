"""MinHash near-duplicates with odd sketches.

Each document's set of word shingles gives ``SAMPLES`` MinHash values.  Bands of
them name the buckets in which similar sets meet; the same values, folded into a
parity bitmap (an odd sketch), tell by the population count of an XOR how similar two
sets are.  What the sketch does not rule out is confirmed on the full sets.

Documents with the same set are one class from the start, found by an aggregation, so
copies are never paired.  Candidates are gathered as clusters, not as pairs: in each
bucket every class is tried against the smallest one, and only buckets whose classes
are still in different clusters are compared throughout, in blocks of bounded size,
each of which gives a spanning forest.  Inside a cluster the full sets decide, again
in blocks of bounded size: a block against itself, and, in a cluster of many blocks,
what its first class does not reach against all blocks.  Clusters and components come
from an iteration of joins; links stay in tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import add_columns, stored, word_lists

WORDS = 5  # words of a shingle
PERCENT = 80  # least similarity
BANDS = 32
ROWS = 5  # MinHash values per band
SAMPLES = BANDS * ROWS
BITS = 1024  # of an odd sketch
SURE = 5.0  # standard deviations by which an estimate may fall short
BLOCK = 1024  # classes that are compared at once ...
BLOCK_SHINGLES = 2_000_000  # ... and shingles of their sets
COLUMNS = 8192  # shingles whose incidence is held at once
WORDS_HELD = 400_000  # word hashes that a task remembers
PIECE = 1 << 17  # shingles hashed at once
SLICE_BYTES = 8 << 20

LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer words, of the whole sequence."""
    parts = []
    for ws in word_lists((text or b"").translate(FOLD)):
        if len(known) > WORDS_HELD:
            known.clear()
        parts.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)))
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(h):
        return h
    width = min(size, len(h))
    n = len(h) - width + 1
    key = np.full(n, width, np.uint64)
    for i in range(width):
        key = (key ^ h[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return np.unique(key)


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, 2**32, count, np.uint32), rng.integers(0, 2**31, count, np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """``(sets, SAMPLES)`` MinHash values of non-empty sets."""
    mask, factor = seeds(SAMPLES)
    out = np.full((len(sets), SAMPLES), 0xFFFFFFFF, np.uint32)
    owner_of, parts, held = [], [], 0

    def flush():
        values = (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        rows = np.array(owner_of)
        for s in range(SAMPLES):
            v = (values ^ mask[s]) * factor[s]
            v ^= v >> np.uint32(15)
            low = np.minimum.reduceat(v * np.uint32(0x85EBCA6B), starts)
            np.minimum.at(out[:, s], rows, low)

    for row, one in enumerate(sets):
        for at in range(0, len(one), PIECE):
            part = one[at : at + PIECE]
            parts.append(part)
            owner_of.append(row)
            held += len(part)
            if held >= PIECE:
                flush()
                owner_of, parts, held = [], [], 0
    if parts:
        flush()
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands_of(values: np.ndarray) -> np.ndarray:
    """``(sets, BANDS)`` bucket keys."""
    wide = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
    return key.view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """``(sets, BITS / 64)`` words: each sample flips the bit that its place and value name."""
    place = np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32)
    bit = (mix(values.astype(np.uint64) + place) % np.uint64(BITS)).astype(np.int64)
    flips = np.zeros((len(values), BITS), np.uint8)
    np.add.at(flips, (np.repeat(np.arange(len(values)), SAMPLES), bit.ravel()), 1)
    return np.packbits(flips & 1, axis=1).view("<i8")


def most_flips(percent: int) -> int:
    """Population count of an XOR above which two sets are surely less similar than ``percent``."""
    t = percent / 100
    least = max(0.0, t - SURE * math.sqrt(t * (1 - t) / SAMPLES))
    differing = 2 * SAMPLES * (1 - least)
    expected = BITS / 2 * (1 - math.exp(-2 * differing / BITS))
    return math.ceil(expected + SURE * math.sqrt(expected * (1 - expected / BITS)) / 2)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n_shingles, node, bands, sketch)``; ``node`` names the set, NULL for an empty one."""
    new = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]

    def work(slices):
        known = WordHashes()
        for batch in slices:
            sets = [shingle_set(t, size, known) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            full = [s for s in sets if len(s)]
            values = minhash(full)
            bands, sketch = iter(bands_of(values).tolist()), iter(odd_sketches(values).tolist())
            yield [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([name_of(s) for s in sets], pa.binary()),
                pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                pa.array([next(sketch) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]

    return add_columns(docs, new, work, leave_out=("text",), slice_bytes=SLICE_BYTES)


def name_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def flips_between(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, c: n + c)


def star_pairs(buckets: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """``(a, b)``: for each class the most similar of the smallest classes of its buckets."""
    smallest = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("last"))
    smallest = smallest.where(F.col("a") < F.col("last")).drop("last")
    pairs = buckets.join(smallest, "bucket").where(F.col("a") < F.col("node")).select("a", F.col("node").alias("b")).distinct()
    near = with_flips(pairs, classes).where(F.col("flips") <= limit)
    return near.groupBy("b").agg(F.min_by("a", F.struct("flips", "a")).alias("a")).select("a", "b")


def with_flips(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    first = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    second = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(first, "a").join(second, "b")
    return both.select("a", "b", flips_between(F.col("sketch_a"), F.col("sketch_b")).alias("flips"))


def open_links(buckets: DataFrame, classes: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """``(a, b)``: a spanning forest of similar classes in buckets that several clusters share."""
    labelled = buckets.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("label", "node").alias("label")
    )
    mixed = labelled.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members")
    )
    mixed = mixed.where(F.col("low") < F.col("high")).select(
        "bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts")
    )
    # a bucket of many blocks is spread over the pairs of its blocks
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = labelled.join(mixed, "bucket").select(
        "bucket", "node", own.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    dealt = dealt.join(classes.select("node", "sketch"), "node").select(
        "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "sketch"
    )
    tasks = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def work(batches):
        for _, group in groups(batches, ["bucket", "i", "j"]):
            sketch = np.array(group["sketch"], np.int64).view(np.uint64)
            near = np.zeros((len(sketch), len(sketch)), bool)
            for at in range(0, len(sketch), BLOCK):
                flips = np.zeros((min(BLOCK, len(sketch) - at), len(sketch)), np.uint16)
                for word in range(sketch.shape[1]):
                    flips += np.bitwise_count(sketch[at : at + BLOCK, word, None] ^ sketch[None, :, word])
                near[at : at + BLOCK] = flips <= limit
            yield from stars(group["node"], near)

    return tasks.mapInArrow(work, LINKS).distinct()


def stars(nodes: list[bytes], near: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The components of a symmetric matrix, each as links to its smallest node."""
    order = np.array(sorted(range(len(nodes)), key=nodes.__getitem__))
    near = near[np.ix_(order, order)]
    np.fill_diagonal(near, True)
    label, before = near.argmax(axis=1), None
    while before is None or (label != before).any():
        before = label
        label = np.minimum(label, np.where(near, label[None, :], len(label)).min(axis=1))
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    if len(moved):
        a, b = [nodes[order[i]] for i in label[moved]], [nodes[order[i]] for i in moved]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal keys in sorted batches, as columns."""
    key, held = None, None
    for batch in batches:
        columns = batch.to_pydict()
        names = list(columns)
        marks = list(zip(*[columns[k] for k in keys]))
        start = 0
        for at in range(1, len(marks) + 1):
            if at == len(marks) or marks[at] != marks[start]:
                part = {n: columns[n][start:at] for n in names}
                if key == marks[start]:
                    for n in names:
                        held[n] += part[n]
                else:
                    if held is not None:
                        yield key, held
                    key, held = marks[start], part
                start = at
    if held is not None:
        yield key, held


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections: products of incidence matrices over shingles that occur twice."""
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    shingles, column, times = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    keep = times > 1
    number = np.cumsum(keep) - 1
    inside = keep[column]
    rows, column = rows[inside], number[column[inside]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(keep.sum()), COLUMNS):
        first, last = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        has[rows[first:last], column[first:last] - at] = 1
        total += has[: len(left)] @ has[len(left) :].T
    return total


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    both = common(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return 100 * both >= percent * (sizes - both)


def exact_links(tasks: DataFrame, size: int, percent: int) -> DataFrame:
    """``(a, b)``: components of the full sets in each ``(cluster, i, j)`` task.

    The rows of ``tasks(cluster, i, j, side, node, text)`` with side 0 are compared
    with those of side 1, or with each other where there is no side 1.
    """
    sorted_tasks = tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def work(batches):
        known = WordHashes()
        for _, group in groups(batches, ["cluster", "i", "j"]):
            rows = {}
            for side, node, text in zip(group["side"], group["node"], group["text"]):
                own = shingle_set(text.encode(), size, known)
                if name_of(own) == node:  # else another text under the same id
                    rows[(side, node)] = own
            left, right = [[(n, s) for (side, n), s in rows.items() if side == k] for k in (0, 1)]
            nodes, sets = [n for n, _ in left], [s for _, s in left]
            if not right:
                if len(left) > 1:
                    yield from stars(nodes, linked(sets, sets, percent))
                continue
            if not left:
                continue
            near = linked(sets, [s for _, s in right], percent)
            names = nodes + [n for n, _ in right]
            whole = np.zeros((len(names), len(names)), bool)
            whole[: len(left), len(left) :] = near
            yield from stars(names, whole | whole.T)

    return sorted_tasks.mapInArrow(work, LINKS).distinct()


def exact_components(clusters: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """``(a, b)`` links that connect what the full sets connect inside each cluster."""
    member = clusters.select("node", F.col("label").alias("cluster")).join(classes.select("node", "rep_id", "n_shingles"), "node")
    sized = member.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    member = member.join(sized, "cluster").withColumn("part", part)
    # the text of every member once; a cluster's first class goes to each of its blocks
    held = stored(
        member.join(docs, member.rep_id == docs.doc_id).select("cluster", "node", "parts", "part", "text"), "members"
    )
    first = (F.col("node") == F.col("cluster")) & (F.col("parts") > 1)
    blocks = held.select(
        "cluster",
        F.explode(F.when(first, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))).alias("i"),
        F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "text",
    )
    links = stored(exact_links(blocks, size, percent), "links")
    many = held.where(F.col("parts") > 1)
    if many.limit(1).count() == 0:
        return links
    labels = components(links)
    many = many.join(labels, "node", "left").withColumn("apart", F.coalesce("label", "node") != F.col("cluster"))
    apart = many.where("apart").groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rows"))
    many = many.join(apart, "cluster")
    row = F.pmod(F.xxhash64("node", F.lit(2)), F.col("rows")).cast("int")
    left = many.where("apart").select(
        "cluster", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), "node", "text"
    )
    right = many.select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), "node", "text"
    )
    return links.unionByName(exact_links(left.unionByName(right), size, percent))


def components(links: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node reachable, for the nodes of ``(a, b)`` links.

    Every node takes the smallest label among its neighbours and its own, then the
    label of its label, until nothing changes.  Each round is a table in the shared folder.
    """
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        nearer = labels.join(offered, labels.node == offered.a).select(
            "node", F.least("label", "seen").alias("label"), F.col("label").alias("before")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        moved = nearer.join(jump, nearer.label == jump.via, "left").select(
            "node", F.least("label", "further").alias("label"), "before"
        )
        moved = stored(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where(F.col("label") < F.col("before")).limit(1).count() == 0:
            return labels


def near_duplicates(
    docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: groups of documents linked by similar shingle sets.

    Words are stretches without ASCII white space, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle.  Two documents are linked if 100 times the
    intersection of their sets is at least ``percent`` times the union.  A NULL or
    empty text has no shingles and is linked with nothing.  ``component_id`` is the
    smallest id reachable; the row with that id is ``kept``.  Rows that repeat an id
    and a text are alike; rows with a NULL id are linked with nothing and kept.
    Other columns are ignored.  A pair at the limit may be missed with a probability of about
    1e-6 (bands and sketch together); every link is found on the full sets.
    """
    rows = grouped_rows(docs, size, percent, id_col, text_col)
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def grouped_rows(
    docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text_key, n_shingles, label, component_id)`` of every row, for :func:`near_duplicates`.

    ``text_key`` is the ``xxhash64`` of the text, ``label`` names the group of linked rows;
    it and ``component_id`` are NULL for rows that are linked with nothing for lack of
    words or of an id.  Rows of one id with different texts can be in different groups.
    """
    slim = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    slim = slim.withColumn("text_key", F.xxhash64("text"))
    known = stored(sketches(slim, size), "sketches")
    named = known.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(
        named.groupBy("node").agg(F.min("doc_id").alias("rep_id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]),
        "classes",
    )
    texts = slim.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    buckets = stored(rows.join(shared, "bucket"), "buckets")
    limit = most_flips(percent)
    near = stored(star_pairs(buckets, classes, limit), "candidates")
    more = stored(open_links(buckets, classes, components(near), limit), "candidates")
    clusters = components(near.unionByName(more))
    labels = components(exact_components(clusters, texts, classes, size, percent))
    member = classes.join(labels, "node", "left").select("node", "rep_id", F.coalesce("label", "node").alias("label"))
    smallest = member.groupBy("label").agg(F.min("rep_id").alias("component_id"))
    of_node = member.join(smallest, "label").select("node", "label", "component_id")
    slim_rows = known.select("doc_id", "text_key", "n_shingles", "node")
    own = F.col("doc_id").isNotNull()
    return slim_rows.join(of_node, "node", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(own, F.col("label")).alias("label"), F.when(own, F.col("component_id")).alias("component_id")
    )
