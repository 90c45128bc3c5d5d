"""Hard negatives by exact inner product search in cover trees.

Stored vectors are dealt by their nearest centre over shards of bounded size, and each
shard gets a cover tree: a node is a vector with the radius that covers all vectors
below it, and the radii shrink from level to level.  Vectors are augmented by one
coordinate that gives them all the same norm; there the distance of an anchor from
a node tells the inner product, so centre and radius bound the products of all that is below.

A search goes down level by level for a block of anchors at once; nodes whose bounds lie
outside of what is wanted are skipped with all that is below.  The leaves that are left are visited
best-first: those with the highest upper bound come first and are verified by exact integer
products, and it ends when no bound reaches the k-th best.  Anchors visit their own shard first; what they
find there is the floor for the others, and shards whose radius cannot reach it are not visited.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import stored

POSITIVES = 5  # of an anchor
NEGATIVES = 5  # of an anchor and a positive
LOW, HIGH = 80, 100  # window of the negatives' scores, in hundredths of the positive's
SCALE = 256  # of the components before they are rounded down
SHARD_ROWS = 4096  # vectors of a shard, about
CENTRES = 4096  # at most; a centre with more vectors has several shards
SUMMARY = 65_536  # shards whose radii are sent to the anchors; beyond it every shard is visited
LEAF = 16  # vectors below which a node is not divided
SHRINK = 0.7  # of the radius, from a level to the next
NET = 64  # centres that are tried at once
FIRST = 64  # leaves that are verified at first ...
GULP = 256  # ... and those that follow, at once
ANCHORS = 128  # that go down a tree together
EXACT = 2.0**53  # products below are exact in floating point


# ---- the tree of a shard ------------------------------------------------------------


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2.0 * points @ centres.T
    return np.sqrt(np.maximum(square, 0.0))


def covering(points: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """``members`` in groups that lie within ``radius`` of their first."""
    found = []
    while len(members):
        tried = members[:NET]
        apart = distances(points[tried], points[tried]) > radius
        kept = []
        for i in range(len(tried)):
            if apart[i, kept].all():
                kept.append(i)
        far = distances(points[members], points[tried[kept]])
        far[kept, range(len(kept))] = -1.0  # a centre is covered by itself
        nearest = far.argmin(axis=1)
        inside = far[np.arange(len(members)), nearest] <= radius
        for j, i in enumerate(kept):
            own = members[inside & (nearest == j)]
            found.append(np.r_[tried[i], own[own != tried[i]]])
        members = members[~inside]
    return found


class CoverTree:
    """Rows ``ids, labels, points`` in the order of the leaves, and nodes in the order of the levels.

    Node ``n`` has the rows from ``first[n]`` to ``last[n]`` and the children from
    ``child[n]`` to ``child_end[n]``, none for a leaf; ``centre[n]`` is one of its rows.
    """

    NAMES = ("ids", "labels", "points", "centre", "radius", "first", "last", "child", "child_end")

    def __init__(self, **arrays):
        for name in self.NAMES:
            setattr(self, name, arrays[name])
        points = self.points.astype(np.float64)
        self.exact_points, self.points = self.points, points
        self.is_leaf = self.child_end == 0
        square = (points * points).sum(axis=1)
        self.norm = float(np.sqrt(square.max()))
        self.centres = points[self.centre]
        self.augmented = np.sqrt(np.maximum(self.norm**2 - square[self.centre], 0.0))

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> "CoverTree":
        real = points.astype(np.float64)
        square = (real * real).sum(axis=1)
        real = np.c_[real, np.sqrt(np.maximum(square.max() - square, 0.0))]
        order = np.empty(len(ids), np.int64)
        nodes, queue = [], [(np.arange(len(ids)), 0)]
        for members, start in queue:  # grows while it is read
            far = np.sqrt(((real[members] - real[members[0]]) ** 2).sum(axis=1))
            radius = float(far.max()) * (1 + 1e-9)
            groups = covering(real, members, radius * SHRINK) if len(members) > LEAF and radius > 0 else [members]
            order[start : start + len(members)] = np.concatenate(groups)
            child = len(queue) if len(groups) > 1 else 0
            nodes.append((radius, start, start + len(members), child, child + len(groups) if child else 0))
            if child:
                at = start
                for group in groups:
                    queue.append((group, at))
                    at += len(group)
        radius, first, last, child, child_end = map(np.array, zip(*nodes))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        centre = place[np.array([members[0] for members, _ in queue])]  # children have moved the rows
        return cls(ids=ids[order], labels=labels[order], points=points[order], centre=centre, radius=radius,
                   first=first, last=last, child=child, child_end=child_end)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: self.exact_points if n == "points" else getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "CoverTree":
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**{n: arrays[n] for n in cls.NAMES})

    def bounds(self, anchors: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of what lies below ``nodes``, a column for each anchor."""
        return product_bounds(anchors, self.centres[nodes], self.augmented[nodes], self.radius[nodes], self.norm)

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact integer products."""
        if np.sqrt(float((anchor.astype(np.float64) ** 2).sum())) * self.norm < EXACT:
            return np.rint(self.points[rows] @ anchor.astype(np.float64)).astype(np.int64)
        exact = self.exact_points[rows].astype(object) @ anchor.astype(object)
        return np.array([int(x) for x in exact], dtype=np.int64)


def product_bounds(anchors, centres, augmented, radius, norm) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of ``anchor . x`` for all ``x`` of norm ``norm`` (augmented) within ``radius`` of the centres.

    A row for each centre and a column for each anchor.
    """
    anchors = anchors.astype(np.float64)
    own = (anchors * anchors).sum(axis=1)
    middle = centres @ anchors.T
    radius, norm = radius[:, None], np.reshape(norm, (-1, 1))  # of each centre, or of all
    reach = np.sqrt(own) * radius
    square = (centres * centres).sum(axis=1) + augmented**2
    away = np.sqrt(np.maximum(own + square[:, None] - 2.0 * middle, 0.0))
    sphere = own + norm * norm
    high = np.minimum(middle + reach, (sphere - np.maximum(away - radius, 0.0) ** 2) / 2)
    low = np.maximum(middle - reach, (sphere - (away + radius) ** 2) / 2)
    slack = 1e-6 + 1e-9 * (sphere + np.sqrt(own) * norm)
    return low - slack, high + slack


class Nearest:
    """The best ``k`` rows with scores from ``low`` to ``high``: higher scores first, then smaller ids."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> float:
        return max(self.low, self.score[-1]) if len(self.score) == self.k else self.low

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = (score >= self.floor()) & (score <= self.high)
        if keep.any():
            score, ids = np.r_[self.score, score[keep]], np.r_[self.id, ids[keep]]
            best = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[best], ids[best]


def descend(tree: CoverTree, anchors: np.ndarray, wanted: list[list[Nearest]], suits: list) -> None:
    """Offer each of ``wanted[a]`` all rows that may belong to it.

    ``suits[a](ids, labels)`` says which rows count for anchor ``a``.
    """
    floor = np.array([min(one.floor() for one in own) for own in wanted], np.float64)
    top = np.array([max(one.high for one in own) for own in wanted], np.float64)
    nodes, open_, found = np.zeros(1, np.int64), np.ones((1, len(anchors)), bool), []
    while len(nodes):  # a level
        low, high = tree.bounds(anchors, nodes)
        open_ &= (high >= floor) & (low <= top)
        kept = open_.any(axis=1)
        nodes, open_, high = nodes[kept], open_[kept], high[kept]
        leaf = tree.is_leaf[nodes]
        found.append((nodes[leaf], np.where(open_[leaf], high[leaf], -np.inf)))
        inner, open_ = nodes[~leaf], open_[~leaf]
        sizes = tree.child_end[inner] - tree.child[inner]
        nodes = spans(tree.child[inner], sizes)
        open_ = np.repeat(open_, sizes, axis=0)
    leaves, bound = (np.concatenate(x) for x in zip(*found))
    for a, anchor in enumerate(anchors):
        visit_leaves(tree, anchor, wanted[a], suits[a], leaves, bound[:, a])


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``sizes`` of them."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def visit_leaves(tree: CoverTree, anchor: np.ndarray, wanted: list[Nearest], suits, leaves: np.ndarray, bound: np.ndarray) -> None:
    at = np.flatnonzero(bound > -np.inf)
    if len(at) > 4 * FIRST:  # the best ones first, as they rule out most others
        at = at[np.argpartition(-bound[at], FIRST)]
        offer_leaves(tree, anchor, wanted, suits, leaves[at[:FIRST]])
        at = at[FIRST:]
        at = at[bound[at] >= min(one.floor() for one in wanted)]
    at = at[np.argsort(-bound[at], kind="stable")]
    for start in range(0, len(at), GULP):
        if bound[at[start]] < min(one.floor() for one in wanted):
            return
        offer_leaves(tree, anchor, wanted, suits, leaves[at[start : start + GULP]])


def offer_leaves(tree: CoverTree, anchor: np.ndarray, wanted: list[Nearest], suits, leaves: np.ndarray) -> None:
    rows = spans(tree.first[leaves], tree.last[leaves] - tree.first[leaves])
    rows = rows[suits(tree.ids[rows], tree.labels[rows])]
    if len(rows):
        score, ids = tree.scores(anchor, rows), tree.ids[rows]
        for one in wanted:
            one.offer(score, ids)


# ---- shards and visits --------------------------------------------------------------


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as int64, shorter ones filled up with zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each ``key`` of sorted batches."""
    held, current = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        bounds = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else []
        for start, stop in zip(bounds[:-1], bounds[1:]):
            if held and keys[start] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = keys[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def usable(rows: DataFrame, id_col: str, label: Column, vec_col: str, scale: int) -> DataFrame:
    """``(vec_id, label, point)`` of the rows that take part, one for each id, with whole components."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    slim = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = slim.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    point = F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", point.alias("point"))).alias("row")).select("vec_id", "row.*")


def with_shards(rows: DataFrame, n: int, dim: int) -> DataFrame:
    """``rows`` with ``shard``: their nearest centre, cut into parts where it has many rows."""
    few = min(CENTRES, -(-n // SHARD_ROWS))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(few).select("point").toArrow()  # at most CENTRES rows
    centres = rows.sparkSession.sparkContext.broadcast(matrix(drawn["point"].combine_chunks(), dim).astype(np.float64))

    @F.arrow_udf("long")
    def nearest(points: pa.Array) -> pa.Array:
        return pa.array(distances(matrix(points, dim).astype(np.float64), centres.value).argmin(axis=1))

    dealt = rows.withColumn("centre", nearest("point"))
    parts = dealt.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("parts"))  # at most CENTRES rows
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return dealt.join(F.broadcast(parts), "centre").select("vec_id", "label", "point", (F.col("centre") * (1 << 32) + part).alias("shard"))


def trees_of(rows: DataFrame, dim: int) -> DataFrame:
    """``(shard, tree, centre, augmented, radius, norm)``: the cover tree of every shard."""
    schema = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("tree", T.BinaryType()), T.StructField("centre", T.ArrayType(T.DoubleType()))]
        + [T.StructField(c, T.DoubleType()) for c in ("augmented", "radius", "norm")]
    )

    def run(batches):
        for table in runs_of(batches, "shard"):
            points = matrix(table["point"].combine_chunks(), dim)
            if len(points) and np.abs(points).max() >= 2**62:
                raise ValueError("a vector has components beyond 64 bits")
            tree = CoverTree.build(table["vec_id"].to_numpy(), table["label"].to_numpy(), points)
            values = [[table["shard"][0].as_py()], [tree.dump()], [tree.centres[0].tolist()], [tree.augmented[0]], [tree.radius[0]], [tree.norm]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, wanted)], schema=wanted)

    wanted = pa.schema([("shard", pa.int64()), ("tree", pa.binary()), ("centre", pa.list_(pa.float64())), *[(c, pa.float64()) for c in ("augmented", "radius", "norm")]])
    return rows.repartition("shard").sortWithinPartitions("shard", "vec_id").mapInArrow(run, schema)


class Shards:
    """Bounds of all shards, sent to every task in blocks of at most ``SUMMARY``."""

    def __init__(self, trees: DataFrame, dim: int):
        self.dim, self.blocks = dim, []
        blocks = -(-trees.count() // SUMMARY)
        for i in range(blocks):
            own = trees.where(F.pmod(F.xxhash64("shard"), F.lit(blocks)) == i) if blocks > 1 else trees
            head = own.select("shard", "centre", "augmented", "radius", "norm").toArrow()
            centres = np.array(head["centre"].to_pylist(), np.float64).reshape(len(head), dim)
            bounds = [head[c].to_numpy() for c in ("augmented", "radius", "norm")]
            self.blocks.append(trees.sparkSession.sparkContext.broadcast((head["shard"].to_numpy(), centres, *bounds)))

    def visits(self, anchors: DataFrame, low: str | None, high: str | None, home: str = "all") -> DataFrame:
        """``anchors`` once for each ``shard`` that may hold scores from ``low`` to ``high``.

        ``home`` is ``"only"`` for the shard of the first block whose centre has the greatest
        product, ``"not"`` for all others.
        """
        none = F.lit(None).cast("long")
        ends = [F.col(low) if low else none, F.col(high) if high else none]
        found = None
        for i, block in enumerate(self.blocks[:1] if home == "only" else self.blocks):
            picked = shards_in(block, self.dim, home if i == 0 else "all")(F.col("point"), *ends)
            some = anchors.withColumn("shards", picked).withColumn("shard", F.explode("shards")).drop("shards")
            found = some if found is None else found.unionAll(some)
        return found


def shards_in(block, dim: int, home: str):
    @F.arrow_udf("array<long>")
    def chosen(points: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        shards, centres, augmented, radius, norm = block.value
        out, anchors = [], matrix(points, dim)
        least = np.array([-np.inf if x is None else x for x in lows.to_pylist()])
        most = np.array([np.inf if x is None else x for x in highs.to_pylist()])
        if not len(shards):
            return pa.array([[]] * len(points), pa.list_(pa.int64()))
        for start in range(0, len(anchors), ANCHORS):
            some = slice(start, start + ANCHORS)
            own = (centres @ anchors[some].astype(np.float64).T).argmax(axis=0)
            if home == "only":
                out += shards[own][:, None].tolist()
                continue
            low, high = product_bounds(anchors[some], centres, augmented, radius, norm)
            fit = (high >= least[some]) & (low <= most[some])
            if home == "not":
                fit[own, np.arange(len(own))] = False
            out += [shards[x].tolist() for x in fit.T]
        return pa.array(out, pa.list_(pa.int64()))

    return chosen


def visit(visits: DataFrame, trees: DataFrame, dim: int, schema: T.StructType, find) -> DataFrame:
    """``find(tree, anchor rows, vectors)`` for blocks of the anchors of every shard.

    Anchors and trees are shuffled by shard, the tree first: a task holds one tree and
    streams the anchors past it.
    """
    names = [c for c in visits.columns if c != "shard"]
    plain = [c for c in names if c != "point"]
    left = trees.select("shard", F.lit(0).alias("side"), "tree", *[F.lit(None).cast(visits.schema[c].dataType).alias(c) for c in names])
    right = visits.select("shard", F.lit(1).alias("side"), F.lit(None).cast("binary").alias("tree"), *names)
    both = left.join(visits.select("shard").distinct(), "shard", "left_semi").unionAll(right)

    def run(batches):
        tree = None
        for batch in batches:
            sides = batch.column("side").to_numpy()
            found = []
            rows = batch.select(plain).to_pylist()
            points = matrix(batch.column("point"), dim)
            at = 0
            while at < len(sides):
                if sides[at] == 0:
                    tree = CoverTree.load(batch.column("tree")[at].as_py())
                    at += 1
                    continue
                trees_ahead = np.flatnonzero(sides[at : at + ANCHORS] == 0)
                end = at + int(trees_ahead[0]) if len(trees_ahead) else min(at + ANCHORS, len(sides))
                found += find(tree, rows[at:end], points[at:end])
                at = end
            columns = zip(*found) if found else [[] for _ in schema.fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema.names)

    return both.repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(run, schema)


def longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


# ---- mining -------------------------------------------------------------------------


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | None = None,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Each component becomes ``floor(scale * x)``; a score is the inner product with the anchor.
    Higher scores come first, ties go to the smaller id.  Anchors are the rows with
    ``is_anchor`` (a condition on ``vec_id`` and ``label``); their positives are the best
    ``positives`` other rows of their label.  For each of them the best ``negatives`` rows of
    another label follow whose score is ``low`` to ``high`` hundredths of the positive's.

    A row with a NULL id, label or vector, or with a component that is NULL or not finite,
    takes no part.  Of rows that share an id the one with the smallest label and vector
    counts.  Vectors of different lengths are filled up with zeros.  Components beyond 64
    bits and scores beyond them are errors.  An anchor without a positive, or a
    positive without a negative, gives no row.  Other columns are ignored.
    """
    spark = rows.sparkSession
    out = longs("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
    points = stored(usable(rows, id_col, F.col("label") if label is None else label, vec_col, scale), "points")
    n, dim = points.agg(F.count(F.lit(1)), F.max(F.size("point"))).first()
    if not n or not dim:
        dim = 1
    trees = stored(trees_of(with_shards(points, n, dim), dim), "trees") if n else None
    if trees is None or positives <= 0 or negatives <= 0:
        return with_rank(spark.createDataFrame([], out), negatives)
    shards = Shards(trees, dim)
    anchors = points.where(is_anchor)

    def find_positives(tree, rows, vectors):
        best = [Nearest(positives, -np.inf if r["floor"] is None else r["floor"]) for r in rows]
        suits = [lambda ids, labels, r=r: (labels == r["label"]) & (ids != r["vec_id"]) for r in rows]
        descend(tree, vectors, [[one] for one in best], suits)
        return [(r["vec_id"], i, s) for r, one in zip(rows, best) for i, s in zip(one.id.tolist(), one.score.tolist())]

    found = longs("anchor_id", "positive_id", "positive_score")
    start = anchors.withColumn("floor", F.lit(None).cast("long"))
    near = stored(visit(shards.visits(start, None, None, "only"), trees, dim, found, find_positives), "near")
    full = near.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("positive_score").alias("floor")).where(F.col("n") == positives)
    start = anchors.join(full.select(F.col("anchor_id").alias("vec_id"), "floor"), "vec_id", "left").select(*anchors.columns, "floor")
    far = visit(shards.visits(start, "floor", None, "not"), trees, dim, found, find_positives)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = near.unionAll(far).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    chosen = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))

    # scores from low to high hundredths, as whole numbers; an empty window asks for nothing
    windows = F.filter(
        F.transform("positives", lambda p: F.struct(
            p["positive_id"].alias("id"), p["positive_score"].alias("score"),
            whole_part(p["positive_score"], low, up=True).alias("low"), whole_part(p["positive_score"], high, up=False).alias("high"))),
        lambda w: w["low"] <= w["high"],
    )
    asked = anchors.join(chosen.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "point", windows.alias("windows"))
    asked = stored(asked.where(F.size("windows") > 0).withColumns(
        {"low": F.array_min(F.col("windows.low")), "high": F.array_max(F.col("windows.high"))}), "asked")

    def find_negatives(tree, rows, vectors):
        best = [[Nearest(negatives, w["low"], w["high"]) for w in r["windows"]] for r in rows]
        descend(tree, vectors, best, [lambda ids, labels, r=r: labels != r["label"] for r in rows])
        return [
            (r["vec_id"], w["id"], i, w["score"], s)
            for r, own in zip(rows, best)
            for w, one in zip(r["windows"], own)
            for i, s in zip(one.id.tolist(), one.score.tolist())
        ]

    return with_rank(visit(shards.visits(asked, "low", "high"), trees, dim, out, find_negatives), negatives)


def whole_part(score: Column, percent: int, up: bool) -> Column:
    """``percent`` hundredths of a score, rounded up or down to a whole number without floating point."""
    wide = score.cast("decimal(38,0)") * F.lit(percent).cast("decimal(10,0)")
    rest = F.pmod(wide, F.lit(100).cast("decimal(10,0)"))
    down = (wide - rest) / F.lit(100)
    return (F.when(rest > 0, down + 1).otherwise(down) if up else down).cast("long")


def with_rank(hits: DataFrame, negatives: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
