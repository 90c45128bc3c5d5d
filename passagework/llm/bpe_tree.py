"""BPE encoding by tree concatenation, and decoding.

A text longer than a leaf is halved again and again, wherever its middle falls; the
halves are encoded independently and joined pairwise.  At each join a window around
the seam is encoded anew and grown until two successive tokens on either side agree
with what the halves have: every pair of neighbours then occurs in a correct
encoding, and a token sequence with that property is the encoding of the whole.
White space separates what a word tokenizer can merge, so inside a leaf equal
stretches between white space are encoded once, and a window never has to grow
beyond the white space on either side of its seam.

A text longer than ``PIECE_CHARS`` is cut into pieces that different tasks encode;
its tokens are joined in one task by the same rule.  Shorter ones stay where they
are read, and nothing of them is shuffled.
"""

from __future__ import annotations

import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import add_columns, release, without

PIECE_CHARS = 1 << 20
LEAF_CHARS = 2048  # what is not longer (in bytes, for a whole text) is not halved
SLICE_BYTES = 1 << 20  # text that a task splits at once
FIRST_WINDOW = 8  # tokens on either side of a seam
CACHED = 250_000  # stretches that a task remembers ...
CACHED_BYTES = 32 << 20  # ... and what they and their ids take, about
ENCODED = 16_384  # stretches that are encoded at once

_models: dict[str, "Model"] = {}


class Tokens(NamedTuple):
    """Tokens of an unsplit text: ids and the characters each one covers."""

    text: str
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Run(NamedTuple):
    """Part of a text: tokens up to its first white space, ids between, tokens from its last.

    Without white space ``head`` is all of it, and the others are None.
    """

    head: Tokens
    middle: bytes | None
    tail: Tokens | None


class Model:
    """A tokenizer of the tokenizers library in a task, with the stretches it has encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.known: dict[bytes, bytes] = {}
        self.known_bytes = 0

    def learn(self, stretches: set[bytes]) -> None:
        fresh = list(stretches.difference(self.known))
        if len(self.known) + len(fresh) > CACHED or self.known_bytes > CACHED_BYTES:
            self.known.clear()
            self.known_bytes = 0
            fresh = list(stretches)
        short = [s for s in fresh if len(s) <= LEAF_CHARS]
        for at in range(0, len(short), ENCODED):
            some = short[at : at + ENCODED]
            encoded = self.tokenizer.encode_batch_fast([s.decode() for s in some], add_special_tokens=False)
            for stretch, one in zip(some, encoded):
                ids = self.known[stretch] = np.array(one.ids, "<u4").tobytes()
                self.known_bytes += len(stretch) + len(ids) + 66  # with the headers of both

    def stretches(self, text: bytes) -> list[bytes]:
        return text.split()  # bytes.split() knows ASCII white space only

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.stretches(t) for t in texts]
        self.learn({s for stretches in split for s in stretches})
        out = []
        for stretches in split:
            found = [self.known.get(s) for s in stretches]
            if None in found:
                found = [tree(self, s.decode()).ids.tobytes() if f is None else f for s, f in zip(stretches, found)]
            out.append(b"".join(found))
        return out

    def encode_tree(self, texts: list[bytes]) -> list[bytes]:
        """As ``encode``, each text by the tree of its halves."""
        split = [halved(t, LEAF_CHARS) for t in texts]
        whole = iter(self.encode([leaves[0] for leaves in split if len(leaves) == 1]))
        parts = [[edges(leaf) for leaf in leaves] for leaves in split if len(leaves) > 1]
        middles = iter(self.encode([middle for leaves in parts for _, middle, _ in leaves if middle is not None]))
        ends = {e for leaves in parts for head, _, tail in leaves for e in (head, tail) if e is not None}
        tokens = dict(zip(ends, map(self.leaf, [e.decode() for e in ends])))
        runs = iter(
            [
                Run(tokens[head], None if middle is None else next(middles), tokens.get(tail))
                for head, middle, tail in leaves
            ]
            for leaves in parts
        )
        return [next(whole) if len(leaves) == 1 else ids_of(joined_runs(self, next(runs))) for leaves in split]

    def leaf(self, text: str) -> Tokens:
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(encoded.offsets, np.int32).reshape(-1, 2)
        return Tokens(text, np.array(encoded.ids, "<u4"), spans[:, 0], spans[:, 1])

    def decode(self, ids: bytes) -> str:
        """As the library decodes for a tokenizer without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def forgetting(work):
    """``work``, after which the task's tokenizers go, whether it ends or is broken off."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            _models.clear()
            release()

    return run


def tree(bpe: Model, text: str, leaf_chars: int = LEAF_CHARS) -> Tokens:
    """Tokens of a text without white space: halves encoded on their own, then joined."""
    if len(text) <= leaf_chars:
        return bpe.leaf(text)
    middle = len(text) // 2
    return join(bpe, tree(bpe, text[:middle], leaf_chars), tree(bpe, text[middle:], leaf_chars))


def halved(text: bytes, size: int) -> list[bytes]:
    """A text cut in halves, between characters, until no part has more than ``size`` (8 or more) bytes."""
    if len(text) <= size:
        return [text]
    middle = len(text) // 2
    while text[middle] & 0xC0 == 0x80:
        middle -= 1
    return halved(text[:middle], size) + halved(text[middle:], size)


def edges(text: bytes) -> tuple[bytes, bytes | None, bytes | None]:
    """A text up to its first white space, between, and from the last; all of it, None, None without white space."""
    head = b"" if text[:1].isspace() else (text.split(None, 1) or [b""])[0]
    if len(head) == len(text):
        return head, None, None
    tail = b"" if text[-1:].isspace() else text.rsplit(None, 1)[-1]
    return head, text[len(head) : len(text) - len(tail)], tail


def joined_runs(bpe: Model, runs: list[Run]) -> Run:
    """The parts of a text joined pairwise, level by level."""
    while len(runs) > 1:
        pairs = [runs[i : i + 2] for i in range(0, len(runs), 2)]
        runs = [join_runs(bpe, *p) if len(p) == 2 else p[0] for p in pairs]
    return runs[0]


def join_runs(bpe: Model, left: Run, right: Run) -> Run:
    if left.middle is None:
        return right._replace(head=join(bpe, left.head, right.head))
    seam = join(bpe, left.tail, right.head)
    if right.middle is None:
        return left._replace(tail=seam)
    return Run(left.head, left.middle + seam.ids.tobytes() + right.middle, right.tail)


def ids_of(run: Run) -> bytes:
    ends = run.head.ids.tobytes()
    return ends if run.middle is None else ends + run.middle + run.tail.ids.tobytes()


def join(bpe: Model, left: Tokens, right: Tokens) -> Tokens:
    """Tokens of both texts written as one: windows around the seam grow until both sides agree."""
    if not left.text or not right.text:
        return left if left.text else right
    text, seam = left.text + right.text, len(left.text)
    moved = Tokens(right.text, right.ids, right.start + seam, right.end + seam)
    width = FIRST_WINDOW
    while True:
        open_left, open_right = width < len(left.ids), width < len(right.ids)
        first = int(left.start[-width]) if open_left else 0
        last = int(moved.end[width - 1]) if open_right else len(text)
        window = bpe.leaf(text[first:last])
        window = window._replace(start=window.start + first, end=window.end + first)
        keep, begin = agreement(left, window, forward=True) if open_left else (0, 0)
        resume, stop = agreement(moved, window, forward=False) if open_right else (len(right.ids), len(window.ids))
        if None not in (keep, resume) and begin <= stop:
            return Tokens(
                text,
                *[
                    np.concatenate([a[:keep], b[begin:stop], c[resume:]])
                    for a, b, c in zip(left[1:], window[1:], moved[1:])
                ],
            )
        width *= 2


def agreement(side: Tokens, window: Tokens, forward: bool) -> tuple[int | None, int | None]:
    """Where two successive tokens of ``side`` and ``window`` are the same, nearest to the window's outer edge.

    Gives the cut in ``side`` and in ``window``: between the two tokens.  Tokens that
    share a character with a neighbour have no cut between them and do not count.
    """
    place = {key: i for i, key in enumerate(zip(side.ids.tolist(), side.start.tolist(), side.end.tolist()))}
    keys = list(zip(window.ids.tolist(), window.start.tolist(), window.end.tolist()))
    steps = range(len(keys) - 1) if forward else range(len(keys) - 2, -1, -1)
    for j in steps:
        i = place.get(keys[j])
        if i is not None and place.get(keys[j + 1]) == i + 1 and keys[j][2] <= keys[j + 1][1]:
            return i + 1, j + 1
    return None, None


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``: the tokens of the text as little-endian unsigned 32-bit integers.

    ``path`` names a file of the tokenizers library for a word tokenizer (one that
    drops white space and never merges across it); no special tokens are added, but
    those written in a text are recognised.  A NULL or empty text has no ids.  A
    column ``ids`` is replaced.  ``keep_text=False`` leaves the text out.
    """
    out = [] if keep_text else [text_col]
    length = F.coalesce(F.length(docs[f"`{text_col}`"]), F.lit(0))
    field = [T.StructField("ids", T.BinaryType())]

    def whole(slices):
        for batch in slices:
            column = batch.column(batch.schema.names.index(text_col)).cast(pa.binary())
            yield [pa.array(model(path).encode_tree([t or b"" for t in column.to_pylist()]), pa.binary())]

    short = add_columns(docs.where(length <= PIECE_CHARS), field, forgetting(whole), leave_out=tuple(out), slice_bytes=SLICE_BYTES)
    return short.unionByName(encode_long(docs.where(length > PIECE_CHARS), path, text_col, PIECE_CHARS, out))


def encode_long(docs: DataFrame, path: str, text_col: str, size: int, leave_out: list[str]) -> DataFrame:
    """As ``encode``, the pieces of a text being encoded in different tasks."""
    rest = without(docs, ["ids"])
    text = F.col("row")[text_col]
    keyed = rest.select(
        F.monotonically_increasing_id().alias("key"), F.struct(*[rest[f"`{c}`"] for c in rest.columns]).alias("row")
    )
    pieces = keyed.select(
        "key",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")),
                lambda i: F.substring(text, i * size + 1, F.lit(size)),
            )
        ).alias("nth", "piece"),
        F.when(F.col("nth") == 0, F.struct(*[F.col("row")[c].alias(c) for c in rest.columns if c not in leave_out])).alias("row"),
    )
    parts = [T.StructField(n, T.BinaryType()) for n in ("head", "middle", "tail")]

    def ends(slices):
        for batch in slices:
            rows = [open_ends(model(path), p) for p in batch.column(batch.schema.names.index("piece")).to_pylist()]
            yield [pa.array(list(c), pa.binary()) for c in zip(*rows)]

    encoded = add_columns(pieces.repartition("key", "nth"), parts, forgetting(ends))
    ordered = encoded.repartition("key").sortWithinPartitions("key", "nth")
    kept = [f for f in rest.schema.fields if f.name not in leave_out]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("ids", T.BinaryType())])

    def joined(batches):
        key, text = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    if text is not None:
                        yield out(key, text.close())
                    key, text = row["key"], Open(model(path))
                text.add(row["piece"], row["head"], row["middle"], row["tail"])
        if text is not None:
            yield out(key, text.close())

    def out(key, ids):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids], pa.binary())], ["key", "ids"])

    ids = ordered.drop("row").mapInArrow(forgetting(joined), schema)
    first = encoded.where("nth = 0").select("key", "row")
    return first.join(ids, "key").select(*[F.col("row")[f.name].alias(f.name) for f in kept], "ids")


def packed(tokens: Tokens) -> bytes:
    return np.stack([tokens.ids.astype("<i4"), tokens.start.astype("<i4"), tokens.end.astype("<i4")]).tobytes()


def unpacked(text: str, data: bytes) -> Tokens:
    ids, start, end = np.frombuffer(data, "<i4").reshape(3, -1)
    return Tokens(text, ids.astype("<u4"), start, end)


def open_ends(bpe: Model, piece: str) -> tuple[bytes, bytes | None, bytes | None]:
    """A piece encoded: its ends, which may go on in the neighbours, with positions; only ids between."""
    head, middle, tail = edges(piece.encode())
    if middle is None:
        return packed(tree(bpe, piece)), None, None
    return packed(tree(bpe, head.decode())), bpe.encode_tree([middle])[0], packed(tree(bpe, tail.decode()))


class Open:
    """A text whose pieces come one after another."""

    def __init__(self, bpe: Model):
        self.bpe, self.ids, self.ends = bpe, [], []

    def add(self, piece: str, head: bytes, middle: bytes | None, tail: bytes | None) -> None:
        first, _, last = edges(piece.encode())
        self.ends.append(unpacked(first.decode(), head))
        if middle is not None:
            self.settle()
            self.ids.append(middle)
            self.ends = [unpacked(last.decode(), tail)]

    def settle(self) -> None:
        """Join the open ends pairwise, level by level."""
        level = [t for t in self.ends if t.text]
        while len(level) > 1:
            pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = [join(self.bpe, *p) if len(p) == 2 else p[0] for p in pairs]
        self.ids += [t.ids.tobytes() for t in level]
        self.ends = []

    def close(self) -> bytes:
        self.settle()
        return b"".join(self.ids)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep_ids: bool = True) -> DataFrame:
    """``df`` with ``decoded``, the text of ``ids`` with special tokens; NULL ids stay NULL."""

    def work(slices):
        for batch in slices:
            column = batch.column(batch.schema.names.index(ids_col))
            yield [pa.array([None if i is None else model(path).decode(i) for i in column.to_pylist()], pa.string())]

    return add_columns(
        df,
        [T.StructField("decoded", T.StringType())],
        forgetting(work),
        leave_out=() if keep_ids else (ids_col,),
        slice_bytes=SLICE_BYTES,
    )
