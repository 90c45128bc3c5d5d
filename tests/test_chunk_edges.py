"""The recursive splitter on edges, against one that makes every piece."""

import random

import pytest

from passagework.operators import chunk


def cut_at(text: str, separator: str) -> list[str]:
    """Split, leaving each separator at the head of the piece that follows it."""
    if separator == "":
        return list(text)
    head, *rest = text.split(separator)
    return [piece for piece in [head, *(separator + part for part in rest)] if piece]


def pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy merge of consecutive pieces into chunks of at most ``size`` characters."""
    out, first, length = [], 0, 0
    for i, piece in enumerate(pieces):
        if length and length + len(piece) > size:
            out.append("".join(pieces[first:i]).strip())
            while length > overlap or (length and length + len(piece) > size):
                length -= len(pieces[first])
                first += 1
        length += len(piece)
    out.append("".join(pieces[first:]).strip())
    return [chunk for chunk in out if chunk]


def split_recursively(text: str, size: int, overlap: int, separators: tuple = chunk.SEPARATORS) -> list[str]:
    """Split at the coarsest separator that occurs; split what is still too long more finely."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out, short = [], []
    for piece in cut_at(text, separators[at]):
        if len(piece) < size or not finer:
            short.append(piece)
            continue
        out += pack(short, size, overlap)
        short = []
        out += split_recursively(piece, size, overlap, finer)
    return out + pack(short, size, overlap)


ALPHABETS = ("ab ", "a \n", "ab\n\n ", "日本 \n", "x", "ab\U0001f600 \n\n")


@pytest.mark.parametrize("seed", range(40))
def test_equals_the_plain_splitter(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.choice([1, 5, 30, 200])))
        size = rng.randint(1, 40)
        overlap = rng.randint(0, size - 1)
        separators = rng.choice([chunk.SEPARATORS, (" ",), ("\n\n", " "), ("b", ""), ("ab", "a", "")])
        assert chunk.split_recursively(text, size, overlap, separators) == split_recursively(text, size, overlap, separators)


def test_equals_the_plain_splitter_on_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [None, "", " ", "\n\n", "w" * 5_000, "a b " * 5_000]
    for size, overlap in ((1000, 200), (300, 0), (50, 49)):
        for text in texts if size == 1000 else texts[:200]:
            if text:
                assert chunk.split_recursively(text, size, overlap) == split_recursively(text, size, overlap)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, content string").repartition(3)
    got = {}
    for r in chunk.chunk_recursive(df).collect():
        got.setdefault(r.doc_id, {})[r.chunk_no] = r.content
    for i, text in enumerate(texts):
        want = split_recursively(text, 1000, 200) if text else []
        assert [got.get(str(i), {})[n] for n in range(len(want))] == want and len(got.get(str(i), {})) == len(want)
