"""Near-duplicates, against all pairs of full sets."""

import random

import numpy as np
import pytest

import brute
from passagework.llm import odd_sketch as op


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 5_000))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([1, 2, 4, 30, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 40))):
                ws[rng.randrange(len(ws))] = word()
            docs.append(" ".join(ws) if rng.random() < 0.8 else "\t".join(ws).upper())
            base = ws if rng.random() < 0.5 else base  # chains of small steps
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 85), (2, 5, 80)])
def test_groups(spark, seed, size, percent):
    docs = corpus(seed) + [(1000, ""), (1001, None), (1002, " \n"), (1003, "")]
    df = spark.createDataFrame([(*d, b"x") for d in docs], "doc_id long, text string, node binary").repartition(4)
    got = {r["doc_id"]: r for r in op.near_duplicates(df, size, percent).collect()}
    assert len(got) == len(docs)
    for (key, text), smallest in zip(docs, brute.near_groups(docs, size, percent)):
        row = got[key]
        assert (row["component_id"], row["kept"], row["n_shingles"]) == (smallest, smallest == key, len(brute.shingles(text, size)))


def test_link_that_avoids_the_smallest(spark, monkeypatch):
    """A middle document links two others that are too far from each other."""
    monkeypatch.setattr(op, "BLOCK", 2)
    base = [f"t{i}" for i in range(200)]
    step = lambda n: " ".join(["z%d" % i if i < n else w for i, w in enumerate(base)])
    docs = [(i, step(12 * i)) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = op.near_duplicates(df, 3, 85).collect()
    assert [r["component_id"] for r in rows] == brute.near_groups(docs, 3, 85) == [0] * 6


def test_edges(spark):
    same = "one two three four five six"
    docs = [(None, same), (None, None), (5, same), (5, same), (4, same + " seven"), (8, "alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in op.near_duplicates(df, 3, 80).collect()))
    assert got == [(-1, -1, True), (-1, -1, True), (4, 4, True), (5, 4, False), (5, 4, False), (8, 8, True)]
    assert op.near_duplicates(df.where("false"), 3, 80).collect() == []


def test_null_text_under_an_id_of_a_cluster(spark):
    words = [f"t{i}" for i in range(60)]
    docs = [(5, None), (5, " ".join(words)), (6, " ".join(words[:-1])), (7, "alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in op.near_duplicates(df, 3, 85).collect())
    assert got == [(5, 0, 5, True), (5, 58, 5, True), (6, 57, 5, False), (7, 1, 7, True)]


def test_sketch_tells_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 2_000).astype(np.uint64))
    for share in (0.02, 0.08):
        b = np.unique(np.concatenate([a[int(len(a) * share) :], rng.integers(0, 2**63, int(len(a) * share)).astype(np.uint64)]))
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = op.odd_sketches(op.minhash([a, b])).view(np.uint64)
        flips = int(np.bitwise_count(x ^ y).sum())
        estimate = 1 + op.BITS / 4 / op.SAMPLES * np.log(1 - 2 * flips / op.BITS)
        assert abs(estimate - similarity) < 0.1
        assert flips <= op.most_flips(int(similarity * 100))
