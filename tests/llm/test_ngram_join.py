"""The n-gram Jaccard join, against all pairs of full sets."""

import random

import numpy as np
import pytest

import brute
from passagework.llm import ngram_join as op


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 5_000))
    passage = [word() for _ in range(40)]
    docs = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice([1, 2, 4, 30, 120, 300]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 9)):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 40))):
                ws[rng.randrange(len(ws))] = word()
            docs.append(" ".join(ws) if rng.random() < 0.8 else "\t".join(ws).upper())
            base = ws if rng.random() < 0.5 else base  # chains of small steps
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,size,percent,block", [(1, 4, 85, 1024), (2, 5, 80, 1024), (3, 4, 85, 3)])
def test_components(spark, monkeypatch, seed, size, percent, block):
    monkeypatch.setattr(op, "BLOCK", block)
    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(held, "3" if block == 3 else "10000")  # runs of columns that go over several batches
    docs = corpus(seed) + [(1000, ""), (1001, None), (1002, " \n"), (1003, "")]
    df = spark.createDataFrame([(*d, b"x", 1) for d in docs], "doc_id long, text string, node binary, block int").repartition(4)
    got = {r["doc_id"]: r for r in op.join_rows(df, size, percent).collect()}
    assert len(got) == len(docs)
    spark.conf.unset(held)
    for (key, text), smallest in zip(docs, brute.near_groups(docs, size, percent)):
        assert (got[key]["component_id"], got[key]["n_shingles"]) == (smallest, len(brute.shingles(text, size)))


def test_chain_in_split_blocks(spark, monkeypatch):
    """Each document is similar to its neighbours only; the smallest row is far from most."""
    monkeypatch.setattr(op, "BLOCK", 2)
    base = [f"t{i}" for i in range(200)]
    docs = [(i, " ".join(f"z{k}" if k < 9 * i else w for k, w in enumerate(base))) for i in range(9)]
    rows = op.join_rows(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert [r["component_id"] for r in sorted(rows)] == brute.near_groups(docs, 4, 85) == [0] * 9


def test_edges(spark):
    same, big = "one two three four five six", 2**62 + 1
    words = [f"t{i}" for i in range(60)]
    docs = [(None, same), (None, None), (5, same), (5, same), (-4, same), (8, "alone"), (9, None), (9, " ".join(words)),
            (big, " ".join(words[:-1])), (big + 1, " ".join(words)), (-(2**63), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in op.join_rows(df, 4, 85).collect())
    assert got[:2] == [(False, 0, 0, None), (False, 0, 3, None)]
    assert got[2:] == sorted([(True, 5, 3, -4), (True, 5, 3, -4), (True, -4, 3, -4), (True, 8, 1, 8), (True, 9, 0, 9), (True, 9, 57, 9),
                              (True, big, 56, 9), (True, big + 1, 57, 9), (True, -(2**63), 1, -(2**63))])
    assert op.join_rows(df.where("false"), 4, 85).collect() == []


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:280_000])), (3, " ".join(words[:200_000]))]
    rows = sorted(op.join_rows(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect())
    assert [(r["component_id"], r["n_shingles"]) for r in rows] == [(1, 299_997), (1, 279_997), (3, 199_997)]


def test_product_equals_intersections(monkeypatch):
    monkeypatch.setattr(op, "COLUMNS", 7)
    monkeypatch.setattr(op, "EXPANDED", 50)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    left, right = sets[:25], sets[15:]
    both = np.array([[len(np.intersect1d(x, y)) for y in right] for x in left])
    for limit in (1, 8, 20):
        assert (op.similar(left, right, np.full(both.shape, limit)) == (both >= limit)).all()


def test_similar_sets_pass_the_first_columns():
    """Whatever the order of the columns, the bound on the first ones never drops a pair."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        size = int(rng.integers(1, 80))
        a = rng.choice(10_000, size, replace=False).astype(np.uint64)
        b = np.concatenate([a[: size - int(rng.integers(0, 1 + size // 5))], rng.choice(10_000, int(rng.integers(0, 1 + size // 6)), replace=False).astype(np.uint64) + np.uint64(20_000)])
        hot = rng.random(40_000) < rng.choice([0, 0.3, 0.9])
        shift = np.uint64(rng.choice([0, 4, 9]))  # shortened hashes that fall together
        rows = []
        for s in (a, b):
            s = np.unique(s)
            first = np.concatenate([s[~hot[s]], s[hot[s]]])[: op.prefix_length(len(s), 85)]
            rows.append((len(s), int((~hot[first]).sum()), (first >> shift).astype(np.uint32)))
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * common >= 85 * union:
            assert op.similar([rows[0][2]], [rows[1][2]], op.prefix_need([rows[0]], [rows[1]], 85))[0, 0]


@pytest.mark.parametrize("percent", [30, 50, 80, 100])
def test_sketches_lose_no_similar_set(monkeypatch, percent):
    monkeypatch.setattr(op, "SKETCH_PAIRS", 7)
    rng = np.random.default_rng(percent)
    sets, block = [], []
    for i, n in enumerate([1, 2, 63, 64, 65, 66, 130, 500, 1_030, 2_000, 90, 300]):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for share in (0, 0.05, 0.2, 0.5, 0.7):
            own = base.copy()
            own[: int(share * n)] = rng.integers(0, 2**63, int(share * n))
            sets.append(np.unique(own[: max(1, n - int(rng.integers(0, 1 + n // 3)))]))
            block.append(i // 2)  # sets of two sizes meet
    got = op.with_partner(np.array(block), np.array([len(s) for s in sets]), [op.parity_sketch(s).tobytes() for s in sets], percent)
    apart = 0
    for i, a in enumerate(sets):
        common = [(len(np.intersect1d(a, b)), len(np.union1d(a, b))) for j, b in enumerate(sets) if j != i and block[j] == block[i]]
        assert got[i] or not any(100 * both >= percent * all_ for both, all_ in common)
        apart += not got[i]
    assert percent < 80 or apart > len(sets) // 3


def by_chance(n):
    """Unrelated texts of one length, each of which has passages of four words in common with many others."""
    rng = random.Random(n)
    passages = [" ".join(f"p{i}.{k}" for k in range(4)) for i in range(60)]
    docs = []
    for i in range(n):
        parts = [" ".join(f"d{i}.{k}.{j}" for j in range(4)) for k in range(20)] + rng.sample(passages, 12)
        rng.shuffle(parts)
        docs.append((i, " ".join(parts)))
    return docs + [(n + i, docs[i][1] + " more") for i in range(5)]


def test_rows_that_meet_by_chance_are_not_dealt(spark, monkeypatch):
    """What is dealt in full grows with the similar rows, not with the passages that happen to be in two texts."""
    dealt, linked = [], op.linked_blocks

    def counted(members, sizes, *rest):
        dealt.append(members.count())
        return linked(members, sizes, *rest)

    monkeypatch.setattr(op, "linked_blocks", counted)
    docs = by_chance(150)
    rows = op.join_rows(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert [r["component_id"] for r in sorted(rows)] == brute.near_groups(docs, 4, 85)
    assert dealt[0] <= 60 and dealt[1] <= 20


@pytest.mark.parametrize("sketched,sent", [(3, 2), (4096, 3)])
def test_large_blocks_and_texts_in_turns(spark, monkeypatch, sketched, sent):
    """Blocks too large for sketches are left as they are; texts of many rows are fetched in turns."""
    monkeypatch.setattr(op, "SKETCHED", sketched)
    monkeypatch.setattr(op, "SENT_ROWS", sent)
    docs = corpus(4) + by_chance(20)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    rows = op.join_rows(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert [r["component_id"] for r in sorted(rows)] == brute.near_groups(docs, 4, 85)
