"""Importance resampling, against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from passagework.llm import importance as op


def runs(text, order=2):
    ws = [w.encode() for w in brute.item_words(text)]
    return [b" ".join(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1)]


def brute_resample(docs, target, percent=25, buckets=10_000, least=20, seed=7):
    """(id, text) rows -> (n_features, weight, score, rank) of each."""
    bucket = lambda f: zlib.crc32(f) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x)) for texts in ([x for _, x in docs], target))
    top, low = s.total() + buckets, t.total() + buckets
    out = []
    for key, text in docs:
        own = runs(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * top / ((s[b] + 1) * low))) for b in map(bucket, own)]
        weight = sum(gains) // len(own) if own else 0
        if key is None:
            out.append([len(own), weight, None, None])
            continue
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        out.append([len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [i for i, (key, text) in enumerate(docs) if key is not None and len(brute.item_words(text)) >= least]
    order = sorted(able, key=lambda i: (-out[i][2], docs[i][0]))
    for rank, i in enumerate(order[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return [tuple(x) for x in out]


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["wört", "b2b", "X", "don't", "über-all", "日本", *[f"w{i}" for i in range(300)]]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 25, 80]))) for _ in range(n)]


@pytest.mark.parametrize("percent,pivots,piece", [(25, 32, 4 << 20), (60, 2, 50), (100, 3, 4 << 20), (0, 3, 4 << 20)])
def test_equals_plain_python(spark, monkeypatch, percent, pivots, piece):
    monkeypatch.setattr(op, "PIVOTS", pivots)
    monkeypatch.setattr(op, "PIECE_BYTES", piece)
    texts = corpus(1, 150)
    docs = [*enumerate(texts, -20), (2**62 + 5, texts[0]), (-(2**63), "a " * 30), (900, None), (901, ""), (None, "x y " * 20)]
    target = [*corpus(2, 10), None, ""]
    df = spark.createDataFrame([(*d, i, 0) for i, d in enumerate(docs)], "doc_id long, text string, place int, score int").repartition(5)
    got = op.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), percent, keep_text=False)
    assert got.columns == ["doc_id", "place", *op.RESULTS]
    rows = {r["place"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()}
    assert [rows[i] for i in range(len(docs))] == brute_resample(docs, target, percent)


def test_repeats_and_empty_tables(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(5, text)] * 400 + [(i, text) for i in range(100, 140)], "doc_id int, text string")
    none = df.where("false").select("text")
    got = op.resample(df, none, 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 221)) and len(got) == 440
    assert all(r["text"] == text for r in got)
    first = sorted((-r["score"], r["doc_id"]) for r in got)[:220]
    assert sorted((-r["score"], r["doc_id"]) for r in got if r["rank"]) == first
    assert op.resample(df.where("false"), df).collect() == []


def test_very_long_text(spark):
    words = [f"w{i % 977}" for i in range(900_000)]
    text = " ".join(words) + " " + "q" * 600_000
    got = op.resample(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string"), spark.createDataFrame([("w5 w6",)], "text string"), keep_text=False)
    want = brute_resample([(1, text), (2, "a b")], ["w5 w6"])
    assert [tuple(r)[1:] for r in got.orderBy("doc_id").collect()] == want


def test_features_of_pieces(monkeypatch):
    texts = [*corpus(3, 40), "x" * 700 + " y " + "z" * 300, None, "ÀB c"]
    whole = [sorted(zlib.crc32(f) % 97 for f in runs(t, 3)) for t in texts]
    for piece in (1, 40, 1 << 20):
        monkeypatch.setattr(op, "PIECE_BYTES", piece)
        for offset in (0, 7):
            found = [[] for _ in texts[offset:]]
            for bucket, row in op.text_features(pa.array(texts).slice(offset), 3, 97):
                for b, r in zip(bucket.tolist(), row.tolist()):
                    found[r].append(b)
            assert [sorted(f) for f in found] == whole[offset:]


def test_quickselect_finds_every_place(spark, monkeypatch):
    monkeypatch.setattr(op, "PIVOTS", 3)
    rows = spark.range(60).select((F.col("id") % 4).alias("score"), (F.col("id") % 7).alias("doc_id"), F.col("id").alias("place"))
    order = sorted(map(tuple, rows.collect()), key=lambda r: (-r[0], r[1], r[2]))
    for k in (1, 2, 17, 59, 60):
        assert op.kth_key(rows, k) == order[k - 1]


def test_gains_favour_the_target():
    source, target = np.array([100, 10, 0]), np.array([0, 10, 5])
    gains = op.bucket_gains(source, target)
    assert gains[0] < 0 < gains[1] < gains[2]
