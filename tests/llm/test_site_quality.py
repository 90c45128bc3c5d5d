"""Hierarchical empirical Bayes: posteriors against plain Python, held-out accuracy, odd rows."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from passagework.llm import site_quality as op
from passagework.llm.queries import op4_site_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select(
        "doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    )
    rated = op4_site_quality(spark, SF)
    assert rated.count() == 10_000
    held = rated.where("held_out").join(labels, "doc_id").select("good", "keep", "score").collect()
    assert len(held) > 50
    right = sum(r["good"] == r["keep"] for r in held) / len(held)
    good, bad = [[r["score"] for r in held if r["good"] is g] for g in (True, False)]
    ranked = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert right >= 0.85 and ranked >= 0.85


def plain(rows):
    """(host, path, p) rows -> (host score, path score, score) for each."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, x, p in rows:
        hosts[h].append(p)
        paths[h, x].append(p)
    n, mean = len(rows), sum(p for *_, p in rows) / len(rows)
    avg = lambda v: sum(v) / len(v)
    within = lambda groups: sum((p - avg(g)) ** 2 for g in groups.values() for p in g)

    def k(spread, groups, parents, inside, size):
        if groups <= parents or size <= 0:
            return op.FIRM
        between = (spread / (groups - parents) - inside / max(n - groups, 1)) / size
        return min(max(mean * (1 - mean) / between - 1, 1e-3), op.FIRM) if between > 0 else op.FIRM

    spread = sum(len(g) * (avg(g) - mean) ** 2 for g in hosts.values())
    size = (n - sum(len(g) ** 2 for g in hosts.values()) / n) / max(len(hosts) - 1, 1)
    host_k = k(spread, len(hosts), 1, within(hosts), size)
    spread = sum(len(g) * (avg(g) - avg(hosts[h])) ** 2 for (h, _), g in paths.items())
    size = (n - sum(len(g) ** 2 / len(hosts[h]) for (h, _), g in paths.items())) / max(len(paths) - len(hosts), 1)
    path_k = k(spread, len(paths), len(hosts), within(paths), size)
    out = []
    logit = lambda p: math.log(min(max(p, op.LEAST), 1 - op.LEAST) / (1 - min(max(p, op.LEAST), 1 - op.LEAST)))
    for h, x, p in rows:
        a = (sum(hosts[h]) - p + host_k * mean) / (len(hosts[h]) - 1 + host_k)
        b = (sum(paths[h, x]) - p + path_k * a) / (len(paths[h, x]) - 1 + path_k)
        out.append((a, b, 1 / (1 + math.exp(-(logit(p) + logit(b) - logit(mean))))))
    return out


def test_posteriors(spark):
    rng = random.Random(2)
    rows = []
    for host in ["a", "b", "c", None]:
        for path in ["x", "y", None, "z"][: rng.randint(1, 4)]:
            base = rng.random()
            rows += [(host, path, min(0.99, max(0.01, rng.gauss(base, 0.2)))) for _ in range(rng.randint(1, 30))]
    for sample in (rows, [r for r in rows if r[0] == "a"], rows[:1], [("a", "x", 0.5)] * 4):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(sample)], "i int, host string, path string, doc_score double")
        got = {r["i"]: r for r in op.combine(df).collect()}
        assert len(got) == len(sample)
        for i, want in enumerate(plain(sample)):
            for name, value in zip(("host_score", "path_score", "score"), want):
                assert abs(got[i][name] - value) < 1e-6


def test_edges(spark):
    none = op.train(spark.createDataFrame([], "doc_id long, text string, good boolean"))
    docs = [(1, None, 3, "u"), (2, "", 3, None), (3, "word " * 300_000, 3, "u"), (3, "word", 3, "u"), (None, "x", 3, "v")]
    df = spark.createDataFrame(docs, "doc_id long, text string, SCORE int, host string")
    got = op.rate(df, none, F.col("host"), F.col("host")).collect()
    assert len(got) == 5 and all(abs(r["score"] - 0.5) < 1e-9 for r in got)
    assert op.rate(df.where("false"), none, F.col("host"), F.col("host")).collect() == []


def test_site_of(spark):
    urls = ["https://Blog.example.com/en/7198#top", "http://a.b:80?x", "no address", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    host, path = op.site_of(F.col("u"))
    got = [tuple(r) for r in df.select(host, path).collect()]
    assert got == [("blog.example.com", "/en"), ("a.b", ""), ("", ""), (None, None)]
