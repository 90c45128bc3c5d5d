"""Quality of documents by hierarchical empirical Bayes.

A classifier of single documents gives each one a probability.  Grouped aggregation
turns those into posteriors of paths and hosts: a path is shrunk towards its host, a
host towards all documents, the more the fewer documents it has.  How strongly is not
set but estimated from how much the groups differ (analysis of variance).  The
document's own evidence is then combined with what the *other* documents of its site say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import add_columns, stored, without, word_lists

BUCKETS = 1 << 18  # hashed features
TRAIN_DOCS = 20_000  # labelled documents that the classifier is fitted to, at most about
MIN_DOCS = 5  # training documents with a feature, for it to count
ROUNDS = 120
RIDGE = 1e-4
LEAST = 1e-4  # probabilities stay this far from 0 and 1
FIRM = 1e12  # prior strength where groups do not differ
WORDS_HELD = 400_000
RESULTS = ["doc_score", "host_score", "path_score", "score", "keep"]

FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
DIGITS = re.compile(rb"[0-9]+")


class Features(dict):
    """Word -> buckets of the word itself and of its shape (letters as a, digits as 0)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = b"\0" + DIGITS.sub(b"0", LETTERS.sub(b"a", word))
        value = self[word] = (xxhash.xxh3_64_intdigest(word) % BUCKETS, xxhash.xxh3_64_intdigest(shape) % BUCKETS)
        return value


def features(text: bytes | None, known: Features) -> np.ndarray:
    """Sorted distinct buckets: words, their shapes, and how repetitive the text is."""
    seen: set[bytes] = set()
    total = twice = 0
    for ws in word_lists((text or b"").translate(FOLD)):
        seen.update(ws)
        total += len(ws)
        twice += sum(a == b for a, b in zip(ws, ws[1:]))
    if len(known) > WORDS_HELD:
        known.clear()
    found = {b for pair in map(known.__getitem__, seen) for b in pair}
    if total >= 20:
        for name, share in ((b"\1distinct", len(seen) / total), (b"\1twice", twice / total)):
            found.add(known[name + b"%d" % (10 * share)][0])
    return np.array(sorted(found), np.int32)


class Classifier(NamedTuple):
    weights: np.ndarray  # one per bucket
    bias: float


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], good: np.ndarray) -> Classifier:
    """Logistic regression on bucket presence, by gradient steps with per-bucket rates."""
    weights = np.zeros(BUCKETS, np.float32)
    if not len(rows):
        return Classifier(weights, 0.0)
    rate = np.clip(good.mean(), LEAST, 1 - LEAST)
    bias = float(np.log(rate / (1 - rate)))
    index = np.concatenate(rows)
    index = index if len(index) else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    often = np.bincount(index, minlength=BUCKETS) >= MIN_DOCS
    owner, index = owner[often[index]], index[often[index]]
    used, column = np.unique(index, return_inverse=True)
    w, pace = np.zeros(len(used)), np.full(len(used), 1e-8)
    for _ in range(ROUNDS):
        miss = sigmoid(bias + np.bincount(owner, w[column], len(rows))) - good
        slope = np.bincount(column, miss[owner], len(used)) / len(rows) + RIDGE * w
        pace += slope**2
        w -= 0.3 * slope / np.sqrt(pace)
        bias -= 0.3 * float(miss.mean())
    weights[used] = w
    return Classifier(weights, bias)


def train(labelled: DataFrame, max_docs: int = TRAIN_DOCS) -> Classifier:
    """Classifier from ``(doc_id, text, good)``, fitted to at most about ``max_docs`` rows.

    The rows are taken by a hash of the id; only their feature numbers come to the
    driver.  Rows with a NULL label are left out; without rows, every document is
    given probability 0.5.
    """
    labelled = labelled.where(F.col("good").isNotNull())
    share = int(min(1.0, max_docs / max(1, labelled.count())) * 1_000_000)
    taken = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def work(slices):
        known = Features()
        for batch in slices:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            yield [pa.array([features(t, known) for t in texts], pa.list_(pa.int32()))]

    new = [T.StructField("features", T.ArrayType(T.IntegerType()))]
    asked = taken.select("text", F.col("good").cast("double").alias("good"), F.xxhash64("doc_id").alias("order"))
    got = add_columns(asked, new, work, leave_out=("text",)).toArrow()
    got = got.sort_by("order").combine_chunks()
    column = pa.chunked_array(got["features"]).combine_chunks()
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    rows = np.split(column.flatten().to_numpy(), ends[:-1]) if len(ends) else []
    return fit(rows, got["good"].to_numpy())


def evidence(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``docs`` with ``doc_score`` in place of ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def work(slices) -> Iterator[list[pa.Array]]:
        known = Features()
        for batch in slices:
            column = batch.column(batch.schema.names.index("text")).cast(pa.binary())
            weights, bias = sent.value
            sums = [float(weights[features(t, known)].sum()) for t in column.to_pylist()]
            yield [pa.array(np.clip(sigmoid(bias + np.array(sums, float)), LEAST, 1 - LEAST))]

    return add_columns(docs, [T.StructField("doc_score", T.DoubleType())], work, leave_out=("text",))


def strength(spread: Column, groups: Column, within: Column, rows: Column, parents: Column, size: Column, mean: Column) -> Column:
    """Prior strength (in documents) of the parents' means, from sums over groups.

    ``spread`` is the sum over groups of n (mean - parent mean)^2, ``within`` the sum
    of squares inside groups, ``size`` the typical number of documents of a group.
    """
    noise = within / F.greatest(rows - groups, F.lit(1))
    between = (spread / F.greatest(groups - parents, F.lit(1)) - noise) / size
    return F.when((groups > parents) & (between > 0) & (size > 0), F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(1e-3)), F.lit(FIRM))).otherwise(FIRM)


def posteriors(scored: DataFrame) -> DataFrame:
    """``(host, path, n, s, host_n, host_s, prior, host_k, path_k)`` per path, from ``(host, path, doc_score)``."""
    paths = stored(
        scored.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"), F.sum("doc_score").alias("s"), F.sum(F.col("doc_score") * F.col("doc_score")).alias("q")
        ),
        "paths",
    )
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"),
        F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("host_paths"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("path_fit"),
    )
    hosts = hosts.withColumn("host_fit", F.col("host_s") * F.col("host_s") / F.col("host_n"))
    total = hosts.agg(
        F.sum("host_n").alias("rows"), F.sum("host_s").alias("sum"), F.sum("host_q").alias("all_q"),
        F.count(F.lit(1)).alias("hosts"), F.sum("host_paths").alias("paths"), F.sum("host_fit").alias("fit"),
        F.sum("path_fit").alias("deep_fit"), F.sum(F.col("host_n") * F.col("host_n")).alias("host_squares"),
        F.sum(F.col("squares") / F.col("host_n")).alias("path_squares"),
    )
    mean = F.col("sum") / F.col("rows")
    size = (F.col("rows") - F.col("host_squares") / F.col("rows")) / F.greatest(F.col("hosts") - 1, F.lit(1))
    path_size = (F.col("rows") - F.col("path_squares")) / F.greatest(F.col("paths") - F.col("hosts"), F.lit(1))
    prior = total.select(
        mean.alias("prior"),
        strength(F.col("fit") - F.col("sum") * mean, F.col("hosts"), F.col("all_q") - F.col("fit"), F.col("rows"), F.lit(1), size, mean).alias("host_k"),
        strength(F.col("deep_fit") - F.col("fit"), F.col("paths"), F.col("all_q") - F.col("deep_fit"), F.col("rows"), F.col("hosts"), path_size, mean).alias("path_k"),
    ).first()  # one row of three numbers
    return paths.join(hosts.select(F.col("host").alias("h"), "host_n", "host_s"), F.col("host").eqNullSafe(F.col("h"))).select(
        "host", "path", "n", "s", "host_n", "host_s",
        *[F.lit(prior[c]).cast("double").alias(c) for c in ("prior", "host_k", "path_k")],
    )


def logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(LEAST)), F.lit(1 - LEAST))
    return F.log(inside / (1 - inside))


def combine(scored: DataFrame) -> DataFrame:
    """``scored(host, path, doc_score, ...)`` with the posteriors of its site and the final score.

    Both posteriors leave the document itself out.
    """
    sites = posteriors(scored).withColumnsRenamed({"host": "site_host", "path": "site_path"})
    joined = scored.join(
        sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    )
    own = F.col("doc_score")
    host = (F.col("host_s") - own + F.col("host_k") * F.col("prior")) / (F.col("host_n") - 1 + F.col("host_k"))
    path = (F.col("s") - own + F.col("path_k") * F.col("host_score")) / (F.col("n") - 1 + F.col("path_k"))
    score = 1 / (1 + F.exp(-(logit(own) + logit(F.col("path_score")) - logit(F.col("prior")))))
    return (
        joined.withColumn("host_score", host).withColumn("path_score", path).withColumn("score", score)
        .withColumn("keep", F.col("score") >= 0.5)
        .select(*scored.columns, *RESULTS[1:])
    )


def rate(docs: DataFrame, classifier: Classifier, host: Column, path: Column, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``doc_score``, ``host_score``, ``path_score``, ``score`` and ``keep``.

    ``doc_score`` is the classifier's probability that the document is good,
    ``host_score`` and ``path_score`` are the shrunken means of the other documents of
    its host and path, ``score`` combines all.  Columns of these names are replaced.
    A NULL host or path is a site like any other; a site of one document has the
    score of its parent.  NULL and empty texts are judged by what all have in common.
    """
    rest = without(docs, [*RESULTS, text_col])
    slim = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in rest.columns]).alias("row"), host.alias("host"), path.alias("path"), docs[f"`{text_col}`"].alias("text")
    )
    rated = combine(stored(evidence(slim, classifier), "evidence"))
    return rated.select("row.*", *RESULTS)


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first part of the path of an address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
