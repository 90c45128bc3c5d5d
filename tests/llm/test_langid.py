"""Language identification: held-out accuracy, counts against plain Python, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import langid
from passagework.llm.queries import op8_langid

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = op8_langid(spark, SF).where("held_out").join(docs, "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held.count() > 20 and right >= 0.97


def grams(text):
    code = "".join(c if c.isalpha() else " " for c in text.lower())
    words = code.split()
    return sorted(g for w in words for n in langid.SIZES for g in [(" " + w + " ")[i : i + n] for i in range(len(w) + 3 - n)])


def test_ngrams_are_those_of_the_words():
    texts = ["The über-cat, 3 b", "", "x", "a\nbc--d'e"]
    key, owner, lettered = langid.ngrams([t.lower() for t in texts], list(range(len(texts))))
    for number, text in enumerate(texts):
        plain = grams(text)
        mine = key[owner == number]
        assert len(mine) == len(plain) and len(np.unique(mine)) == len(set(plain))
    assert lettered.tolist() == [0, 2, 3]


def plain_predictions(learned, texts):
    """Language and score by sets of n-grams, without filters: (lang, text) pairs are learned."""
    counts = {}
    for lang, text in learned:
        counts.setdefault(lang, Counter()).update(grams(text))
    share = {}
    for lang, found in counts.items():
        for g, n in found.items():
            if n >= langid.MIN_COUNT:
                share.setdefault(g, {})[lang] = n / found.total()
    known = {lang: {g for g, of in share.items() if of.get(lang, 0) >= langid.TYPICAL * max(of.values())} for lang in sorted(counts)}
    usual = max(sorted(counts), key=Counter(lang for lang, _ in learned).get)
    out = []
    for text in texts:
        own = grams(text or "")
        hits = {lang: sum(g in some for g in own) for lang, some in known.items()}
        best = max(hits, key=hits.get)
        out.append(("und", 0.0) if not own else (best, hits[best] / len(own)) if hits[best] else (usual, 0.0))
    return out


def test_predictions_equal_those_of_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    learned = [(r["lang"], r["text"]) for r in docs if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    expected = plain_predictions(learned, [r["text"] for r in docs])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op8_langid(spark, SF).collect()}
    assert len(got) == len(docs)
    for row, (lang, score) in zip(docs, expected):
        assert got[row["doc_id"]] == (lang, pytest.approx(score, abs=1e-3))


def test_equal_languages(spark):
    train = [(i, "one and the same", l) for i in range(20) for l in ("b", "a", "c")]
    filters = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "the same"), (2, "quux")], "doc_id long, text string")
    got = [(r["lang_pred"], round(r["score"], 3)) for r in langid.predict(df, filters).orderBy("doc_id").collect()]
    assert got == [("a", 1.0), ("a", 0.0)]


def test_stretches_lose_nothing(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 16)
    text = "several words, of some length and a verylongwordwithoutanygapatall end"
    whole = np.sort(np.concatenate([langid.ngrams(p, o)[0] for p, o in langid.stretches([text])]))
    assert np.array_equal(whole, np.sort(langid.ngrams([text], [0])[0]))


def test_edges(spark):
    train = [(i, t, l) for i in range(20) for t, l in [("the cat and the dog", "en"), ("le chat et le chien", "fr")]]
    train += [(99, None, "en"), (98, "words", None)]
    filters = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    docs = [(1, "the dog", 5), (1, "the dog", 5), (2, "le chien", 5), (3, None, 5), (4, "", 5), (5, "123 --", 5), (6, "語", 5), (None, "the " * 400_000, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, SCORE int")
    got = {(r["doc_id"], (r["text"] or "")[:20]): (r["lang_pred"], r["score"]) for r in langid.predict(df, filters).collect()}
    assert got[(1, "the dog")][0] == "en" and got[(2, "le chien")][0] == "fr"
    assert got[(3, "")] == got[(4, "")] == got[(5, "123 --")] == ("und", 0.0)
    assert got[(6, "語")] == ("en", 0.0) and got[(None, "the " * 5)][0] == "en"
    assert langid.predict(df.where("false"), filters).collect() == []


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    df = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert langid.predict(df, langid.train(empty)).first()["lang_pred"] == "und"


def test_more_languages_than_a_word_has_bits(spark):
    code = [f"l{i:03d}" for i in range(130)]
    own = lambda i: " ".join(chr(0x4E00 + 40 * i + j) * 3 + chr(0x4E00 + 40 * i + j + 1) for j in range(30))
    docs = [(10 * i + k, own(i), name) for i, name in enumerate(code) for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    filters = langid.train(df)
    assert filters.languages == code
    rows = langid.predict(df, filters).collect()
    assert len(rows) == len(docs) and all(r["lang_pred"] == r["lang"] and r["score"] > 0.5 for r in rows)
